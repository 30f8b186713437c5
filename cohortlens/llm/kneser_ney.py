"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Symbols are characters: letters in lower case, digits as one, white space as one blank,
and every character is predicted from the ``order - 1`` before it. A key holds ``order``
symbols of ``63 // order`` bits; characters that need more bits share classes (at order 5
those from U+1000 on, at order 3 none). Counts of all trusted text, continuation counts and
context totals are tables that Spark shards by key; no task or driver holds the model.

Texts are folded where they are read and written once, compressed, in lots of bounded size
next to the distinct keys each lot asks for. Labels meet doc_ids and places in a lot, not
texts. The distinct keys meet the count tables in joins, one order at a time. The keys a lot
asks for are cut by remainder into pieces that travel compressed; a piece of all lots meets
its part of the answers in one task of bounded size, and only values travel back to the lots. A document is kept when its perplexity is at most
a quantile of the trusted texts of its language (of all trusted texts for a language without
any); rows of one perplexity are ranked by a hash of their doc_id.

Edge cases: a null or empty text has no perplexity and is not kept; a null language is a
language of its own; rows with null or repeated doc_ids are scored like any others, but
a null doc_id is never trusted; characters that the trusted text lacks get the share that
discounts leave over; without trusted text nothing is scored, and texts are kept unless
empty; an empty table gives an empty table; other columns are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import storage
from cohortlens.llm import wordarrays as wa
from cohortlens.operators import ordering

ORDER = 5
START = 1
LOT_SYMBOLS = 32 << 20
LOT_ROWS = 20_000
PIECE_KEYS = 2_000_000  # asked for by all lots in a piece, about
QUANTILE = 0.998
CODEC = pa.Codec("zstd", compression_level=6)
BODY_CODEC = pa.Codec("zstd", compression_level=12)  # texts are written and moved more often than they are compressed

_folded = np.full(0x110000, -1, dtype=np.int64)


def width(order: int) -> int:
    """Bits of a symbol in a key."""
    return 63 // order


def _fold(point: int) -> int:
    c = chr(point)
    if c.isalpha():
        return ord(c.lower()[0])
    return 32 if c.isspace() else 48 if c.isdigit() else max(point, 2)


def symbols(text: wa.Text, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each character, and where rows start."""
    points = np.frombuffer(text.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    starts = np.append(0, np.cumsum((text.data & 0xC0) != 0x80))[text.offsets]
    c = _folded[points]
    if (c < 0).any():
        for point in np.unique(points[c < 0]).tolist():
            _folded[point] = _fold(point)
        c = _folded[points]
    half = 1 << (width(order) - 1)
    return np.where(c < 2 * half, c, half | (c & (half - 1))), starts


def grams(codes: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The key of each symbol with those before it in its row."""
    place = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    key = codes.copy()
    for back in range(1, min(order, len(codes) + 1)):
        before = np.full(len(codes), START, dtype=np.int64)
        before[back:] = codes[:-back]
        before[place < back] = START
        key |= before << (back * width(order))
    for back in range(len(codes) + 1, order):
        key |= START << (back * width(order))
    return key


def squeezed(values: np.ndarray) -> bytes:
    return CODEC.compress(values.tobytes(), asbytes=True)


def restored(body: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(CODEC.decompress(body, 8 * n, asbytes=True), dtype=kind)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return squeezed(np.diff(keys, prepend=0))


def unpacked(body: bytes, n: int) -> np.ndarray:
    return np.cumsum(restored(body, n, np.int64))


class Lot:
    """Folded documents of one task, compressed together."""

    def __init__(self, order: int):
        self.order = order
        self.rows: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.bodies: list[bytes] = []
        self.keys: list[np.ndarray] = []
        self.n_symbols = self.n_rows = 0

    def add(self, rows: pa.Array, codes: np.ndarray, starts: np.ndarray) -> None:
        self.rows.append(rows)
        self.lengths.append(np.diff(starts))
        self.bodies.append(codes.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8"))
        self.keys.append(np.unique(grams(codes, starts, self.order)))
        if len(self.keys) >= 8:
            self.keys = [np.unique(np.concatenate(self.keys))]
        self.n_symbols += len(codes)
        self.n_rows += len(rows)

    def full(self) -> bool:
        return self.n_symbols >= LOT_SYMBOLS or self.n_rows >= LOT_ROWS

    def close(self, number: int) -> pa.RecordBatch:
        body = b"".join(self.bodies)
        keys = np.unique(np.concatenate(self.keys))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), values)
        columns = {
            "lot": pa.array([number]),
            "rows": one(pa.concat_arrays(self.rows)),
            "lengths": one(pa.array(np.concatenate(self.lengths).astype(np.int64))),
            "size": pa.array([len(body)]),
            "body": pa.array([BODY_CODEC.compress(body, asbytes=True)], type=pa.binary()),
            "n_keys": pa.array([len(keys)]),
            "keys": pa.array([packed(keys)], type=pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _deal(order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        lot = Lot(order)
        for batch in batches:
            for text in wa.slices(batch.column("text")):
                lot.add(batch.column("row").slice(text.first, text.rows), *symbols(text, order))
                if lot.full():
                    yield lot.close(number)
                    number, lot = number + 1, Lot(order)
        if lot.n_rows:
            yield lot.close(number)

    return run


def deal(docs: DataFrame, keep: Sequence[str | Column], text: str = "text", order: int = ORDER) -> DataFrame:
    """Lots of folded documents, written once without a shuffle; ``rows`` holds the kept columns."""
    columns = [F.col(c) if isinstance(c, str) else c for c in keep]
    named = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType(
        [
            T.StructField("lot", T.LongType()),
            T.StructField("rows", T.ArrayType(named.schema["row"].dataType)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("size", T.LongType()),
            T.StructField("body", T.BinaryType()),
            T.StructField("n_keys", T.LongType()),
            T.StructField("keys", T.BinaryType()),
        ]
    )
    return storage.materialize(named.mapInArrow(_deal(order), schema), "kn_lots")


def _opened(size: int, body: bytes, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Symbols and row starts of a lot, some rows at a time, and the first row's place."""
    points = np.frombuffer(CODEC.decompress(body, size, asbytes=True).decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.append(0, np.cumsum(lengths))
    first = 0
    while first < len(lengths):
        last = max(int(np.searchsorted(at, at[first] + wa.SLICE_BYTES, side="right")) - 1, first + 1)
        yield points[at[first] : at[last]].astype(np.int64), at[first : last + 1] - at[first], first
        first = last


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    own, inverse = np.unique(keys, return_inverse=True)
    return [(own, np.bincount(inverse, weights=counts, minlength=len(own)).astype(np.int64))]


def _count(order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of keys in the chosen rows of a task's lots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = batch.column("lengths")[i].values.to_numpy()
                chosen = np.zeros(len(lengths), dtype=bool)
                chosen[batch.column("chosen")[i].values.to_numpy()] = True
                for codes, starts, first in _opened(batch.column("size")[i].as_py(), batch.column("body")[i].as_py(), lengths):
                    own = np.repeat(chosen[first : first + len(starts) - 1], np.diff(starts))
                    parts.append(np.unique(grams(codes, starts, order)[own], return_counts=True))
                    if len(parts) >= 16:
                        parts = _tally(parts)
        if parts:
            keys, counts = _tally(parts)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    return run


def _context(rows: DataFrame, context: str) -> DataFrame:
    """Per context: how much follows it, and how many followers occur once, twice, more often."""
    ones = [F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2)]
    return rows.groupBy(context).agg(F.sum("n").alias("total"), *ones, F.sum((F.col("n") >= 3).cast("long")).alias("n3"))


def _discounts(rows: DataFrame) -> list[float]:
    """What is taken from counts of one, two, and three or more."""
    n = rows.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (x or 0 for x in n)
    if not n1 or not n2 or not n3:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]


def _taken(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).when(n >= 3, d[2]).otherwise(0.0)


def _level(n: Column, ctx: str, d: list[float], lower: Column) -> Column:
    """Interpolated probability of one order; the lower order's where the context is unknown."""
    c = lambda name: F.col(f"{ctx}_{name}")
    n = F.coalesce(n, F.lit(0)).cast("double")
    left = c("n1") * d[0] + c("n2") * d[1] + c("n3") * d[2]
    return F.when(c("total").isNull(), lower).otherwise((n - _taken(n, d) + left * lower) / c("total"))


class Model:
    """Count tables of all orders, written to the shared folder.

    ``lots`` are dealt documents, ``chosen`` the places (lot, chosen) of trusted ones in them.
    """

    def __init__(self, lots: DataFrame, chosen: DataFrame, order: int = ORDER):
        self.order, self.bits = order, width(order)
        texts = lots.select("lot", "lengths", "size", "body").join(chosen, "lot")
        counted = texts.mapInArrow(_count(order), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        self.tables = {}
        for k in range(order, 0, -1):
            if k < order:
                counted = self.tables[k + 1].groupBy(self._last("key", k).alias("key")).agg(F.count("*").alias("n"))
            self.tables[k] = storage.materialize(counted.withColumn("context", F.shiftright("key", self.bits)), f"kn_{k}")
        self.discounts = {k: _discounts(table) for k, table in self.tables.items()}
        self.whole = _context(self.tables[1], "context").first()
        self.symbols = self.tables[1].count()

    def _last(self, key: str, k: int) -> Column:
        """The key of the last ``k`` symbols."""
        return F.col(key).bitwiseAND(F.lit((1 << k * self.bits) - 1))

    def _order(self, keys: DataFrame, k: int) -> DataFrame:
        """(key, p) of the distinct last ``k`` symbols of distinct keys."""
        d = self.discounts[k]
        own = keys if k == self.order else keys.select(self._last("key", k).alias("key")).distinct()
        rows = own.join(self.tables[k].select("key", "n"), "key", "left")
        if k == 1:
            w = self.whole
            n = F.coalesce("n", F.lit(0)).cast("double")
            left = w.n1 * d[0] + w.n2 * d[1] + w.n3 * d[2]
            return rows.select("key", ((n - _taken(n, d) + left / (self.symbols + 1)) / float(w.total)).alias("p"))
        context = _context(self.tables[k], "context")
        context = context.select("context", *[F.col(x).alias(f"context_{x}") for x in ("total", "n1", "n2", "n3")])
        rows = rows.withColumn("context", F.shiftright("key", self.bits)).join(context, "context", "left")
        lower = self._order(keys, k - 1).select(F.col("key").alias("last"), F.col("p").alias("lower"))
        rows = rows.withColumn("last", self._last("key", k - 1)).join(lower, "last")
        return rows.select("key", _level(F.col("n"), "context", d, F.col("lower")).alias("p"))

    def probabilities(self, keys: DataFrame) -> DataFrame:
        """(key, logp) for distinct keys."""
        return self._order(keys.select("key"), self.order).select("key", F.log("p").alias("logp"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys of each lot."""
    for batch in batches:
        for n, body in zip(batch.column("n_keys").to_pylist(), batch.column("keys").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(body, n))], ["key"])


def _cut(pieces: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each lot's keys, cut by remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot, n, body in zip(*(batch.column(c).to_pylist() for c in ("lot", "n_keys", "keys"))):
                keys = unpacked(body, n)
                piece = keys % pieces
                order = np.argsort(piece, kind="stable")
                own, first = np.unique(piece[order], return_index=True)
                parts = np.split(keys[order], first[1:]) if len(own) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own),
                        pa.array(np.full(len(own), lot, dtype=np.int64)),
                        pa.array(np.array([len(x) for x in parts], dtype=np.int64)),
                        pa.array([packed(x) for x in parts], type=pa.binary()),
                    ],
                    ["piece", "asking", "n", "keys"],
                )

    return run


def _look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Values of the keys that each lot asks for in a piece, in the order of the keys."""
    keys, logp = known.column("key").to_numpy(), known.column("logp").to_numpy()
    by_key = np.argsort(keys)
    keys, logp = keys[by_key], logp[by_key]
    values = [
        squeezed(logp[np.searchsorted(keys, unpacked(body, n))])
        for n, body in zip(asked.column("n").to_pylist(), asked.column("keys").to_pylist())
    ]
    return pa.table({"piece": asked.column("piece"), "asking": asked.column("asking"), "logp": pa.array(values, type=pa.binary())})


def _score(order: int, pieces: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Characters and summed log probability of each document of a lot."""

    def run(lots: pa.Table, answers: pa.Table) -> pa.Table:
        rows, n, total = [], [], []
        for i in range(lots.num_rows):
            rows.append(lots.column("rows")[i].values)
            lengths = lots.column("lengths")[i].values.to_numpy()
            n.append(lengths)
            keys = unpacked(lots.column("keys")[i].as_py(), lots.column("n_keys")[i].as_py())
            logp = np.full(len(keys), np.nan)
            by_piece = np.argsort(keys % pieces, kind="stable")
            at = np.append(0, np.cumsum(np.bincount(keys % pieces, minlength=pieces)))
            for piece, body in zip(answers.column("piece").to_pylist(), answers.column("logp").to_pylist()):
                own = by_piece[at[piece] : at[piece + 1]]
                logp[own] = restored(body, len(own), np.float64)
            for codes, starts, _ in _opened(lots.column("size")[i].as_py(), lots.column("body")[i].as_py(), lengths):
                found = logp[np.searchsorted(keys, grams(codes, starts, order))] if len(codes) else np.zeros(0)
                value = np.append(0.0, np.cumsum(found))
                total.append(value[starts[1:]] - value[starts[:-1]])
        return pa.table({"row": pa.concat_arrays(rows), "n_symbols": pa.array(np.concatenate(n)), "logp": pa.array(np.concatenate(total))})

    return run


def perplexities(lots: DataFrame, model: Model) -> DataFrame:
    """Struct ``row`` of kept columns and ``perplexity`` of each document of dealt lots."""
    n = lots.agg(F.sum("n_keys")).first()[0] or 0
    pieces = 2 * (n // (2 * PIECE_KEYS)) + 17  # odd, as keys are powers of two apart
    distinct = lots.select("n_keys", "keys").mapInArrow(_keys, "key long").distinct()
    known = storage.materialize(model.probabilities(storage.materialize(distinct, "kn_keys")), "kn_known")
    asked = lots.select("lot", "n_keys", "keys").mapInArrow(_cut(pieces), "piece long, asking long, n long, keys binary")
    known = known.withColumn("of", F.pmod("key", F.lit(pieces)))
    answers = asked.groupBy("piece").cogroup(known.groupBy("of")).applyInArrow(_look_up, "piece long, asking long, logp binary")
    row_type = T.StructType(
        [
            T.StructField("row", lots.schema["rows"].dataType.elementType),
            T.StructField("n_symbols", T.LongType()),
            T.StructField("logp", T.DoubleType()),
        ]
    )
    # A lot whose texts are all empty asks for nothing and meets no answers.
    scored = lots.groupBy("lot").cogroup(answers.groupBy("asking")).applyInArrow(_score(model.order, pieces), row_type)
    return scored.select("row", F.when(F.col("n_symbols") > 0, F.exp(-F.col("logp") / F.col("n_symbols"))).alias("perplexity"))


def places(lots: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(lot, chosen): where documents of these ids lie; only ids and places are shuffled."""
    each = lots.select("lot", F.posexplode(F.col(f"rows.{doc_id}")).alias("place", "id"))
    found = each.join(ids.toDF("good_id"), F.col("id") == F.col("good_id"), "left_semi")
    return found.groupBy("lot").agg(F.collect_list("place").alias("chosen"))


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang_key, threshold): an exact quantile per language, and one of all for ``*``."""
    rows = scored.filter(F.col("perplexity").isNotNull()).select(
        F.explode(F.array("lang_key", F.lit("*"))).alias("lang_key"), "perplexity", "tie"
    )
    # A perplexity is at least one; its inverse falls from one to zero.
    levels = ordering.falling_levels(1 / F.col("perplexity"))
    rank = {"q": lambda n: F.greatest(F.ceil(n * F.lit(quantile)), F.lit(1))}
    cut = ordering.nth_rows(rows, ["lang_key"], levels, ["perplexity", "tie"], rank)
    return cut.groupBy("lang_key").agg(F.max("perplexity").alias("threshold"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quantile: float = QUANTILE,
    order: int = ORDER,
) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) of each document.

    ``labels`` has (doc_id, quality, toxic); documents of quality 1 that are not toxic are trusted.
    """
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    good = good.select(F.col("doc_id").alias("good_id")).distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))
    lots = deal(rows, ["doc_id", "lang"], order=order)
    model = Model(lots, places(lots, good), order)
    if not model.symbols:
        return rows.select(
            "doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"),
            (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("kept"),
        )
    scored = perplexities(lots, model).select(
        "row.doc_id", "row.lang", F.coalesce(F.concat(F.lit("="), "row.lang"), F.lit("")).alias("lang_key"), "perplexity"
    )
    scored = storage.materialize(scored, "kn_scored")
    sure = scored.join(good, F.col("doc_id") == F.col("good_id"), "left_semi").withColumn("tie", F.xxhash64("doc_id"))
    cuts = storage.materialize(thresholds(sure, quantile), "kn_thresholds")
    overall = cuts.filter(F.col("lang_key") == "*").agg(F.max("threshold")).first()[0]
    judged = scored.join(cuts, "lang_key", "left").withColumn("threshold", F.coalesce("threshold", F.lit(overall)))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return judged.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"))

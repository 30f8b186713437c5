"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words inside a sentence, runs of them as one) and units after
a number become typed placeholders, other words count in lower case. Windows of ``WIDTH``
template words are joined by hash with those of the benchmark's items; windows with fewer
than ``LITERALS`` plain words say too little as templates and are joined word for word. For each document, item
and offset between them, the slots must agree: one value of the item stands for one value
of the document throughout, and the other way round. So a question with new numbers or
names is found, and text that merely has the same shape is not. An item is contained when
its consistent windows reach ``SHARE`` of all its windows. In running text a name at the
edge of an item can run on into what stands around it, so names at the first and last
matched word are left out of the comparison. Words in capitals throughout say nothing about
names, and a capital at the start of an item does inside a sentence; so items and documents
are both read a second time with their names as plain words. Windows word for word belong
to this second reading, which finds every whole copy, whatever it holds and stands in.

Only windows in a bit map of the benchmark's windows (16 MB at most) leave the task that
read the text, so what is shuffled follows the matches; the join itself is planned by size.

Edge cases: null and empty texts have no windows; items of less than ``WIDTH`` but at
least three words are one window, shorter ones are never matched; documents with a null doc_id are reported with a null; repeated rows of
equal doc_id and text are reported once; an empty table on either side gives no rows.
Bytes outside ASCII are letters of a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import storage
from cohortlens.llm import wordarrays as wa

WIDTH = 6
LITERALS = 3
SHARE = 0.5
# Units that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ounce ounces "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years meter meters metre metres kilometer kilometers gram grams kilogram kilograms "
    "dollar dollars cent cents euro euros percent degrees kb mb gb tb hz khz mhz ghz w kw v kv mph kmh"
).split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA5A5000000000001, 0xA5A5000000000002, 0xA5A5000000000003))
EXACT = np.uint64(0xA5A5000000000004)
_SCHEMA = "named boolean, size int, at long, window long, slots array<long>"


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
    ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return np.sort(wa.hashes(data, np.append(0, ends[:-1] + 1), ends))


_UNIT_HASHES = _unit_hashes()


@dataclass
class Scan:
    """What each word of a text is, whichever way names are read."""

    row: np.ndarray
    hash: np.ndarray
    number: np.ndarray
    name: np.ndarray
    unit: np.ndarray
    listed: np.ndarray  # a unit, if a number stands before the word
    joined: np.ndarray  # no row or sentence ends before the word


def scan(text: wa.Text) -> Scan:
    data = text.data.copy()
    n = len(data)
    none = np.zeros(0, dtype=bool)
    if not n:
        return Scan(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), none, none, none, none, none)
    accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    digit = (data >= 48) & (data <= 57)
    inside = digit | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    mark = np.flatnonzero((data[1:-1] == 44) | (data[1:-1] == 46)) + 1
    inside[mark[digit[mark - 1] & digit[mark + 1]]] = True
    words = wa.runs(text, inside)
    if not len(words.start):
        return Scan(words.row, np.zeros(0, dtype=np.uint64), none, none, none, none, none)
    stop = np.isin(data, np.frombuffer(b".!?:;\n", dtype=np.uint8)) & ~inside
    stops = np.append(0, np.cumsum(stop))
    upper = (data >= 65) & (data <= 90)
    upper[accent - 1] = True
    small = (data >= 97) & (data <= 122)
    small[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0xA0)
    smalls = np.append(0, np.cumsum(small))
    shouted = smalls[words.end] == smalls[words.start]  # all capitals say nothing about names
    data[accent] += 32
    h = wa.hashes(data, words.start, words.end)
    follows = np.append(False, words.row[1:] == words.row[:-1])
    gap = np.zeros(len(h), dtype=bool)
    gap[1:] = stops[words.start[1:]] > stops[words.end[:-1]]
    joined = follows & ~gap
    number = digit[words.start]
    name = upper[words.start] & joined & ~shouted
    listed = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, h), len(_UNIT_HASHES) - 1)] == h
    unit = np.append(False, number[:-1]) & joined & ~number & listed
    return Scan(words.row, h, number, name, unit, listed, joined)


def template(words: Scan, names: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, template code and slot value of each template word.

    The value is 0 for plain words, odd for names and even for numbers and units. Without
    ``names`` all words but numbers and units are plain.
    """
    name = words.name & names
    unit = words.unit & ~name
    code = np.where(words.number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, words.hash)))
    head = ~(name & np.append(False, name[:-1]) & words.joined) if len(name) else name  # a run of names is one slot
    first = np.flatnonzero(head)
    value = np.where(words.number | name | unit, words.hash, np.uint64(0))
    value = np.add.reduceat(value, first) if len(first) else value
    value = np.where(name[first], value | np.uint64(1), value & ~np.uint64(1))
    return words.row[first], code[first], value


def _keys(scanned: Scan, names: bool, row: np.ndarray, code: np.ndarray, slot: np.ndarray, size: int, whole_below: int):
    """(hash, first word) of the windows of one reading, template keys and keys word for word.

    Without ``whole_below`` every window has a key word for word. Texts that are searched for
    have it where the template says too little, and where a number before the text would
    make its first word a unit.
    """
    count = np.bincount(row)
    words = wa.Words(row, row, row, count)
    plain = np.append(0, np.cumsum(slot == 0))
    g, at = wa.windows(words, code, size)
    if size < whole_below:
        whole = count[row[at]] == size
        g, at = g[whole], at[whole]
    says = plain[at + size] - plain[at] >= min(LITERALS, size)
    yield wa.mix(g[says] + np.uint64(size)), at[says]
    if names:
        return
    exact, at = wa.windows(words, scanned.hash, size)  # without names no words are merged
    if size < whole_below:
        exact, at = exact[whole], at[whole]
    if whole_below:
        first = np.cumsum(count) - count
        needed = ~says | (scanned.listed[at] & (at == first[row[at]]))
        exact, at = exact[needed], at[needed]
    yield wa.mix(exact + np.uint64(size) + EXACT), at


def _windows(sizes: list[int], whole_below: int, bitmap: np.ndarray | None, bits: int):
    """Windows of texts, with names and without; with ``whole_below`` a text of fewer words is one window of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = batch.column(0)
            for text in wa.slices(batch.column(1)):
                scanned = scan(text)
                for names in (True, False):
                    row, code, slot = template(scanned, names)
                    count = np.bincount(row, minlength=text.rows)
                    first = np.cumsum(count) - count
                    for size, g, at in ((n, *k) for n in sizes for k in _keys(scanned, names, row, code, slot, n, whole_below)):
                        if bitmap is not None:
                            low = (g & np.uint64((1 << bits) - 1)).astype(np.int64)
                            met = (bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                            g, at = g[met], at[met]
                        if not len(g):
                            continue
                        slots = slot[at[:, None] + np.arange(size)].view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [
                                carried.take(pa.array(row[at] + text.first)),
                                pa.array(np.full(len(g), names)),
                                pa.array(np.full(len(g), size, dtype=np.int32)),
                                pa.array((at - first[row[at]]).astype(np.int64)),
                                pa.array(g.view(np.int64)),
                                pa.ListArray.from_arrays(
                                    pa.array(np.arange(0, size * len(g) + 1, size, dtype=np.int32)), pa.array(slots.ravel())
                                ),
                            ],
                            ["row", "named", "size", "at", "window", "slots"],
                        )

    return run


def _bit_map(windows: DataFrame) -> tuple[np.ndarray, int]:
    bits = min(27, max(16, (windows.count() * 64).bit_length()))
    low = F.col("window").bitwiseAND((1 << bits) - 1)
    cells = windows.select(F.shiftright(low, 3).alias("byte"), F.pow(F.lit(2), low.bitwiseAND(7)).cast("int").alias("bit"))
    rows = cells.groupBy("byte").agg(F.bit_or("bit").cast("short").alias("value")).toArrow()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("value").to_numpy().astype(np.uint8)
    return out, bits


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: float = SHARE,
) -> DataFrame:
    """(doc_id, item_id, text_key, n_windows, item_windows, coverage) of contained items."""
    items = benchmark.select(F.struct(F.col(item_id).alias("item_id")).alias("row"), F.col(item_text).cast("string").alias("text"))
    row_type = items.schema["row"].dataType.simpleString()
    sizes = list(range(LITERALS, WIDTH + 1))
    read = items.mapInArrow(_windows(sizes, WIDTH, None, 0), f"row {row_type}, {_SCHEMA}")
    known = storage.materialize(
        read.select("row.item_id", "named", "size", F.col("at").alias("item_at"), "window", F.col("slots").alias("item_slots")),
        "benchmark_windows",
    )
    present = sorted(r[0] for r in known.select("size").distinct().collect())
    bitmap, bits = _bit_map(known)
    base = docs.select(
        F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("text_key")).alias("row"),
        F.col(text).cast("string").alias("text"),
    )
    row_type = base.schema["row"].dataType.simpleString()
    met = base.mapInArrow(_windows(present, 0, bitmap, bits), f"row {row_type}, {_SCHEMA}")
    met = met.select("row.doc_id", "row.text_key", "named", "size", "at", "window", "slots")
    joined = met.join(known, ["window", "size", "named"])
    placed = F.transform(
        F.arrays_zip("item_slots", "slots"), lambda s, i: F.struct((F.col("item_at") + i).alias("place"), s["item_slots"].alias("item_slots"), s["slots"].alias("slots"))
    )
    slots = F.filter(placed, lambda s: s["slots"] != 0)
    key = ["doc_id", "text_key", "item_id", "named"]
    last = F.col("item_at") + F.col("size") - 1
    offsets = joined.select(*key, (F.col("at") - F.col("item_at")).alias("offset"), "item_at", last.alias("last"), slots.alias("pairs"))
    offsets = offsets.groupBy(*key, "offset").agg(
        F.collect_set("item_at").alias("places"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
        F.min("item_at").alias("first"),
        F.max("last").alias("last"),
    )
    # A name at either edge of the match may run on outside it; numbers and units cannot.
    whole_run = lambda p: (p["slots"].bitwiseAND(1) == 0) | ((p["place"] > F.col("first")) & (p["place"] < F.col("last")))
    inner = F.transform(F.filter("pairs", whole_run), lambda p: F.struct(p["item_slots"].alias("item_slots"), p["slots"].alias("slots")))
    offsets = offsets.withColumn("pairs", F.array_distinct(inner))
    pairs = F.col("pairs")
    agree = (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["item_slots"])))) & (
        F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["slots"])))
    )
    places = offsets.filter(agree).select(*key, F.explode("places").alias("place"))
    covered = places.groupBy(*key).agg(F.countDistinct("place").alias("n_windows"))
    whole = known.groupBy("item_id", "named").agg(F.countDistinct("item_at").alias("item_windows"))
    best = F.max(F.struct((F.col("n_windows") / F.col("item_windows")).alias("coverage"), "n_windows", "item_windows")).alias("best")
    found = covered.join(whole, ["item_id", "named"]).groupBy("doc_id", "text_key", "item_id").agg(best)
    return found.select("doc_id", "text_key", "item_id", "best.n_windows", "best.item_windows", "best.coverage").filter(F.col("coverage") >= share)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, unchanged."""
    leaks = find_leaks(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("_leak"), F.col("text_key").alias("_key")).distinct()
    match = F.col("own_id").eqNullSafe(F.col("_leak")) & (F.col("own_key") == F.col("_key"))
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        F.col(doc_id).alias("own_id"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("own_key"),
    )
    return rows.join(leaks, match, "left_anti").select("row.*")

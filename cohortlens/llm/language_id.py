"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters count in lower case, all other characters as one blank. N-grams of one to three
characters are hashed into ``2 ** BITS`` features; a feature's value is its share of the
text's n-grams times its inverse document frequency, counted over all training rows.
Weights come from follow-the-regularised-leader with elastic-net penalties, on at most
``Settings.rows_per_class`` rows of each language, in shards of bounded size whose
weights are averaged; a temperature is fitted on sampled rows that were not trained on.
A score is a lookup per n-gram, so a text of any length costs memory for one slice only.

Edge cases: a null text or one without letters is ``und`` with score 0; rows without a
label are never trained on; without any labelled row every text is ``und``; repeated
rows are judged alike; an empty table gives an empty table; other columns are carried in
a struct.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import wordarrays as wa

BITS = 16
NONE = 1 << BITS  # the feature of n-grams that cross two texts
ORDERS = (1, 2, 3)
PARTS = 16
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@dataclass(frozen=True)
class Settings:
    """``rows_per_class`` bounds the fitted sample; a shard trains on about ``rows_per_shard``."""

    rows_per_class: int = 1_000
    rows_per_shard: int = 5_000
    calibration_share: float = 0.2
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 0.1
    l1: float = 0.02
    l2: float = 0.001
    seed: int = 5


_folded = np.full(0x110000, -1, dtype=np.int32)


def _letters(points: np.ndarray) -> np.ndarray:
    """Lower-case letters; a blank for everything else."""
    out = _folded[points]
    if (out < 0).any():
        for point in np.unique(points[out < 0]).tolist():
            c = chr(point)
            _folded[point] = ord(c.lower()[0]) if c.isalpha() else 32
        out = _folded[points]
    return out


def features(text: wa.Text) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature of each place for each order, where rows start, and whether rows have letters."""
    points = np.frombuffer(text.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    lead = (text.data & 0xC0) != 0x80
    starts = np.append(0, np.cumsum(lead))[text.offsets]
    chars = _letters(points)
    has = np.zeros(text.rows, dtype=bool)
    row_of = np.searchsorted(starts, np.flatnonzero(chars != 32), side="right") - 1
    has[row_of] = True
    c = chars.astype(np.uint32)
    n = len(c)
    out = []
    total = np.zeros(n, dtype=np.uint32)
    for k, order in enumerate(ORDERS):
        if n >= order:
            total[: n - k] += c[k:] * _FACTORS[k]
        h = total * np.uint32(0x2545F491) + np.uint32(order * 0x51ED270B)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        h = h.astype(np.int32)
        for back in range(1, order):  # places whose n-gram would leave the row
            edge = starts[1:] - back
            h[edge[(edge >= starts[:-1])]] = NONE
            h[n - back :] = NONE
        out.append(h)
    return out, starts, has


def _row_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums between row starts; empty rows have none."""
    rows = len(starts) - 1
    out = np.zeros((rows, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def _places(starts: np.ndarray) -> np.ndarray:
    """N-grams of all orders in each row."""
    n = np.diff(starts)
    return sum(np.maximum(n - (order - 1), 0) for order in ORDERS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows have each feature, and the rows, in parts of one task."""
    table, rows = np.zeros(NONE + 1, dtype=np.int64), 0
    seen = np.zeros(NONE + 1, dtype=np.uint8)
    for batch in batches:
        for text in wa.slices(batch.column(0)):
            hashed, starts, has = features(text)
            for r in np.flatnonzero(has):
                own = [h[starts[r] : starts[r + 1]] for h in hashed]
                for h in own:
                    seen[h] = 1
                table += seen
                for h in own:
                    seen[h] = 0
                rows += 1
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(PARTS), pa.int32()),
            pa.array([x.tobytes() for x in np.split(table[:NONE], PARTS)], pa.binary()),
            pa.array([rows] * PARTS, pa.int64()),
        ],
        ["part", "counts", "rows"],
    )


def _summed(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py(), dtype=np.int64) for x in group.column("counts")], axis=0)
    rows = int(np.sum(group.column("rows").to_numpy()))
    return pa.table(
        {
            "part": pa.array([group.column("part")[0].as_py()], pa.int32()),
            "counts": pa.array([total.tobytes()], pa.binary()),
            "rows": pa.array([rows], pa.int64()),
        }
    )


def inverse_frequencies(train: DataFrame) -> np.ndarray:
    """``ln((1 + rows) / (1 + df)) + 1`` for each feature, over all training rows."""
    parts = train.select("text").mapInArrow(_frequencies, "part int, counts binary, rows long")
    parts = parts.groupBy("part").applyInArrow(_summed, "part int, counts binary, rows long").collect()
    df, rows = np.zeros(NONE, dtype=np.float64), 0
    for p in parts:
        df[p.part * NONE // PARTS : (p.part + 1) * NONE // PARTS] = np.frombuffer(p.counts, dtype=np.int64)
        rows = p.rows
    return np.append(np.log((1 + rows) / (1 + df)) + 1, 0.0)


def vectors(text: wa.Text, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse TF-IDF of each row."""
    hashed, starts, _ = features(text)
    places = _places(starts)
    for r in range(text.rows):
        own = np.concatenate([h[starts[r] : starts[r + 1]] for h in hashed])
        own, count = np.unique(own[own != NONE], return_counts=True)
        yield own, count / max(int(places[r]), 1) * idf[own]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, s: Settings) -> np.ndarray:
    """Weights (feature, class) after ``epochs`` passes in a fixed shuffled order."""
    z = np.zeros((NONE + 1, classes))
    n = np.zeros((NONE + 1, classes))
    rng = np.random.default_rng(s.seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2)
        w[np.abs(zi) <= s.l1] = 0.0
        return w

    for _ in range(s.epochs):
        for r in rng.permutation(len(rows)):
            i, x = rows[r]
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[r]] -= 1
            g = x[:, None] * p[None, :]
            grown = ni + g * g
            z[i] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / s.alpha * w
            n[i] = grown
    return weights(z, n)


def _train(idf: np.ndarray, names: list[str], s: Settings):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("lang", "ascending"), ("text", "ascending")])
        rows = []
        for chunk in group.column("text").chunks:
            for text in wa.slices(chunk):
                rows += list(vectors(text, idf))
        labels = np.array([names.index(x) for x in group.column("lang").to_pylist()])
        # One scale for all rows, so that vectors have about unit length.
        scale = 1 / max(float(np.mean([np.sqrt((x * x).sum()) for _, x in rows])), 1e-12)
        w = ftrl([(i, x * scale) for i, x in rows], labels, len(names), s) * scale
        return pa.table({"rows": pa.array([len(rows)], pa.int64()), "weights": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    return run


def _scores(text: wa.Text, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class scores of each row, and whether it has letters."""
    hashed, starts, has = features(text)
    total = sum(_row_sum(weights[h], starts) for h in hashed)
    return total / np.maximum(_places(starts), 1)[:, None], has


@dataclass(frozen=True)
class Model:
    names: list[str]
    weights: np.ndarray  # (feature, class), inverse document frequencies included
    temperature: float


def _logits(weights: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [_scores(text, weights)[0] for text in wa.slices(batch.column(0))]
            if scores:
                rows = np.concatenate(scores)
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), batch.column(1)], ["logits", "lang"])

    return run


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which the labels are likeliest, by golden section.

    A label counts as right with odds of (rows + 1) to 1, so that a sample without errors
    does not make the model certain.
    """
    doubt = 1.0 / (len(labels) + 2)

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        own = x[np.arange(len(x)), labels]
        rest = (x.sum(axis=1) - own) / max(x.shape[1] - 1, 1)
        return float((np.log(np.exp(x).sum(axis=1)) - (1 - doubt) * own - doubt * rest).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(train: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learn from rows (text, lang, key), ``key`` a hash that draws the sample."""
    s = settings
    labelled = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    names = sorted(per)
    idf = inverse_frequencies(labelled)
    span = 1 << 30
    draw = F.pmod("key", F.lit(span))
    bound = F.lit(0)
    for name in names:
        bound = F.when(F.col("lang") == name, int(span * min(1.0, s.rows_per_class / per[name]))).otherwise(bound)
    sample = labelled.filter(draw < bound)
    held = F.pmod(F.xxhash64(F.lit(s.seed), "key"), F.lit(1000)) < int(1000 * s.calibration_share)
    shards = max(1, sum(min(n, s.rows_per_class) for n in per.values()) // s.rows_per_shard)
    taught = sample.filter(~held).select("text", "lang", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    trained = taught.groupBy("shard").applyInArrow(_train(idf, names, s), "rows long, weights binary")
    total, rows = np.zeros((NONE + 1, len(names))), 0
    for r in trained.toLocalIterator():
        total += np.frombuffer(r.weights, dtype=np.float32).reshape(NONE + 1, len(names)) * float(r.rows)
        rows += r.rows
    weights = (total / max(rows, 1) * idf[:, None]).astype(np.float32)
    checked = sample.filter(held).select("text", "lang").mapInArrow(_logits(weights, names), "logits array<double>, lang string").toArrow()
    temperature = 1.0
    if checked.num_rows:
        logits = np.array(checked.column("logits").to_pylist())
        temperature = _temperature(logits, np.array([names.index(x) for x in checked.column("lang").to_pylist()]))
    return Model(names, weights, temperature)


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: Sequence[str | Column] = ("doc_id",)) -> DataFrame:
    """Struct ``row`` of kept columns, ``lang_pred`` and ``score``."""
    columns = [F.col(c) if isinstance(c, str) else c for c in keep]
    base = docs.select(F.col(text).cast("string").alias("text"), F.struct(*columns).alias("row"))
    if model is None:
        return base.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names, weights, temperature = np.array(model.names), model.weights, model.temperature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, sure = [], []
            for piece in wa.slices(batch.column(0)):
                logits, has = _scores(piece, weights)
                logits = logits / temperature
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                chosen += np.where(has, names[p.argmax(axis=1)], UNKNOWN).tolist()
                sure += np.where(has, p.max(axis=1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(chosen, pa.string()), pa.array(sure, pa.float64())], ["row", "lang_pred", "score"]
            )

    row_type = base.schema["row"].dataType.simpleString()
    return base.mapInArrow(run, f"row {row_type}, lang_pred string, score double")

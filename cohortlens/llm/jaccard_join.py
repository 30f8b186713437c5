"""N-gram Jaccard join: documents linked by their sets of word shingles, and their classes.

A document's set holds its distinct windows of five words (A-Z as a-z); a shorter text
is one window. Two documents link when their sets' Jaccard similarity reaches a
threshold. The join is exact: every link between different sets is found or already
implied by verified links, and equal sets are one point.

Method. Shingles are hashed into groups, one for every one or two shingles of the set and
``GROUPS`` at least, and a set is the point of its group counts. Two sets share at most
the sum of coordinate minima, which bounds their similarity; neighbouring groups of the
finer point are added up where two points differ in their number. Points of random texts lie close together in such a space, so one tree over
all points would be scanned whole by every search; the index therefore has two levels.
Its roots are single shingles in a common order, rarest first by a table of counts: linked
sets share one of their first ``n - ceil(t n) + 1`` shingles, so they meet below a root.
Below each root stands a packed R-tree over the points, in ``GROUPS`` groups (leaves sorted
by set size and counts, boxes with the largest counts and smallest set of their points),
joined with itself; pairs that the bound lets pass there and in all groups of the points
are verified on the sets.

Large groups. Copies are one point. Below a root the first round asks only for a tree of
the likeliest links of each leaf; the second round asks for pairs whose classes still
differ, so a group of near copies costs about one check per member and root, not all
pairs. A root of more than ``TILE`` points is cut into tiles whose pairs are separate
roots. Nothing but the table of counts (16 MB) and a bit map of ids (at most 16 MB) is
sent to executors; classes come from rounds of star contraction over the links.

Points are told apart by 64 bits: of n different sets, two fall together with a chance
of n^2 / 2^65. Edge cases: a null or blank text has an empty set and links with nothing;
null and repeated doc_ids are allowed, and a class without any doc_id has a null
component_id; an empty table gives an empty table; other columns are carried in a struct.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import storage
from cohortlens.llm import wordarrays as wa
from cohortlens.llm.mixing import row_hash

WORDS = 5
GROUPS = 256
MOST_BITS = 20  # of the number of groups
FULL = 65_535  # a larger count makes the whole point pass the bound
FULL_FINE = 255
SKETCH_BITS = 22
SKETCH_PARTS = 64
POSTINGS_PER_PART = 1 << 20
FLUSH = 1 << 22
TILE = 100_000
LEAF = 64
ROWS_PER_BUCKET = 20_000

_POINT = "part int, n long, id long, check long, counts binary"
_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(text: wa.Text, size: int = WORDS) -> Iterator[np.ndarray]:
    """For each row its distinct shingle hashes, sorted."""
    words = wa.spaced_words(text)
    h = wa.hashes(text.data, words.start, words.end)
    g, at = wa.windows(words, h, size)
    rows = words.row[at] if len(at) else at
    edges = np.searchsorted(rows, np.arange(text.rows + 1))
    first = np.cumsum(words.count) - words.count
    for r in range(text.rows):
        n = int(words.count[r])
        if n >= size:
            own = np.sort(g[edges[r] : edges[r + 1]])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif n:
            own = h[first[r] : first[r] + n]
            total = (own * wa.powers(n)).sum(dtype=np.uint64, keepdims=True) + np.full(1, n, dtype=np.uint64) * _SALT
            yield wa.mix(total)
        else:
            yield g[:0]


def _identity(own: np.ndarray) -> tuple[int, int]:
    a = wa.mix(wa.mix(own ^ _SALT).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
    b = wa.mix(own + _SALT).sum(dtype=np.uint64, keepdims=True)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _counts(own: np.ndarray) -> np.ndarray:
    """How many shingles fall in each group, by the first bits of the shingles."""
    bits = min(MOST_BITS, max(GROUPS.bit_length() - 1, (len(own) // 2).bit_length()))
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return (counts if counts.max() < FULL_FINE else np.full(1 << bits, FULL_FINE)).astype(np.uint8)


def _coarse(fine: np.ndarray) -> np.ndarray:
    """The same point in ``GROUPS`` groups."""
    counts = fine.reshape(GROUPS, -1).sum(axis=1, dtype=np.int64)
    full = fine[0] == FULL_FINE or counts.max() >= FULL
    return (np.full(GROUPS, FULL) if full else counts).astype(np.uint16)


def _passes_finely(x: np.ndarray, y: np.ndarray, total: int, percent: int) -> bool:
    """Whether the bound lets a pair pass in as many groups as both points have."""
    if len(x) == len(y) == GROUPS or x[0] == FULL_FINE or y[0] == FULL_FINE:
        return True
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = y.reshape(len(x), -1).sum(axis=1, dtype=np.uint32)
    return int(np.minimum(x, y).sum(dtype=np.int64)) * (100 + percent) >= percent * total


def _slot(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(20)) & np.uint64((1 << SKETCH_BITS) - 1)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of points (part -1), carried columns beside them, and parts of the table of counts."""
    table = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    schema, seen, held = None, [], 0

    def tally() -> None:
        nonlocal held
        if seen:
            table[:] += np.bincount(np.concatenate(seen).astype(np.int64), minlength=len(table))
        seen.clear()
        held = 0

    for batch in batches:
        n, ids, checks, counts = [], [], [], []
        for text in wa.slices(_column(batch, "text")):
            for own in shingle_sets(text):
                n.append(len(own))
                if len(own):
                    a, b = _identity(own)
                    seen.append(_slot(own))
                    held += len(own)
                    counts.append(_counts(own).tobytes())
                else:
                    a, b = 0, 0
                    counts.append(None)
                ids.append(a)
                checks.append(b)
            if held > 1 << 20:
                tally()
        row = _column(batch, "row")
        schema = row.type
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(n), -1, dtype=np.int32)),
                pa.array(n, pa.int64()),
                pa.array(ids, pa.int64()),
                pa.array(checks, pa.int64()),
                pa.array(counts, pa.binary()),
                row,
            ],
            ["part", "n", "id", "check", "counts", "row"],
        )
    if schema is not None:
        tally()
        pieces = np.split(np.minimum(table, 2**31 - 1).astype(np.int32), SKETCH_PARTS)
        none = pa.nulls(SKETCH_PARTS, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)),
                none,
                none,
                none,
                pa.array([zlib.compress(p.tobytes(), 1) for p in pieces], pa.binary()),
                pa.nulls(SKETCH_PARTS, schema),
            ],
            ["part", "n", "id", "check", "counts", "row"],
        )


def _summed(group: pa.Table) -> pa.Table:
    """One part of the table of counts, over all tasks."""
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, dtype=np.int64)
    for piece in group.column("counts"):
        total += np.frombuffer(zlib.decompress(piece.as_py()), dtype=np.int32)
    total = np.minimum(total, 2**31 - 1).astype(np.int32)
    return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def prefix(own: np.ndarray, table: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The rarest ``n - ceil(t n) + 1`` shingles in the common order, with their counts."""
    n = len(own)
    keep = n - -(-percent * n // 100) + 1
    often = table[_slot(own)]
    order = np.argsort((often.astype(np.uint64) << np.uint64(32)) | (own >> np.uint64(32)), kind="stable")[:keep]
    return own[order], often[order]


def _tiled(own: np.ndarray, often: np.ndarray, point: int) -> np.ndarray:
    """Roots for a point: a shingle, or all tile pairs of one that too many points hold."""
    hot = often > TILE
    if not hot.any():
        return own
    out = [own[~hot]]
    for shingle, count in zip(own[hot], often[hot]):
        tiles = -(-int(count) // TILE)
        mine = int(wa.mix(np.array([point], dtype=np.int64).view(np.uint64))[0] % np.uint64(tiles))
        other = np.arange(tiles, dtype=np.uint64)
        low, high = np.minimum(other, np.uint64(mine)), np.maximum(other, np.uint64(mine))
        out.append(wa.mix(shingle ^ (low * np.uint64(0x1000003D) + high * wa.PRIME + np.uint64(1))))
    return np.concatenate(out)


def _postings(table: np.ndarray, parts: int, percent: int):
    def emit(roots: list[np.ndarray], points: list[int], sizes: list[int]) -> pa.RecordBatch:
        h = np.concatenate(roots)
        ids = np.repeat(np.array(points, dtype=np.int64), sizes)
        part = ((h >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        h, ids, part = h[order], ids[order], part[order]
        own = np.unique(part)
        edges = np.append(np.searchsorted(part, own), len(part))
        cut = list(zip(edges[:-1], edges[1:]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(own),
                pa.array([h[a:b].tobytes() for a, b in cut], pa.binary()),
                pa.array([ids[a:b].tobytes() for a, b in cut], pa.binary()),
            ],
            ["part", "roots", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, points, sizes, held, known = [], [], [], 0, set()
        for batch in batches:
            for text in wa.slices(_column(batch, "text")):
                for own in shingle_sets(text):
                    if not len(own):
                        continue
                    point = _identity(own)[0]
                    if point in known:
                        continue
                    known.add(point)
                    mine = _tiled(*prefix(own, table, percent), point)
                    roots.append(mine)
                    points.append(point)
                    sizes.append(len(mine))
                    held += len(mine)
                    if held >= FLUSH:
                        yield emit(roots, points, sizes)
                        roots, points, sizes, held = [], [], [], 0
        if held:
            yield emit(roots, points, sizes)

    return run


def _lists(group: pa.Table) -> pa.Table:
    """Points that share a root, for each different set of them once."""
    h = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in group.column("roots")])
    ids = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in group.column("ids")])
    order = np.argsort(h)
    h, ids = h[order], ids[order]
    same = np.empty(len(h), dtype=bool)
    same[:-1] = h[1:] == h[:-1]
    same[-1:] = False
    shared = same.copy()
    shared[1:] |= same[:-1]
    h, ids = h[shared], ids[shared]
    keys, members = [], []
    if len(h):
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        fresh = np.append(True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]))
        h, ids = h[fresh], ids[fresh]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        length = np.diff(np.append(first, len(h)))
        digest = np.add.reduceat(wa.mix(ids.view(np.uint64)), first) + length.astype(np.uint64)
        digest = wa.mix(digest).view(np.int64)
        _, chosen = np.unique(digest, return_index=True)
        chosen = chosen[length[chosen] > 1]
        take = np.zeros(len(first), dtype=bool)
        take[chosen] = True
        wide = np.repeat(take, length)
        keys, members = np.repeat(digest, length)[wide], ids[wide]
    return pa.table({"root": pa.array(keys, pa.int64()), "id": pa.array(members, pa.int64())})


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[b] = a
        return a != b


def _passing(
    counts: np.ndarray, n: np.ndarray, fine: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int,
    wanted: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Wanted pairs of two leaves that the bound lets pass, and how well."""
    bound = np.minimum(counts[a][:, None, :], counts[b][None, :, :]).sum(axis=2, dtype=np.int64)
    bound[(counts[a][:, 0] == FULL)[:, None] | (counts[b][:, 0] == FULL)[None, :]] = 1 << 40
    total = n[a][:, None] + n[b][None, :]
    near = bound * (100 + percent) >= percent * total
    i, j = np.nonzero(near if wanted is None else near & wanted)
    keep = np.array([_passes_finely(fine[x], fine[y], t, percent) for x, y, t in zip(a[i], b[j], total[i, j].tolist())], dtype=bool)
    i, j = i[keep], j[keep]
    return a[i], b[j], bound[i, j] / total[i, j]


def _leaves(counts: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """A packed order: by set size in strips, then by the counts of the widest group."""
    order = np.lexsort((counts[:, np.argmax(np.ptp(counts, axis=0))], n))
    return [order[i : i + LEAF] for i in range(0, len(order), LEAF)]


def tree_pairs(fine: list[np.ndarray], n: np.ndarray, label: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs below one root to verify: a likely tree, or with ``label`` all that still matter."""
    counts = np.array([_coarse(x) for x in fine])
    leaves = _leaves(counts, n)
    out = []
    if label is None:
        forest = _Forest(len(n))
        heads = [x[:1] for x in leaves]
        blocks = [(x, x) for x in leaves] + [(a, b) for a, b in zip(heads, heads[1:])]
        for a, b in blocks:
            i, j, score = _passing(counts, n, fine, a, b, percent, a[:, None] < b[None, :] if a is b else a[:, None] != b[None, :])
            for k in np.argsort(-score, kind="stable"):
                if forest.join(int(i[k]), int(j[k])):
                    out.append((int(i[k]), int(j[k])))
        return out
    top = np.array([counts[x].max(axis=0) for x in leaves])
    least, most = np.array([n[x].min() for x in leaves]), np.array([n[x].max() for x in leaves])
    alone = np.array([label[x[0]] if len(set(label[x].tolist())) == 1 else 0 for x in leaves])
    for p, a in enumerate(leaves):
        # Boxes: the largest counts of both bound what any two of their points share.
        shared = np.where((top[p, 0] == FULL) | (top[p:, 0] == FULL), 1 << 40, 0) + np.minimum(top[p], top[p:]).sum(axis=1, dtype=np.int64)
        near = (shared * (100 + percent) >= percent * (least[p] + least[p:])) & (percent * least[p:] <= 100 * most[p])
        near &= (alone[p:] == 0) | (alone[p:] != alone[p])
        for q in np.flatnonzero(near) + p:
            b = leaves[q]
            open_pairs = label[a][:, None] != label[b][None, :]
            if q == p:
                open_pairs &= a[:, None] < b[None, :]
            i, j, _ = _passing(counts, n, fine, a, b, percent, open_pairs)
            out += zip(i.tolist(), j.tolist())
    return out


def _candidates(percent: int, labelled: bool):
    def run(group: pa.Table) -> pa.Table:
        root = group.column("root").to_numpy()
        order = np.argsort(root, kind="stable")
        root = root[order]
        ids, n = group.column("id").to_numpy()[order], group.column("n").to_numpy()[order]
        label = group.column("label").to_numpy()[order] if labelled else None
        vectors = [np.frombuffer(group.column("counts")[int(i)].as_py(), dtype=np.uint8) for i in order]
        first = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
        a, b = [], []
        for s, e in zip(first, np.append(first[1:], len(root))):
            if labelled and (label[s:e] == label[s]).all():
                continue
            for i, j in tree_pairs(vectors[s:e], n[s:e], label[s:e] if labelled else None, percent):
                x, y = ids[s + i], ids[s + j]
                a.append(min(x, y))
                b.append(max(x, y))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _column(batch, "set_a"), _column(batch, "set_b")
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(a[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(b[i].as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                place = np.searchsorted(y, x)
                place[place == len(y)] = 0
                shared = int((y[place] == x).sum())
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([_column(batch, "a"), _column(batch, "b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _sets_of(bitmap: np.ndarray, bits: int):
    """Sets of the points in the bit map, once a task. False hits cost work only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            ids, sets = [], []
            for text in wa.slices(_column(batch, "text")):
                for own in shingle_sets(text):
                    if not len(own):
                        continue
                    point = _identity(own)[0]
                    at = point & ((1 << bits) - 1)
                    if point in known or not (int(bitmap[at >> 3]) >> (at & 7)) & 1:
                        continue
                    known.add(point)
                    ids.append(point)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def _bit_map(ids: DataFrame) -> tuple[np.ndarray, int]:
    """Low bits of ids, at least sixteen bits of map for one id, 16 MB at most."""
    bits = min(27, max(16, (ids.count() * 16).bit_length()))
    at = F.col("id").bitwiseAND((1 << bits) - 1)
    bytes_ = ids.select(F.shiftright(at, 3).alias("byte"), F.pow(F.lit(2), at.bitwiseAND(7)).cast("int").alias("bit"))
    rows = bytes_.groupBy("byte").agg(F.bit_or("bit").cast("short").alias("value")).toArrow()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("value").to_numpy().astype(np.uint8)
    return out, bits


def classes(links: DataFrame, name: str = "classes") -> DataFrame:
    """(id, label) for every linked id: the smallest id that links reach.

    Star contraction: neighbours above a node move to the smallest neighbour, then
    neighbours below it do, until nothing moves.
    """
    edges = storage.materialize(links.select("a", "b").distinct(), f"{name}_0")
    before, turn = None, 0
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("label"))
        before, turn = state, turn + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u")
        small = (
            large.join(least, F.col("b") == F.col("u"))
            .select(F.explode(F.array(F.struct("m", F.col("a").alias("v")), F.struct("m", F.col("b").alias("v")))).alias("e"))
            .select(F.col("e.m").alias("a"), F.col("e.v").alias("b"))
            .filter("a < b")
            .distinct()
        )
        edges = storage.materialize(small, f"{name}_{turn}")


def link_classes(
    docs: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Struct ``row`` of kept columns, ``n_shingles``, ``component_id`` (a doc_id) and ``class`` for each row."""
    spark = docs.sparkSession
    carried = F.struct(F.col(doc_id).alias("own_id"), F.struct(*[F.col(c) for c in keep or [doc_id]]).alias("kept"))
    base = docs.select(carried.alias("row"), F.col(text).cast("string").alias("text"))
    row_type = base.schema["row"].dataType.simpleString()
    written = base.mapInArrow(_points, f"{_POINT}, row {row_type}")
    written = storage.materialize(written, "jaccard_points")
    points = written.filter("part < 0").drop("part")
    some = points.filter("n > 0")

    summed = written.filter("part >= 0").select("part", "counts").groupBy("part").applyInArrow(_summed, "part int, counts binary")
    table = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    for piece in summed.collect():
        size = len(table) // SKETCH_PARTS
        table[piece.part * size : (piece.part + 1) * size] = np.frombuffer(piece.counts, dtype=np.int32)
    shingles = some.agg(F.sum("n")).first()[0] or 0
    parts = max(16, shingles * (100 - percent) // 100 // POSTINGS_PER_PART + 1)
    postings = base.select("text").mapInArrow(_postings(table, parts, percent), "part int, roots binary, ids binary")
    lists = postings.groupBy("part").applyInArrow(_lists, "root long, id long").distinct()
    vectors = some.dropDuplicates(["id"]).select("id", "n", "counts")
    listed = storage.materialize(lists.join(vectors, "id"), "jaccard_lists")
    buckets = max(16, listed.count() // ROWS_PER_BUCKET)
    listed = listed.withColumn("bucket", F.pmod("root", F.lit(buckets)))

    def links(rows: DataFrame, labelled: bool, turn: int) -> DataFrame:
        pairs = rows.groupBy("bucket").applyInArrow(_candidates(percent, labelled), "a long, b long").distinct()
        pairs = storage.materialize(pairs, f"jaccard_pairs_{turn}")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets = base.select("text").mapInArrow(_sets_of(*_bit_map(ids)), "id long, set binary")
        sets = storage.materialize(sets.dropDuplicates(["id"]), f"jaccard_sets_{turn}")
        first = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        both = first.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        checked = both.select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long")
        return storage.materialize(checked, f"jaccard_links_{turn}")

    likely = links(listed, False, 1)
    label = classes(likely, "jaccard_classes_1")
    rest = listed.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    more = links(rest, True, 2)
    label = classes(likely.unionByName(more), "jaccard_classes_2")

    owned = points.join(label, "id", "left").withColumn("class", F.coalesce("label", "id"))
    # Written first, so that the join below can split a class that very many rows belong to.
    least = storage.materialize(owned.filter("n > 0").groupBy("class").agg(F.min("row.own_id").alias("least_id")), "jaccard_least")
    owned = owned.withColumn("class", F.when(F.col("n") > 0, F.col("class"))).join(least, "class", "left")
    return owned.select(
        F.col("row.kept").alias("row"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least_id")).otherwise(F.col("row.own_id")).alias("component_id"),
        "class",
    )


def keep_one(docs: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each class the row with the smallest doc_id (then text hash, then row hash), unchanged; all rows without words."""
    own_id = F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))
    key = F.xxhash64(F.col(text))
    small = docs.select(own_id.alias("own_id"), key.alias("own_key"), F.col(text).alias("text"))
    linked = link_classes(small, percent, "own_id", "text", ["own_id", "own_key"])
    first = F.min(F.struct("row.own_id", "row.own_key")).alias("w")
    winners = linked.filter(F.col("class").isNotNull()).groupBy("class").agg(first)
    winners = winners.select(F.col("w.own_id").alias("own_id"), F.col("w.own_key").alias("own_key")).distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), own_id.alias("own_id"), key.alias("own_key"), F.col(text).alias("text"), row_hash(docs).alias("own_tie"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = rows.filter(worded).drop("text").join(winners, ["own_id", "own_key"])
    same = Window.partitionBy("own_id", "own_key").orderBy("own_tie")
    kept = kept.withColumn("nth", F.row_number().over(same)).filter("nth = 1").select("row.*")
    return kept.unionByName(rows.filter(~worded).select("row.*"))

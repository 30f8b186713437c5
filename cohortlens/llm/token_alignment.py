"""Alignment of two tokenizers by byte ranges, with a fast path for tokens of the same bytes.

A text is encoded twice: with a leading space by a byte-level vocabulary (A), and by a
piece vocabulary that adds the space itself (B). Offsets at which tokens of both end cut
the tokens into groups, and every pair of tokens whose bytes overlap is a link. An array
maps each A id to the B id of the same bytes. A group of one such pair is counted in a
vector as long as the vocabulary; only the links of other groups are shuffled as pairs.

First pass: a task cuts texts at single spaces between visible characters, which no token of either
vocabulary crosses, aligns each different chunk once, and writes blocks of documents: the
chunks of each document, and the links of each chunk. Vectors and pairs are then summed
over all blocks. Second pass: a block asks for the counts of its different pairs, once
each, and adds them up per document. So a block asks for a frequent pair once, however
often it occurs, and texts are encoded once.

Edge cases: texts that are null or empty, or that one of the vocabularies does not give
back byte by byte, have no tokens; special strings are plain text; a text of any length
is a block of its own if it is longer than one; rows with a repeated or null doc_id are
documents of their own; an empty table gives an empty table; other columns are left alone.
Ties for the highest count of a B id are all best.

To the driver goes one row per A id at most, the vector of counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import storage
from cohortlens.llm import wordarrays as wa
from cohortlens.llm.token_counts import _byte_letters

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
BLOCK_BYTES = 2 << 20
KNOWN = 100_000
AT_ONCE = 10_000  # chunks that are encoded together
# A single space between visible characters is where texts may be cut; this finds all other spaces.
UNSAFE = re.compile(r"\A | \Z| \s|\s ")


class Links:
    """Arrays that grow: per chunk tokens, groups and links, per link its pair."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, dtype=np.int64)
        self.n_a = self.n_b = self.n_groups = none
        self.bad = np.zeros(0, dtype=bool)
        self.start = np.zeros(1, dtype=np.int64)  # of the links of each chunk
        self.pair = none
        self.exact = np.zeros(0, dtype=bool)
        self.shown: list[bytes] = []

    def add(self, n_a, n_b, n_groups, bad, n_links, pair, exact, shown) -> None:
        self.n_a, self.n_b = np.append(self.n_a, n_a), np.append(self.n_b, n_b)
        self.n_groups, self.bad = np.append(self.n_groups, n_groups), np.append(self.bad, bad)
        self.start = np.append(self.start, self.start[-1] + np.cumsum(n_links))
        self.pair, self.exact = np.append(self.pair, pair), np.append(self.exact, exact)
        self.shown += shown


class Aligner:
    """Both vocabularies, the map of equal tokens, and the chunks aligned so far."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte_of = {letter: byte for byte, letter in enumerate(_byte_letters())}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.size_a, self.size_b = 1 + max(self.a.get_vocab().values()), self.b.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token if c in byte_of)
        self.bytes_b = [b""] * self.size_b
        for i in range(self.size_b):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b[i] = bytes([int(piece[3:5], 16)])
            elif not (self.b.is_control(i) or self.b.is_unknown(i)):
                self.bytes_b[i] = piece.replace("▁", " ").encode()
        self.width_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.width_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.table_a, self.table_b = (np.frombuffer(b"".join(x), dtype=np.uint8) for x in (self.bytes_a, self.bytes_b))
        self.first_a, self.first_b = np.cumsum(self.width_a) - self.width_a, np.cumsum(self.width_b) - self.width_b
        order = sorted(range(self.size_b), key=self.b.is_byte, reverse=True)  # pieces stand above bytes
        known = {self.bytes_b[i]: i for i in order if self.bytes_b[i]}
        self.same = np.array([known.get(x, -1) for x in self.bytes_a], dtype=np.int64)
        self.same_shown = np.array([f"{i}|{j}" for i, j in enumerate(self.same.tolist())], dtype=object)
        # Texts are cut before a space, so no piece may hold a space after something else.
        inner = re.compile(r"[^▁]▁")
        self.may_cut = not any(inner.search(self.b.id_to_piece(i)) for i in range(self.size_b))
        self.links = Links()
        self.index: dict[str, int] = {}

    def align(self, chunks: list[str], into: Links) -> None:
        """Encode chunks, each led by a space, and add their groups and links."""
        encoded_a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        encoded_b = self.b.encode(chunks, num_threads=1)
        bad = self._bad(chunks, encoded_a, encoded_b)
        for i in np.flatnonzero(bad).tolist():
            encoded_a[i], encoded_b[i] = [], []
        n_a = np.array([len(x) for x in encoded_a], dtype=np.int64)
        n_b = np.array([len(y) for y in encoded_b], dtype=np.int64)
        a = np.fromiter(chain.from_iterable(encoded_a), dtype=np.int64, count=int(n_a.sum()))
        b = np.fromiter(chain.from_iterable(encoded_b), dtype=np.int64, count=int(n_b.sum()))
        # All chunks lie end to end: where tokens end, and where tokens of both end.
        end_a, end_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        size_a, size_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        # Between two neighbouring ends there is one token of each: that is one link.
        ends = np.union1d(end_a, end_b)
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pair = a[link_a] * self.size_b + b[link_b]
        group = np.searchsorted(both, ends)
        exact = (size_a[group] == 1) & (size_b[group] == 1) & (self.same[a[link_a]] == b[link_b])
        chunk_of_a = np.repeat(np.arange(len(chunks)), n_a)
        chunk_of_group = chunk_of_a[np.searchsorted(end_a, both)]
        n_groups = np.bincount(chunk_of_group, minlength=len(chunks))
        n_links = np.bincount(chunk_of_a[link_a], minlength=len(chunks))
        # The text of a group, then of a chunk; equal tokens have theirs at hand.
        groups = np.empty(len(both), dtype=object)
        groups[group[exact]] = self.same_shown[a[link_a[exact]]]
        rest = np.ones(len(both), dtype=bool)
        rest[group[exact]] = False
        after_a, after_b = np.cumsum(size_a), np.cumsum(size_b)
        rest = np.flatnonzero(rest)
        sides = [(after_a[rest] - size_a[rest], after_a[rest], a), (after_b[rest] - size_b[rest], after_b[rest], b)]
        texts = []
        for low, high, ids in sides:
            shown_ids = list(map(str, ids[_ragged(low, high - low)].tolist()))
            at = [0, *np.cumsum(high - low).tolist()]
            texts.append([",".join(shown_ids[i:j]) for i, j in zip(at, at[1:])])
        groups[rest] = [f"{x}|{y}" for x, y in zip(*texts)]
        groups = groups.tolist()
        at = [0, *np.cumsum(n_groups).tolist()]
        shown = [";".join(groups[i:j]).encode() for i, j in zip(at, at[1:])]
        into.add(n_a, n_b, n_groups, bad, n_links, pair, exact, shown)

    def _bad(self, chunks: list[str], encoded_a: list[list[int]], encoded_b: list[list[int]]) -> np.ndarray:
        """Chunks that one of the vocabularies does not give back byte by byte."""
        whole = [b" " + c.encode() for c in chunks]
        size = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        bad = np.zeros(len(chunks), dtype=bool)
        for encoded, width, table, first in (
            (encoded_a, self.width_a, self.table_a, self.first_a),
            (encoded_b, self.width_b, self.table_b, self.first_b),
        ):
            n = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
            ids = np.fromiter(chain.from_iterable(encoded), dtype=np.int64, count=int(n.sum()))
            wrong = _sums(width[ids], n) != size
            if wrong.any():
                bad |= wrong
            good = ~wrong
            kept = ids[np.repeat(good, n)]
            made = table[_ragged(first[kept], width[kept])]
            want = np.frombuffer(b"".join(compress(whole, good.tolist())), dtype=np.uint8)
            if not np.array_equal(made, want):
                place = np.repeat(np.flatnonzero(good), size[good])
                bad[place[made != want]] = True
        return bad

    def chunks(self, text: str) -> list[str]:
        """Parts of a text without the space that leads each of them; none of them for an empty text."""
        if not text:
            return []
        if not self.may_cut:
            return [text]
        parts = text.split(" ")
        if UNSAFE.search(text) is None:
            return parts
        out = [parts[0]]
        for part in parts[1:]:
            if part and not part[0].isspace() and out[-1] and not out[-1][-1].isspace():
                out.append(part)
            else:
                out[-1] += " " + part
        return out

    def codes(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """Chunk numbers of all texts end to end, and how many each text has."""
        if len(self.index) > KNOWN:
            self.index.clear()
            self.links.clear()
        parts = [self.chunks(t) for t in texts]
        fresh = list(dict.fromkeys(c for p in parts for c in p if c not in self.index))
        if fresh:
            first = len(self.index)
            self.index.update(zip(fresh, range(first, first + len(fresh))))
            for at in range(0, len(fresh), AT_ONCE):
                self.align(fresh[at : at + AT_ONCE], self.links)
        index = self.index
        return [index[c] for p in parts for c in p], np.array([len(p) for p in parts], dtype=np.int64)


@cache
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each row, end to end."""
    end = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(start - end + size, size)


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    end = np.cumsum(size)
    return total[end] - total[end - size]


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(pa.py_buffer(np.ascontiguousarray(values, dtype="<i4")), codec="zstd", asbytes=True)


def _unpack(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, 4 * n, codec="zstd"), dtype="<i4")


def _block(texts: list[str], known: Aligner) -> dict:
    """Documents as local chunk numbers, chunks as links; a link is a local pair, or an exact A id below zero."""
    codes, n_chunks = known.codes(texts)
    codes = np.array(codes, dtype=np.int64)
    links = known.links
    doc = np.repeat(np.arange(len(texts)), n_chunks)
    failed = np.bincount(doc, weights=links.bad[codes], minlength=len(texts)) > 0
    own = Links()
    if failed.any():
        # What does not come back chunk by chunk is tried as a whole.
        whole = np.flatnonzero(failed)
        known.align([texts[i] for i in whole.tolist()], own)
        keep = ~failed[doc]
        codes, doc, n_chunks = codes[keep], doc[keep], np.where(failed, 0, n_chunks)
        good = whole[~own.bad]
        places = np.searchsorted(doc, good)
        codes = np.insert(codes, places, len(links.bad) + np.flatnonzero(~own.bad))
        n_chunks[good] = 1
    used, local = np.unique(codes, return_inverse=True)
    theirs = used < len(links.bad)
    sets = [(links, used[theirs]), (own, used[~theirs] - len(links.bad))]
    cat = lambda f: np.concatenate([f(s, u) for s, u in sets])
    size = cat(lambda s, u: s.start[u + 1] - s.start[u])
    pair = cat(lambda s, u: s.pair[_ragged(s.start[u], s.start[u + 1] - s.start[u])])
    exact = cat(lambda s, u: s.exact[_ragged(s.start[u], s.start[u + 1] - s.start[u])])
    shown = [s.shown[i] for s, u in sets for i in u.tolist()]
    times = np.bincount(local, minlength=len(used))
    per_link = np.repeat(times, size)
    vector = np.bincount(pair[exact] // known.size_b, weights=per_link[exact], minlength=known.size_a).astype(np.int64)
    pairs, place = np.unique(pair[~exact], return_inverse=True)
    link = np.zeros(len(pair), dtype=np.int64)
    link[exact] = -1 - pair[exact] // known.size_b
    link[~exact] = place
    hits = np.flatnonzero(vector)
    digests, at = [], 0
    listed = local.tolist()
    for n in n_chunks.tolist():
        digests.append(hashlib.sha256(b";".join([shown[i] for i in listed[at : at + n]])).hexdigest() if n else "")
        at += n
    return {
        "n_a": _sums(cat(lambda s, u: s.n_a[u])[local], n_chunks), "n_b": _sums(cat(lambda s, u: s.n_b[u])[local], n_chunks),
        "n_groups": _sums(cat(lambda s, u: s.n_groups[u])[local], n_chunks), "n_links": _sums(size[local], n_chunks),
        "groups_sha256": digests, "n_chunks": n_chunks, "sizes": [len(size), len(link)],
        "chunks": _pack(local), "chunk_links": _pack(size), "links": _pack(link),
        "ids": hits, "ids_n": vector[hits],
        "pairs": pairs, "pairs_n": np.bincount(place, weights=per_link[~exact], minlength=len(pairs)).astype(np.int64),
    }


PER_DOC = ("n_a", "n_b", "n_groups", "n_links", "n_chunks")
ARRAYS = ("ids", "ids_n", "pairs", "pairs_n", "sizes")
PACKED = ("chunks", "chunk_links", "links")


def blocks(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Aligned documents, a block of them a row."""
    base = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).cast("string").alias("text"))
    row_type = base.schema["row"].dataType.simpleString()
    columns = [f"`block` long, `rows` array<{row_type}>, groups_sha256 array<string>"]
    columns += [f"{c} array<long>" for c in (*PER_DOC, *ARRAYS)] + [f"{c} binary" for c in PACKED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(byte_path, piece_path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in wa.slices(batch.column(1), BLOCK_BYTES):
                at, raw = piece.offsets.tolist(), piece.data.tobytes()
                found = _block([raw[a:b].decode("utf-8") for a, b in zip(at, at[1:])], known)
                edges = pa.array([0, piece.rows], pa.int32())
                rows = pa.ListArray.from_arrays(edges, batch.column(0).slice(piece.first, piece.rows))
                out = [pa.array([number]), rows, pa.array([found["groups_sha256"]], pa.list_(pa.string()))]
                out += [pa.array([found[c]], pa.list_(pa.int64())) for c in (*PER_DOC, *ARRAYS)]
                out += [pa.array([found[c]], pa.binary()) for c in PACKED]
                yield pa.RecordBatch.from_arrays(out, ["block", "rows", "groups_sha256", *PER_DOC, *ARRAYS, *PACKED])
                number += 1

    return base.mapInArrow(run, ", ".join(columns))


def pair_counts(table: DataFrame, same: np.ndarray, size_b: int) -> DataFrame:
    """(pair, n, best) of all linked pairs: id pairs as A id times the size of B plus B id."""
    pairs = table.select(F.explode(F.arrays_zip("pairs", "pairs_n")).alias("p")).select(
        F.col("p.pairs").alias("pair"), F.col("p.pairs_n").alias("n")
    )
    vector = table.select(F.explode(F.arrays_zip("ids", "ids_n")).alias("p")).groupBy("p.ids").agg(F.sum("p.ids_n").alias("n"))
    spark = table.sparkSession
    known = [(i, int(b)) for i, b in enumerate(same.tolist()) if b >= 0]
    mapped = spark.createDataFrame(known, "ids long, b long")  # one row per A id at most
    exact = vector.join(F.broadcast(mapped), "ids").select((F.col("ids") * size_b + F.col("b")).alias("pair"), "n")
    counted = pairs.groupBy("pair").agg(F.sum("n").alias("n")).unionByName(exact).groupBy("pair").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("b", F.pmod("pair", F.lit(size_b)))
    counted = storage.materialize(counted, "pair_counts")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))  # one row per B id at most
    return counted.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> tuple[DataFrame, DataFrame]:
    """Per document its counts and digest, next to struct ``row``; and (a, b, n, best) of all linked id pairs."""
    if byte_path is None or piece_path is None:
        import public_tokenizers

        byte_path = byte_path or public_tokenizers.path(BYTE_VOCABULARY)
        piece_path = piece_path or public_tokenizers.path(PIECE_VOCABULARY)
    known = aligner(byte_path, piece_path)
    size_a, size_b, same = known.size_a, known.size_b, known.same
    table = storage.materialize(blocks(docs, byte_path, piece_path, text, keep), "aligned")
    counts = storage.materialize(pair_counts(table, same, size_b), "pair_counts_best")

    ids = [i for i in range(size_a) if same[i] >= 0]
    ask = docs.sparkSession.createDataFrame([(i * size_b + int(same[i]),) for i in ids], "pair long")
    n_exact, best_exact = np.zeros(size_a, dtype=np.int64), np.zeros(size_a, dtype=np.int64)
    for r in counts.join(F.broadcast(ask), "pair").collect():  # one row per A id at most
        n_exact[r["pair"] // size_b], best_exact[r["pair"] // size_b] = r["n"], r["best"]

    asked = table.select(F.col("block").alias("asker"), F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(counts, "pair").select("asker", "at", "n", F.col("best").cast("long").alias("best"))
    names = [f.name for f in table.schema if f.name not in ("ids", "ids_n", "pairs", "pairs_n")]
    row_type = table.schema["rows"].dataType.elementType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        n, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        n[at] = right.column("n").to_numpy()
        best[at] = right.column("best").to_numpy()
        get = lambda c: left.column(c).combine_chunks().flatten().to_numpy()
        n_chunks, (chunks, links) = get("n_chunks"), get("sizes").tolist()
        body = lambda c, k: _unpack(left.column(c)[0].as_py(), k)
        link, size = body("links", links), body("chunk_links", chunks).astype(np.int64)
        local = body("chunks", int(n_chunks.sum()))
        exact = link < 0
        link_n, link_best = np.zeros(links, dtype=np.int64), np.zeros(links, dtype=np.int64)
        link_n[exact], link_best[exact] = n_exact[-1 - link[exact]], best_exact[-1 - link[exact]]
        link_n[~exact], link_best[~exact] = n[link[~exact]], best[link[~exact]]
        out = {"row": left.column("rows").combine_chunks().flatten()}
        out |= {c: get(c) for c in ("n_a", "n_b", "n_groups", "n_links")}
        out["n_best"] = _sums(_sums(link_best, size)[local], n_chunks)
        out["count_sum"] = _sums(_sums(link_n, size)[local], n_chunks)
        out["groups_sha256"] = left.column("groups_sha256").combine_chunks().flatten()
        return pa.table(out)

    schema = f"row {row_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    scored = table.select(*names).groupBy("block").cogroup(told.groupBy("asker")).applyInArrow(score, schema)
    pairs = counts.select(F.floor(F.col("pair") / size_b).alias("a"), F.pmod("pair", F.lit(size_b)).alias("b"), "n", "best")
    return scored, pairs

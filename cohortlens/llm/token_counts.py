"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens by comparing character classes of whole slices at once.
The pre-tokens of a slice lie end to end in one array of symbols; in each round every
pre-token applies its own lowest-rank pair wherever it occurs, left to right, and only
pairs next to a merged symbol are looked up again. What survives is counted. Merging all
places of the lowest rank at once is the same as one after the other, since a pair with
a new symbol has a higher rank than the merge that made the symbol.

Equal pre-tokens are merged once a task while they are remembered (up to ``KNOWN``,
then the memory starts anew); they are told apart by 64-bit hashes. A special token's
string is one token, as the vocabulary's library counts it by default.

Edge cases: a null text is empty and has no tokens; a text of any length is counted
whole, in slices that never cut a text; repeated rows are counted alike; an empty table
gives an empty table; other columns are carried in a struct.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import wordarrays as wa

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
KNOWN = 1 << 20
NEVER = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, OTHER = range(4)
# Endings that follow an apostrophe as one pre-token.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Merge ranks in an open-addressed table of arrays, and character classes."""

    BITS = 18

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.uint64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.uint64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        self.first = np.array([ids[c] for c in _byte_letters()], dtype=np.int32)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", ())]
        self.cut = Tokenizer.from_file(path).pre_tokenizer
        self.classes = np.full(0x110000, -1, dtype=np.int8)
        size = 1 << self.BITS
        self.keys = np.full(size + 64, np.uint64(2**64 - 1), dtype=np.uint64)
        self.ranks = np.full(size + 64, NEVER, dtype=np.int32)
        for rank, key in enumerate(((left << np.uint64(32)) | right).tolist()):
            at = int(self._place(np.array([key], dtype=np.uint64))[0])
            while self.keys[at] != np.uint64(2**64 - 1) and int(self.keys[at]) != key:
                at += 1
            if self.ranks[at] == NEVER:
                self.keys[at], self.ranks[at] = key, rank

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * wa.PRIME) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._place(keys)
        out = self.ranks[at]
        found = self.keys[at]
        missed = np.flatnonzero((found != keys) & (out != NEVER))
        out[found != keys] = NEVER
        while len(missed):
            at[missed] += 1
            found, own = self.keys[at[missed]], self.ranks[at[missed]]
            same = found == keys[missed]
            out[missed[same]] = own[same]
            missed = missed[~same & (own != NEVER)]
        return out

    def classes_of(self, points: np.ndarray) -> np.ndarray:
        """Classes as the library's own splitter sees them: what it leaves joined is of one class."""
        out = self.classes[points]
        if (out < 0).any():
            for point in np.unique(points[out < 0]).tolist():
                kinds = [k for k, probe in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.cut.pre_tokenize_str(probe + chr(point))) == 1]
                self.classes[point] = kinds[0] if kinds else SPACE
            out = self.classes[points]
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pre_tokens(text: wa.Text, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of pre-tokens, and how many special tokens each row has."""
    data, rows = text.data, text.rows
    special = np.zeros(rows, dtype=np.int64)
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), special
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    n = len(points)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    byte = np.cumsum(width) - width
    fresh = np.zeros(n + 1, dtype=bool)  # a piece of text starts here
    fresh[np.searchsorted(byte, text.offsets)] = True
    fresh[n] = True
    hidden = np.zeros(n, dtype=bool)
    for token in vocab.special:
        at = raw.find(token)
        while at >= 0:
            row = int(np.searchsorted(text.offsets, at, side="right")) - 1
            if at + len(token) <= text.offsets[row + 1]:
                a, b = np.searchsorted(byte, (at, at + len(token)))
                hidden[a:b] = True
                fresh[a] = fresh[b] = True
                special[row] += 1
                at = raw.find(token, at + len(token))
            else:
                at = raw.find(token, at + 1)
    kind = vocab.classes_of(points)
    start = fresh[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last white space before a visible character stands alone, or leads it if it is a blank.
    lead = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh[1:-1])
    start[lead] = True
    start[lead[points[lead] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & start)
    for ending in ENDINGS:
        hit = quote[quote + len(ending) < n]
        for k, letter in enumerate(ending, start=1):
            hit = hit[(points[hit + k] == ord(letter)) & ~fresh[hit + k]]
        start[hit + 1] = False
        after = hit + len(ending) + 1
        start[after[after < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    shown = ~hidden[starts]
    stop = np.append(byte, len(data))
    return byte[starts[shown]], stop[ends[shown]], special


def merge(symbols: np.ndarray, length: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Surviving symbols of each sequence; sequences lie end to end and none is empty."""
    out = length.astype(np.int64)
    alive = np.arange(len(length))
    sym = symbols.astype(np.int32)
    last = np.zeros(len(sym), dtype=bool)
    last[np.cumsum(length) - 1] = True
    rank = np.full(len(sym), NEVER, dtype=np.int32)
    inner = np.flatnonzero(~last)
    rank[inner] = vocab.rank(sym[inner], sym[inner + 1])
    while len(sym):
        first = np.append(0, np.flatnonzero(last)[:-1] + 1)
        size = np.diff(np.append(first, len(sym)))
        lowest = np.minimum.reduceat(rank, first)
        on = lowest != NEVER
        out[alive] = size
        if not on.all():
            wide = np.repeat(on, size)
            sym, last, rank = sym[wide], last[wide], rank[wide]
            alive, size, lowest = alive[on], size[on], lowest[on]
            if not len(sym):
                break
        hit = rank == np.repeat(lowest, size)
        at = np.flatnonzero(hit)
        # Of places in a row that overlap, every other one from the left is merged.
        if (at[1:] == at[:-1] + 1).any():
            head = np.append(True, at[1:] != at[:-1] + 1)
            begin = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        sym[at] = vocab.made[rank[at]]
        last[at] |= last[at + 1]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))
        sym, last, rank = sym[keep], last[keep], rank[keep]
        stale = np.unique(np.concatenate([at, at[at > 0] - 1]))
        rank[stale] = NEVER
        stale = stale[~last[stale]]
        rank[stale] = vocab.rank(sym[stale], sym[stale + 1])
    return out


class Counter:
    """Counts tokens of slices, remembering pre-tokens that it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def count(self, text: wa.Text) -> np.ndarray:
        start, end, total = pre_tokens(text, self.vocab)
        if not len(start):
            return total
        keys, where, inverse = np.unique(wa.hashes(text.data, start, end, lower=False), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        counts = np.zeros(len(keys), dtype=np.int64)
        counts[known] = self.counts[at[known]] if known.any() else 0
        fresh = np.flatnonzero(~known)
        if len(fresh):
            a, b = start[where[fresh]], end[where[fresh]]
            length = b - a
            first = np.cumsum(length) - length
            places = np.arange(int(length.sum())) - np.repeat(first - a, length)
            counts[fresh] = merge(self.vocab.first[text.data[places]], length, self.vocab)
            if len(self.keys) + len(fresh) > KNOWN:
                self.keys, self.counts = self.keys[:0], self.counts[:0]
            joined = np.concatenate([self.keys, keys[fresh]])
            order = np.argsort(joined, kind="stable")
            self.keys, self.counts = joined[order], np.concatenate([self.counts, counts[fresh]])[order]
        row = np.searchsorted(text.offsets, start, side="right") - 1
        return total + np.bincount(row, weights=counts[inverse], minlength=text.rows).astype(np.int64)


def count_tokens(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Struct ``row`` of kept columns, ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    base = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(path))
        for batch in batches:
            n_bytes, n_tokens = [], []
            for piece in wa.slices(batch.column(1)):
                n_bytes.append(np.diff(piece.offsets))
                n_tokens.append(counter.count(piece))
            joined = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (n_bytes, n_tokens)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, joined)], ["row", "n_bytes", "n_tokens"])

    row_type = base.schema["row"].dataType.simpleString()
    counted = base.mapInArrow(run, f"row {row_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

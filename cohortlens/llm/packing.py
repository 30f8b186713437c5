"""Best-fit packing of tokenized documents by sums of squares.

A document is its token ids and an end id. Only longer ones are cut, into pieces of
``capacity`` ids; the last piece may be shorter. Full pieces are sequences of their own.
All others are dealt into cells of bounded size, and a cell packs its pieces from the
longest to the shortest: with N(g) the number of open sequences that have g free places,
a piece goes where the sum of the squares of N becomes smallest (ties: the tightest
place, and an open sequence before a new one). Cells leave a few sequences with much
room; their pieces are dealt out once more, over fewer cells, so that the waste of a
cell does not grow with the number of cells.

Texts are cut at ASCII white space, which the vocabulary drops and no token crosses. Words
of plain letters, signs and digits are merged in arrays by the ranks of the vocabulary,
all others by its library; either way the ids are the library's. The ids of a word are
remembered until there are ``KNOWN``, and told apart by 64-bit hashes (chance of one
clash among n words n^2 / 2^65). Texts never leave the task that reads them.

Edge cases: a null or empty text is the end id alone; a text of any length is tokenized
whole; rows with a null or repeated doc_id are documents of their own; special strings
in a text are what the library makes of them by default; an empty table gives an empty
table; other columns are left alone. Equal lengths are placed in the order of a hash of
the written pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import storage
from cohortlens.llm import token_counts
from cohortlens.llm import wordarrays as wa

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
KNOWN = 1 << 19
CELL_PIECES = 20_000
OPEN_GAP = 32  # sequences with more room than this are dealt out once more


LETTER, NUMBER, SIGN = 1, 2, 3


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Kinds of bytes in plain words (0: the library splits it), and their lower case.

    Plain are printable ASCII but for apostrophes and what opens a special string, and the
    letters up to U+00FF but for those that no table of single bytes can tell.
    """
    kind = np.zeros(256, dtype=np.int8)
    lower = np.arange(256, dtype=np.uint8)
    for b in range(33, 127):
        kind[b] = LETTER if chr(b).isalpha() else NUMBER if chr(b).isdigit() else SIGN
    kind[[ord("'"), ord("<")]] = 0
    kind[0xC3] = LETTER
    lower[ord("A") : ord("Z") + 1] += 32
    return kind, lower


KIND, LOWER = _classes()


class WordIds:
    """Ids of words, remembered by 64-bit hashes of their lower-cased bytes.

    Plain words are cut into runs of letters, runs of signs and single digits, and their
    symbols are merged for all words at once, each word's lowest-ranked pair first. Other words are
    left to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab = token_counts.Vocabulary(path)
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = self.vocab.first
        self.last = np.array([ids[c + end] for c in token_counts._byte_letters()], dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def _plain(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are plain; ids of those end to end, and how many each has."""
        size = end - start
        first = np.cumsum(size) - size
        body = data[ragged(start, size)]
        kind = KIND[body]
        # The second byte of a letter above ASCII; the multiplication and division signs are none.
        lead = np.flatnonzero(body[:-1] == 0xC3) + 1
        second = body[lead]
        kind[lead] = np.where((second == 0x97) | (second == 0xB7), 0, LETTER)
        plain = np.minimum.reduceat(kind, first) > 0 if len(first) else np.zeros(0, dtype=bool)
        body = LOWER[body]
        body[lead] += np.where((second >= 0x80) & (second <= 0x9E), 0x20, 0).astype(np.uint8)
        wide = np.repeat(plain, size)
        body, kind, size = body[wide], kind[wide], size[plain]
        if not len(body):
            return plain, np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        opens = np.zeros(len(body), dtype=bool)
        opens[np.cumsum(size) - size] = True
        opens[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        at = np.flatnonzero(opens)
        length = np.diff(np.append(at, len(body)))
        symbols = self.inner[body]
        symbols[at + length - 1] = self.last[body[at + length - 1]]
        ids, left = survivors(symbols, length, self.vocab)
        word = np.repeat(np.arange(len(size)), size)[at]
        return plain, ids, np.bincount(word, weights=left, minlength=len(size)).astype(np.int64)

    def _learn(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        plain, ids, size = self._plain(data, start, end)
        odd = np.flatnonzero(~plain)
        words = [data[a:b].tobytes().decode("utf-8") for a, b in zip(start[odd].tolist(), end[odd].tolist())]
        found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        sizes = np.concatenate([size, np.fromiter(map(len, found), dtype=np.int64, count=len(found))])
        at = len(self.ids) + np.cumsum(sizes) - sizes
        keys = np.concatenate([self.keys, keys[plain], keys[odd]])
        order = np.argsort(keys, kind="stable")
        self.ids = np.concatenate([self.ids, ids, np.fromiter(chain.from_iterable(found), dtype=np.int32)])
        self.keys = keys[order]
        self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, sizes])[order]

    def encode(self, text: wa.Text) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        words = wa.spaced_words(text)
        if not len(words.start):
            return np.zeros(0, dtype=np.int32), np.zeros(text.rows, dtype=np.int64)
        hashes = wa.hashes(text.data, words.start, words.end)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            fresh = where[~known]
            self._learn(text.data, keys[~known], words.start[fresh], words.end[fresh])
            place = np.searchsorted(self.keys, keys)
        at, size = self.at[place][inverse], self.size[place][inverse]
        ids = self.ids[ragged(at, size)]
        return ids, np.bincount(words.row, weights=size, minlength=text.rows).astype(np.int64)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each row, end to end."""
    end = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(start - end + size, size)


def survivors(symbols: np.ndarray, length: np.ndarray, vocab: token_counts.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that are left of each sequence, end to end, and their number.

    Sequences lie end to end and none is empty. All of them merge their lowest-ranked
    pair at once; places that overlap are merged from the left.
    """
    owner = np.repeat(np.arange(len(length)), length)
    sym = symbols.astype(np.int32)
    joint = np.append(owner[1:] == owner[:-1], False)
    rank = np.full(len(sym), token_counts.NEVER, dtype=np.int32)
    pairs = np.flatnonzero(joint)
    rank[pairs] = vocab.rank(sym[pairs], sym[pairs + 1])
    done_sym, done_owner = [], []
    while len(sym):
        head = np.flatnonzero(np.append(True, ~joint[:-1]))
        size = np.diff(np.append(head, len(sym)))
        lowest = np.minimum.reduceat(rank, head)
        over = lowest == token_counts.NEVER
        if over.any():
            wide = np.repeat(over, size)
            done_sym.append(sym[wide])
            done_owner.append(owner[wide])
            sym, owner, joint, rank = sym[~wide], owner[~wide], joint[~wide], rank[~wide]
            size, lowest = size[~over], lowest[~over]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, size))
        if (at[1:] == at[:-1] + 1).any():
            run = np.append(True, at[1:] != at[:-1] + 1)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        sym[at] = vocab.made[rank[at]]
        joint[at] = joint[at + 1]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))
        sym, owner, joint, rank = sym[keep], owner[keep], joint[keep], rank[keep]
        stale = np.unique(np.concatenate([at, at[at > 0] - 1]))
        rank[stale] = token_counts.NEVER
        stale = stale[joint[stale]]
        rank[stale] = vocab.rank(sym[stale], sym[stale + 1])
    owner = np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(done_sym)[order], np.bincount(owner, minlength=len(length))


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, taken in the order given, and what each sequence holds.

    A move from gap g to gap g - s changes the sum of squares by 2 (N(g - s) - N(g)) + 2;
    a closed sequence counts no more, and a new one had no gap before.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    held: list[int] = []
    sequence = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    never = np.int64(1 << 60)
    for i, size in enumerate(lengths.tolist()):
        rest = capacity - size
        at = -1
        if rest:
            old = count[size:capacity]
            change = 2 * (count[:rest] - old) + 2
            change[0] -= 1
            change[old == 0] = never
            best = int(change.argmin())
            if change[best] <= 2 * count[rest] + 1:
                at = by_gap[best + size].pop()
                count[best + size] -= 1
                rest = best
        if at < 0:
            at = len(held)
            held.append(0)
        sequence[i], offset[i] = at, held[at]
        held[at] += size
        if rest:
            count[rest] += 1
            by_gap[rest].append(at)
    return sequence, offset, np.array(held, dtype=np.int64)


def cut(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text",
    keep: Sequence[str] = ("doc_id",), with_ids: bool = False,
) -> DataFrame:
    """Struct ``row`` of kept columns, piece, start, length, ids_crc32 and, if wanted, the ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    base = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).cast("string").alias("text"))
    names = ["row", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            for texts in wa.slices(batch.column(1)):
                ids, sizes = words.encode(texts)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                whole = np.full(int(ends[-1]), END_ID, dtype="<u4")
                inside = np.ones(len(whole), dtype=bool)
                inside[ends - 1] = False
                whole[inside] = ids
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                begin = (ends - sizes)[row] + start
                body = memoryview(whole.tobytes())
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                columns = [
                    batch.column(0).take(pa.array(row + texts.first)), pa.array(piece.astype(np.int32)),
                    pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    edges = np.append(begin, len(whole)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(whole.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = f"row {base.schema['row'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return base.mapInArrow(run, kinds + (", ids array<int>" if with_ids else ""))


def place(pieces: DataFrame, capacity: int = CAPACITY, cell_pieces: int = CELL_PIECES, rounds: int = 2) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table with a unique ``key`` and ``length``.

    Only keys and lengths are shuffled to the cells; a cell holds about ``cell_pieces``.
    """
    full = pieces.filter(F.col("length") == capacity)
    placed = full.select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).select("key", "length")
    for turn in range(rounds):
        last = turn == rounds - 1
        cells = max(1, -(-rest.count() // cell_pieces))
        dealt = rest.withColumn("cell", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(cells)))

        def pack(table: pa.Table) -> pa.Table:
            cell = table.column("cell")[0].as_py()
            key = table.column("key").to_numpy()
            length = table.column("length").to_numpy()
            order = np.lexsort((wa.mix(key.astype(np.uint64)), -length))
            sequence, offset, held = sum_of_squares(length[order], capacity)
            done = np.ones(len(order), dtype=bool) if last or cells == 1 else (capacity - held <= OPEN_GAP)[sequence]
            # Keys of full pieces are not negative; numbers of cells and turns keep the others apart.
            number = -1 - ((np.int64(turn) << 60) | (np.int64(cell) << 24) | sequence)
            return pa.table({"key": key[order], "length": length[order], "sequence_id": number, "offset": offset, "done": done})

        out = dealt.groupBy("cell").applyInArrow(pack, "key long, length long, sequence_id long, offset long, done boolean")
        out = storage.materialize(out, f"packed_{turn}")
        placed = placed.unionByName(out.filter("done").select("key", "sequence_id", "offset"))
        if last or cells == 1:
            break
        rest = out.filter("NOT done").select("key", "length")
    return pieces.join(placed, "key")


def pack(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text",
    keep: Sequence[str] = ("doc_id",), with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that each one gets."""
    pieces = cut(docs, path, capacity, text, keep, with_ids).withColumn("key", F.monotonically_increasing_id())
    return place(storage.materialize(pieces, "pieces"), capacity).drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: (sequence_id, ids), from pieces packed ``with_ids``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))

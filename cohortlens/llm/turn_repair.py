"""Conversation structure repair by aligning turns to strings of the alternating grammar.

The initials of the roles of a sound conversation are empty or an optional system turn
followed by user and assistant turns in pairs. For every feasible length of such a string
the turns of a conversation are aligned to it (Wagner and Fischer), inside the band that
the cheapest cost so far leaves open (Ukkonen); each alignment is traced back to its
ASCII-least audit, and the least audit of the least cost wins.

Long conversations are cut into blocks of ``BLOCK`` turns. A block is aligned to every
feasible length between any two states of the grammar, and blocks are chained by their
states. Audits of one block and equal cost are never prefixes of each other (the longer
one would insert more), so the least audit of a chain is made of the least of its blocks.
A sorted range of turns may hold part of a conversation; it then hands on the costs and
audits of all pairs of states, and parts are chained in a second step. So no task holds
the turns of a long conversation. Only its hash must run over its text in one task, in
order; that task streams.

Edge cases: nulls count as one space in any column but stay null in conv_id and turn; turns of equal
number are ordered by role and digest of the text; equal rows cannot be told apart and
all but one are duplicates; conversations without any turn have zeros, an empty audit and the
hash of an empty string; an empty table gives an empty table; texts are hashed whole;
other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Costs of the edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
VISIBLE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

BLOCK = 16
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {"u": "user", "a": "assistant"}
NEVER = 1 << 60
Edit = tuple[int, str]


def _target(entry: int, length: int, system: bool) -> str:
    """The string of the grammar of a length between a state and wherever it ends."""
    first = AFTER[entry]
    alternating = ("ua" if first == "u" else "au") * (length // 2 + 1)
    return "s" + alternating[: length - 1] if system else alternating[:length]


def _align(turns: str, target: str, limit: int) -> Edit | None:
    """Least cost up to ``limit`` and least audit of turning ``turns`` into ``target``.

    A turn is its initial, in upper case if it is truncated, or ``d`` if it must go. Only
    diagonals are filled on which a path within the limit can lie.
    """
    n, m = len(turns), len(target)

    def least(d: int) -> int:
        left = m - n - d
        return (INSERT * d if d > 0 else -DELETE * d) + (INSERT * left if left > 0 else -DELETE * left)

    low = high = 0
    if least(0) > limit:
        return None
    while low - 1 >= -n and least(low - 1) <= limit:
        low -= 1
    while high + 1 <= m and least(high + 1) <= limit:
        high += 1
    width = high - low + 1
    rows: list[list[int]] = [[]] * (n + 1)
    below = [NEVER] * (width + 1)
    for i in range(n, -1, -1):
        here = [NEVER] * (width + 1)
        turn = turns[i] if i < n else ""
        for k in range(width - 1, -1, -1):
            j = i + low + k
            if j < 0 or j > m:
                continue
            best = 0 if i == n and j == m else NEVER
            if i < n:
                if k > 0:
                    best = min(best, DELETE + below[k - 1])
                if j < m and turn != "d":
                    kept = 0 if turn.lower() == target[j] else NEVER if target[j] == "s" else REROLE
                    best = min(best, kept + (TRUNCATED if turn.isupper() else 0) + below[k])
            if j < m and target[j] != "s" and k + 1 < width:
                best = min(best, INSERT + here[k + 1])
            here[k] = best
        rows[i] = below = here
    cost = rows[0][-low]
    if cost > limit:
        return None
    audit, i, k, left = [], 0, -low, cost
    while left or i < n or i + low + k < m:
        j = i + low + k
        if i < n and k > 0 and DELETE + rows[i + 1][k - 1] == left:
            audit.append("D")
            i, k = i + 1, k - 1
        elif j < m and target[j] != "s" and k + 1 < width and INSERT + rows[i][k + 1] == left:
            audit.append("I")
            k += 1
        else:
            audit.append("K" if turns[i].lower() == target[j] else "R")
            i += 1
        left = rows[i][k]
    return cost, "".join(audit)


def _shortest(entry: int, last: int) -> int | None:
    """Turns to insert between two states if no turn is kept; None if that cannot be."""
    if entry == last:
        return 0
    if last in (START, SYSTEM):
        return None
    return 2 if (entry, last) in ((START, ASSISTANT), (SYSTEM, ASSISTANT)) else 1


@lru_cache(maxsize=1 << 16)
def between(turns: str, entry: int, last: int) -> Edit | None:
    """Least cost and audit of all strings of the grammar from one state to another."""
    n, inserted = len(turns), _shortest(entry, last)
    if inserted is None and (entry, last) != (START, SYSTEM):
        return None
    limit = NEVER if inserted is None else DELETE * n + INSERT * inserted
    best: Edit | None = None
    lengths = [
        (DELETE * max(0, n - m) + INSERT * max(0, m - n), m, system)
        for m in range(2 * n + 3)
        for system in ((False, True) if entry == START and m else (False,))
    ]
    for bound, m, system in sorted(lengths):
        if bound > limit:
            break
        target = _target(entry, m, system)
        if (STATE[target[-1]] if target else entry) != last:
            continue
        found = _align(turns, target, min(limit, DELETE * n + INSERT * m))
        if found is not None and (best is None or found < best):
            best, limit = found, found[0]
    return best


def chain(states: list[Edit | None], turns: str) -> list[Edit | None]:
    """Best ways to the four states after more turns, from the best ways to them before."""
    for at in range(0, len(turns), BLOCK):
        block = turns[at : at + BLOCK]
        states = join_parts(states, [[between(block, p, q) for q in range(4)] if states[p] else [None] * 4 for p in range(4)])
    return states


def join_parts(states: list[Edit | None], table: list[list[Edit | None]]) -> list[Edit | None]:
    out: list[Edit | None] = []
    for q in range(4):
        ways = [(s[0] + table[p][q][0], s[1] + table[p][q][1]) for p, s in enumerate(states) if s and table[p][q]]
        out.append(min(ways) if ways else None)
    return out


def accepted(states: list[Edit | None]) -> Edit:
    return min(s for s in (states[START], states[ASSISTANT]) if s)


def from_state(entry: int) -> list[Edit | None]:
    return [(0, "") if q == entry else None for q in range(4)]


def damage(talks: DataFrame) -> DataFrame:
    """Damage rows by a hash of conv_id and turn: drop, empty, strip ends, repeat, set the role."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(name) % 20
    text = F.coalesce(F.col("text").cast("string"), blank)
    rows = talks.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.filter(F.col("copies") > 0)


def _digest(text: Column) -> Column:
    return F.md5(text)


def _turns(rows: DataFrame) -> DataFrame:
    """Each different (conv_id, turn, role, text) once: copies, initial, faults; no texts."""
    light = rows.select(
        "conv_id",
        "turn",
        "role",
        _digest(F.col("text")).alias("digest"),
        "copies",
        (~F.col("text").rlike(VISIBLE)).alias("blank"),
        (~F.col("text").rlike(ENDED)).alias("truncated"),
    )
    turns = light.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")
    )
    # A text that comes back at a later turn; few do, and each is one row here.
    place = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    first = turns.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.coalesce(F.col("first") < place, F.lit(False))
    return turns.join(first, same, "left").select(
        "conv_id", "turn", "role", "digest", "copies", "blank", "truncated", later.alias("again")
    )


PARTS = (
    "part long, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
    "n_turns long, low long, high long, costs array<long>, audits array<string>"
)
FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[dict], conv: pa.DataType, columns: str) -> pa.RecordBatch:
    fields = [pa.field(name, KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([pa.field("conv_id", conv), *fields]))


class _Part:
    """What a run of sorted turns of one conversation hands on."""

    def __init__(self, conv):
        self.conv = conv
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.head = self.tail = self.low = self.high = None
        self.turns: list[str] = []

    def add(self, turn, role: str, copies: int, blank: bool, truncated: bool, again: bool) -> None:
        initial = role[:1]
        self.illegal += self.head is not None and self.tail + initial not in LEGAL
        self.illegal += (copies - 1) * (initial + initial not in LEGAL)
        if self.head is None:
            self.head = initial
        self.tail = initial
        if turn is not None:
            self.n_turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        kind = initial if initial in STATE else "o"
        if blank:
            self.blank += copies
            self.turns.append("d" * copies)
        else:
            self.duplicate += copies - (not again)
            self.truncated += truncated and not again
            self.turns.append(("d" if again else kind.upper() if truncated else kind) + "d" * (copies - 1))

    def row(self, part: int, whole: bool) -> dict:
        """Costs and audits to all states, from the start if the conversation is whole, else from every state."""
        turns = "".join(self.turns)
        flat = [way for entry in range(1 if whole else 4) for way in chain(from_state(entry), turns)]
        return {
            "conv_id": self.conv, "part": part, "blank": self.blank, "duplicate": self.duplicate,
            "truncated": self.truncated, "illegal": self.illegal, "head": self.head, "tail": self.tail,
            "n_turns": self.n_turns, "low": self.low, "high": self.high,
            "costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat],
        }


def _parts(turns: DataFrame) -> DataFrame:
    """Align the turns of each sorted range of the table."""
    order = ["conv_id", "turn", "role", "digest"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        current, first = None, True
        for batch in batches:
            conv_type, out = batch.schema.field(0).type, []
            for conv, *turn in zip(*[c.to_pylist() for c in batch.columns]):
                if current is None or current.conv != conv:
                    if current is not None:
                        # What stands at either end of a range may go on in the next one.
                        out.append(current.row(number, whole=not first))
                        first = False
                    current = _Part(conv)
                current.add(*turn)
            yield _batch(out, conv_type, PARTS)
        if current is not None:
            yield _batch([current.row(number, whole=False)], conv_type, PARTS)

    return ranged.mapInArrow(run, f"conv_id {kind}, {PARTS}")


def _joined(conv, rows: Iterator[dict]) -> dict:
    """Findings of a conversation from its parts in order."""
    states, tail, low, high, n_turns, illegal = from_state(START), None, None, None, 0, 0
    faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for r in rows:
        flat = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])]
        states = join_parts(states, [flat[4 * p : 4 * p + 4] or [None] * 4 for p in range(4)])
        illegal += r["illegal"] + (tail is not None and tail + r["head"] not in LEGAL)
        n_turns += r["n_turns"] - (high is not None and high == r["low"])
        tail, low, high = r["tail"], r["low"] if low is None else low, high if r["high"] is None else r["high"]
        faults = {k: v + r[k] for k, v in faults.items()}
    cost, audit = accepted(states)
    gaps = 0 if low is None else high - low + 1 - n_turns
    return {"conv_id": conv, "gaps": gaps, **faults, "illegal": illegal, "cost": cost, "audit": audit}


def _whole(parts: DataFrame) -> DataFrame:
    """Chain the parts of each conversation; nearly all have one."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type = None

        def rows():
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field(0).type
                yield from batch.to_pylist()

        out = []
        for conv, group in groupby(rows(), key=lambda r: r["conv_id"]):
            out.append(_joined(conv, group))
            if len(out) == 5000:
                yield _batch(out, conv_type, FOUND)
                out = []
        if out:
            yield _batch(out, conv_type, FOUND)

    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(run, f"conv_id {kind}, {FOUND}")


class _Repair:
    """Rewrites the turns of one conversation as its audit says."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            letter = AFTER[self.state]
            self.state = STATE[letter]
            yield ROLE[letter], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            if edit == "R":
                role = ROLE[AFTER[self.state]]
            self.state = STATE[role[0]]
            yield role, text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def _streamed(talks: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per conversation its findings, then its turns in order; one shuffle brings them together."""
    none = {"turn": rows.schema["turn"].dataType, "role": "string", "digest": "string", "text": "string"}
    nulls = [F.lit(None).cast(t).alias(c) for c, t in none.items()]
    empty = F.lit(None).cast("struct<" + FOUND.replace(" long", ":bigint").replace(" string", ":string").replace(" ", "") + ">")
    ids = talks.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), *nulls, empty.alias("found"))
    heads = found.select(
        "conv_id", F.lit(1).alias("kind"), *nulls, F.struct(*[c.split()[0] for c in FOUND.split(", ")]).alias("found")
    )
    body = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        "conv_id", F.lit(2).alias("kind"), "turn", "role", _digest(F.col("text")).alias("digest"), "text", empty.alias("found")
    )
    together = ids.unionByName(heads).unionByName(body).repartition("conv_id")
    return together.sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").drop("digest")


class _Stream:
    """Sorted rows as conversations: id, findings, and its repaired turns, which must be read to their end."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.conv_type = batches, None

    def _rows(self) -> Iterator[dict]:
        for batch in self.batches:
            self.conv_type = batch.schema.field(0).type
            yield from batch.to_pylist()

    def conversations(self) -> Iterator[tuple]:
        for conv, rows in groupby(self._rows(), key=lambda r: r["conv_id"]):
            next(rows)  # the conversation's own row
            known = next(rows, {}).get("found")
            yield conv, known, _repaired(rows, known["audit"] if known else "")


def _repaired(rows: Iterator[dict], audit: str) -> Iterator[tuple[str, str]]:
    repair = _Repair(audit)
    for r in rows:
        yield from repair.turn(r["role"], r["text"])
    yield from repair.end()


ZERO = {c.split()[0]: 0 for c in FOUND.split(", ")} | {"audit": ""}


def examine(talks: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``talks``: faults of its ``rows``, cost and audit of its repair, and the hash of the repaired text.

    ``rows`` are the turns to repair (default: ``talks`` itself), with a count of ``copies``.
    """
    rows, found = _found(talks, rows)
    streamed = _streamed(talks, rows, found)
    kind, columns = rows.schema["conv_id"].dataType.simpleString(), f"{FOUND}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, out = _Stream(batches), []
        for conv, known, turns in stream.conversations():
            digest, joint = hashlib.sha256(), b""
            for role, text in turns:
                digest.update(joint + role.encode() + b":" + text.encode())
                joint = b"\n"
            out.append({"conv_id": conv, **(known or ZERO), "repaired_sha256": digest.hexdigest()})
            if len(out) == 5000:
                yield _batch(out, stream.conv_type, columns)
                out = []
        if out:
            yield _batch(out, stream.conv_type, columns)

    return streamed.mapInArrow(run, f"conv_id {kind}, {columns}")


def repair(talks: DataFrame) -> DataFrame:
    """The repaired conversations themselves: (conv_id, turn from zero, role, text)."""
    rows, found = _found(talks, None)
    kind, columns = rows.schema["conv_id"].dataType.simpleString(), "turn long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, out, size = _Stream(batches), [], 0
        for conv, _, turns in stream.conversations():
            for i, (role, text) in enumerate(turns):
                out.append({"conv_id": conv, "turn": i, "role": role, "text": text})
                size += len(text)
                if len(out) == 5000 or size > 4 << 20:
                    yield _batch(out, stream.conv_type, columns)
                    out, size = [], 0
        if out:
            yield _batch(out, stream.conv_type, columns)

    return _streamed(talks, rows, found).mapInArrow(run, f"conv_id {kind}, {columns}")


def _found(talks: DataFrame, rows: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    blank = F.lit(" ")
    if rows is None:
        rows = talks.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.lit(1).alias("copies"))
    return rows, _whole(_parts(_turns(rows)))

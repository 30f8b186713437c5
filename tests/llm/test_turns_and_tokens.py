"""Turn repair, token alignment and packing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import __spark_entry__ as entry
from cohortlens.llm import packing, token_alignment, turn_repair

SF_DIR = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"

# --- turn repair ----------------------------------------------------------------------------------


def plain_audit(turns):
    """Least (cost, audit) over the states of the grammar; a turn is (initial, must go, truncated)."""
    after, state = {0: "u", 1: "u", 2: "a", 3: "u"}, {"s": 1, "u": 2, "a": 3}

    def insert(best):
        changed = True
        while changed:
            changed = False
            for p, (c, a) in list(best.items()):
                q, way = state[after[p]], (c + 5, a + "I")
                if q not in best or way < best[q]:
                    best[q], changed = way, True
        return best

    best = insert({0: (0, "")})
    for initial, gone, truncated in turns:
        ways = defaultdict(list)
        for p, (c, a) in best.items():
            ways[p].append((c + 2, a + "D"))
            if not gone:
                more = 5 if truncated else 0
                if initial == after[p] or (initial == "s" and p == 0):
                    ways[state[initial]].append((c + more, a + "K"))
                ways[state[after[p]]].append((c + 1 + more, a + "R"))
        best = insert({p: min(w) for p, w in ways.items()})
    return min(best[p] for p in (0, 3) if p in best)


def plain_repair(rows):
    """rows: (conv_id, turn, role, text) as given."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        by_conv[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by_conv[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.md5(t[2].encode()).hexdigest()))
        seen, kinds, faults = set(), [], Counter()
        for _, role, text in turns:
            body = text.rstrip(SPACES)
            if not body.strip(SPACES):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif body[-1] not in ".!?":
                fault = "truncated"
            else:
                fault = ""
            seen.add((role, text))
            faults[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = plain_audit(kinds)
        numbers = {t for t, _, _ in turns if t is not None}
        initials = [k[0] for k in kinds]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        state, parts, todo = "", [], iter(turns)
        for edit in audit:
            wanted = "assistant" if state == "u" else "user"
            if edit == "I":
                role, text = wanted, ""
            else:
                _, role, text = next(todo)
                role = wanted if edit == "R" else role
            if edit != "D":
                state = role[0]
                parts.append(f"{role}:{text}")
        out[conv] = {
            "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            **{k: faults[k] for k in ("blank", "duplicate", "truncated")},
            "illegal": illegal, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(parts).encode()).hexdigest(),
        }
    return out


def as_found(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


TALK = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
     T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("copies", T.StringType()),
     T.StructField("found", T.StringType())]
)


def odd_talks():
    r = random.Random(5)
    rows = [
        (1, 0, None, "Hi."), (1, 1, "user", None), (1, None, "user", "Null turn."), (1, 3, "", "No role."), (1, 2**40, "user", "Far."),
        (2, 0, "system", "Be kind."), (2, 1, "user", "One."), (2, 1, "user", "One."), (2, 1, "user", "One."), (2, 2, "assistant", "Two."),
        (3, None, "user", "x"), (3, None, "user", "y."), (None, 0, "user", "Lost."), (None, None, None, None),
        (4, 0, "uncle", "\u0085"), (4, 1, "aunt", "Ends! \x0b "), (4, 2, "sister", "é?" * 50_000), (5, -3, "assistant", "a."), (5, 7, "user", "b."),
    ]
    for conv in range(10, 60):
        for turn in range(r.randint(1, 25)):
            text = r.choice(["", " ", "Short.", "Cut off", f"Text {r.random()}.", "Why?\n"])
            rows.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool"]), text))
    for turn in range(700):  # a conversation that holds a third of all rows
        rows.append((7, turn, ("user", "assistant")[turn % 2], r.choice([f"Turn {turn}.", "Again.", "Open", f"Turn {turn}?"])))
    return rows


@pytest.fixture(scope="module")
def talks(spark):
    rows = odd_talks()
    return spark.createDataFrame([(*r, "d", "c", "f") for r in rows], TALK).repartition(5)


def test_repair_finds_what_a_plain_version_finds(spark, talks):
    want = plain_repair(odd_talks())
    assert as_found(turn_repair.examine(talks, turn_repair.damage(talks))) == want


def test_a_conversation_over_many_ranges(spark, talks):
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        parts = turn_repair._parts(turn_repair._turns(turn_repair.damage(talks)))
        assert parts.filter("conv_id = 7").count() > 5
        assert as_found(turn_repair.examine(talks, turn_repair.damage(talks))) == plain_repair(odd_talks())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_registered_repair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_found(entry.queries()["op11_turn_repair"](spark, SF_DIR)) == plain_repair(rows)


def test_alignment_by_lengths_and_blocks():
    r = random.Random(2)
    for _ in range(600):
        turns = "".join(r.choice("uauauasodUASO") for _ in range(r.choice([0, 1, 2, 4, 9, 16, 17, 33, 50])))
        want = plain_audit([(t.lower(), t == "d", t.isupper()) for t in turns])
        assert turn_repair.accepted(turn_repair.chain(turn_repair.from_state(turn_repair.START), turns)) == want
        at = r.randint(0, len(turns))
        states = turn_repair.from_state(turn_repair.START)
        for part in (turns[:at], turns[at:]):
            states = turn_repair.join_parts(states, [turn_repair.chain(turn_repair.from_state(p), part) for p in range(4)])
        assert turn_repair.accepted(states) == want


def test_repaired_turns_follow_the_grammar(spark, talks):
    turns = turn_repair.repair(talks).orderBy("conv_id", "turn").collect()
    by_conv = defaultdict(list)
    for t in turns:
        assert t["turn"] == len(by_conv[t["conv_id"]])
        by_conv[t["conv_id"]].append(t)
    assert all(re.fullmatch("s?(ua)+", "".join(t["role"][0] for t in ts)) for ts in by_conv.values())
    found = as_found(turn_repair.examine(talks))
    for conv, ts in by_conv.items():
        text = "\n".join(f"{t['role']}:{t['text']}" for t in ts)
        assert hashlib.sha256(text.encode()).hexdigest() == found[conv]["repaired_sha256"]


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TALK)
    assert turn_repair.examine(empty, turn_repair.damage(empty)).count() == 0
    assert turn_repair.repair(empty).count() == 0


def test_all_turns_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    only = spark.createDataFrame([(conv, 0, "user", "Gone.", "", "", "")], TALK)
    got = as_found(turn_repair.examine(only, turn_repair.damage(only)))[conv]
    assert got == {**turn_repair.ZERO, "repaired_sha256": hashlib.sha256(b"").hexdigest()}


# --- token alignment ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain_tokens():
    path = public_tokenizers.path
    a = Tokenizer.from_file(path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in letters}
    byte.update({chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(letters))})

    def tokens(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        ea = a.encode(" " + text, add_special_tokens=False)
        ta = [(i, bytes(byte[c] for c in t)) for i, t in zip(ea.ids, ea.tokens)]
        tb = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            tb.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        return (ta, tb) if b"".join(t for _, t in ta) == whole == b"".join(t for _, t in tb) else ([], [])

    return tokens


def plain_alignment(texts, tokens):
    docs, counts = [], Counter()
    for text in texts:
        ta, tb = tokens(text)
        spans = []
        for side in (ta, tb):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links, k = [], 0
        for i, s, e in spans[0]:
            while k < len(spans[1]) and spans[1][k][2] <= s:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][1] < e:
                links.append((i, spans[1][m][0]))
                m += 1
        both = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        left, groups = [list(reversed(side)) for side in spans], []
        for high in both:
            taken = [[], []]
            for side, ids in zip(left, taken):
                while side and side[-1][2] <= high:
                    ids.append(str(side.pop()[0]))
            groups.append("|".join(map(",".join, taken)))
        docs.append((len(ta), len(tb), groups, links))
        counts.update(links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = []
    for n_a, n_b, groups, links in docs:
        shown = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(counts[x] == most[x[1]] for x in links)
        rows.append((n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), shown))
    return rows


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    "", None, " ", "  two  spaces ", " lead", "trail ", "tab\tand\n\nlines \n mixed   space　wide", "▁ piece mark", "nul \x00 byte",
    "<s> </s> <unk> <|endoftext|> <0x41>", "é combining ﬁ ligature Ａ", "\x1c file \x1c sep", "日本語 と 한국어 😀😀", "a" * 5000,
    "don't it's we'll 'S", "1234 5 67,89.0", "  line  sep", "aaaa aaa aa a", "x ​ y", "ß ẞ İ ı",
]


def aligned_rows(df, key="doc_id"):
    return sorted((r["row"][key] if "row" in r else r[key], *[r[f] for f in FIELDS]) for r in df.collect())


def test_alignment_of_odd_texts(spark, edges, plain_tokens):
    texts = [r["text"] for r in edges.select("text").collect()] + ODD
    r = random.Random(4)
    texts += [" ".join(r.choice(["the", "straße", "naïve\n", "", "\tcode", "été", "x=1;", "Übung."]) for _ in range(200)) for _ in range(20)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rows", F.lit(1)).repartition(3)
    got, pairs = token_alignment.align(table)
    want = plain_alignment(texts, plain_tokens)
    assert aligned_rows(got) == sorted((i, *w) for i, w in enumerate(want))
    assert pairs.filter("best").select("b").distinct().count() == pairs.select("b").distinct().count()


def test_small_blocks_change_nothing(spark, plain_tokens):
    texts = ODD[3:] * 3
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    known = token_alignment.aligner(
        public_tokenizers.path(token_alignment.BYTE_VOCABULARY), public_tokenizers.path(token_alignment.PIECE_VOCABULARY)
    )
    assert known.may_cut
    # The hot pair of one text repeated, and blocks of one document each.
    one = [token_alignment._block([t], known) for t in texts]
    joint = token_alignment._block(texts, known)
    assert [d for b in one for d in b["groups_sha256"]] == joint["groups_sha256"]
    assert sum(int(np.sum(b["pairs_n"])) for b in one) == int(np.sum(joint["pairs_n"]))
    got, _ = token_alignment.align(table)
    assert aligned_rows(got) == sorted((i, *w) for i, w in enumerate(plain_alignment(texts, plain_tokens)))


def test_registered_alignment(spark, plain_tokens):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = plain_alignment([d["text"] for d in docs], plain_tokens)
    got = entry.queries()["op12_token_alignment"](spark, SF_DIR)
    assert aligned_rows(got) == sorted((d["doc_id"], *w) for d, w in zip(docs, want))


def test_no_documents(spark, nothing):
    assert token_alignment.align(nothing)[0].count() == 0
    assert packing.pack(nothing).count() == 0


# --- packing --------------------------------------------------------------------------------------


def plain_pieces(texts, capacity=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out.append((doc, k // capacity, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    return out


def by_none(row):
    return tuple((x is not None, x or 0) for x in row)


def check_packing(rows, texts, spare):
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=by_none)
    assert got == sorted(plain_pieces(texts), key=by_none)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(held) <= math.ceil(sum(r["length"] for r in rows) / 2048) * (1 + spare) + 1


def test_packing_of_odd_texts(spark, edges):
    texts = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    odd = ODD + ["Σίσυφος ΟΔΟΣ", "a\x1cb \x85c", "<|endoftext|> x<|startoftext|>y", "Å ̊B", "İstanbul", "n't 've  q"]
    texts += [(1000 + i, t) for i, t in enumerate(odd)]
    table = spark.createDataFrame(texts, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("row", F.lit(2)).repartition(3)
    check_packing(packing.pack(table).select("row.*", "*").collect(), texts, 0.1)


def test_registered_packing(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(entry.queries()["op13_packing"](spark, SF_DIR).collect(), texts, 0.03)


def test_cells_and_rounds_keep_every_piece(spark):
    r = random.Random(8)
    sizes = [(i, r.choice([1, 5, 700, 1024, 2048, r.randint(1, 1500)])) for i in range(3000)]
    pieces = spark.createDataFrame(sizes, "key long, length long")
    rows = packing.place(pieces, cell_pieces=300).collect()
    assert sorted((x["key"], x["length"]) for x in rows) == sizes
    held = defaultdict(list)
    for x in rows:
        held[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    one_cell = packing.sum_of_squares(np.sort([n for _, n in sizes if n < 2048])[::-1], 2048)[2]
    assert len(held) <= 1.02 * (len(one_cell) + sum(n == 2048 for _, n in sizes))


def test_each_place_has_the_least_sum_of_squares():
    r = random.Random(3)
    lengths = [r.randint(1, 30) for _ in range(400)]
    sequence, offset, held = packing.sum_of_squares(np.array(lengths), 30)
    gaps: dict[int, int] = {}
    for i, size in enumerate(lengths):
        def squares(after):
            return sum(n * n for g, n in Counter(after.values()).items() if 0 < g)

        ways = [squares({**gaps, s: g - size}) for s, g in gaps.items() if g >= size]
        new = squares({**gaps, len(gaps): 30 - size})
        at = int(sequence[i])
        assert offset[i] == (30 - gaps[at] if at in gaps else 0)
        gaps[at] = gaps.get(at, 30) - size
        assert squares(gaps) == min([*ways, new])
    assert held.tolist() == [30 - gaps[s] for s in range(len(gaps))]


def test_sequences_hold_the_ids(spark):
    texts = [(i, "some words here " * (i % 7 * 100)) for i in range(40)]
    packed = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), with_ids=True)
    packed = packed.cache()
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        ids = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert ids == r["ids"] and zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == r["ids_crc32"]

"""Quality rules, sharding and mixing against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from cohortlens.llm import jaccard_join, mixing, quality_rules, queries, sharding
from contract.check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    words = WORD.findall(text or "")
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if spans[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_measures_of_edges(edges):
    rows = quality_rules.judge(edges, ["doc_id", "text"]).collect()
    assert len(rows) == edges.count()
    for r in rows:
        want = plain_measures(r.row.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed
        assert not (r.kept and failed)


def test_kept_rows_are_unchanged(edges, nothing):
    kept = quality_rules.keep_good(edges)
    assert kept.columns == edges.columns
    good = {(r.row.doc_id, r.row.text) for r in quality_rules.judge(edges, ["doc_id", "text"]).filter("kept").collect()}
    assert {(r.doc_id, r.text) for r in kept.collect()} == good
    assert quality_rules.keep_good(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR).toPandas()
    want = duck(SF_DIR).execute(queries.ORACLES[name]).df()
    got, want = (x.astype({"refers_to": "Int64"}) if "refers_to" in x else x for x in (got, want))
    assert compare(got, want) == ""


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        used, room = 1, middle
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("fetch", [100_000, 0])
def test_shards(edges, monkeypatch, fetch):
    monkeypatch.setattr(sharding, "FETCH", fetch)
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 20)
    rows = sharding.shard(edges, 8, keep=["text", "size"]).collect()
    assert len(rows) == edges.count()
    import hashlib

    groups, shards_of, filled = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in rows:
        body = (r.row.text or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        key = hashlib.sha256(body).hexdigest()
        groups[key] += r.size
        shards_of[key].add(r.shard)
        filled[r.shard].append((r.slot, r.size))
    assert all(len(s) == 1 for s in shards_of.values())
    order = sorted(groups)
    assert [min(shards_of[k]) for k in order] == sorted(min(shards_of[k]) for k in order)
    for slots in filled.values():
        assert sorted(s for s, _ in slots) == list(range(len(slots)))
    assert max(sum(z for _, z in x) for x in filled.values()) == brute_capacity([groups[k] for k in order], 8)


def test_no_rows_to_shard(nothing):
    assert sharding.shard(nothing).count() == 0


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_targets(edges):
    rows = mixing.mix(edges).collect()
    again = mixing.mix(edges.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == edges.count()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size and r.copies <= 3
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_rows_of_one_id_are_chosen_alike(spark, nothing):
    """Rows that agree in doc_id, source and size, some with equal texts: any order of arrival, one result."""
    rows = [(i % 5, f"one two three four five six {i % 7}", "s" if i % 2 else "t", i % 11, {"m": "x"}) for i in range(120)]
    rows += [(None, "one two three", None, 1, None), (None, "three two one", None, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int, extra map<string,string>")
    shuffled = spark.createDataFrame(rows[::-1], docs.schema).repartition(7)
    for choose in (mixing.take_copies, jaccard_join.keep_one):
        first, second = (sorted(map(str, choose(x).collect())) for x in (docs, shuffled))
        assert first and first == second
    assert mixing.take_copies(nothing).count() == jaccard_join.keep_one(nothing).count() == 0


def test_rounding_keeps_sums_and_expectations(spark):
    """Over many rows and several levels: one row of slack per source, fair shares by size."""
    items = spark.range(20_000).selectExpr(
        "id as h", "if(id % 3 = 0, 'hot', concat('s', id % 2)) as source", "1 + id % 50 as w", "0.4D as p"
    )
    got = mixing.round_fractions(items, cell=32).join(items, ["h", "source"])
    rows = got.selectExpr("source", "w", "x").collect()
    assert len(rows) == 20_000
    want, have, small = Counter(), Counter(), [0, 0]
    for r in rows:
        want[r.source] += 0.4 * r.w
        have[r.source] += r.x * r.w
        small[0] += r.w <= 10
        small[1] += (r.w <= 10) * r.x
    assert all(abs(want[s] - have[s]) <= 50 for s in want)
    assert small[1] / small[0] == pytest.approx(0.4, abs=0.03)


def test_copies_are_taken(edges, nothing):
    mixed = mixing.mix(edges)
    total = mixed.agg({"copies": "sum"}).first()[0]
    taken = mixing.take_copies(edges)
    assert taken.columns == edges.columns and taken.count() == total
    assert mixing.take_copies(nothing).count() == 0

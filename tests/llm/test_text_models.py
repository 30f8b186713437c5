"""Language, tokens, perplexity, leaks and linked documents against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import decontamination, jaccard_join, kneser_ney, language_id, queries, token_counts, wordarrays

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Language identification


def test_held_out_accuracy(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    rows = queries.op1(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(edges, nothing):
    train = edges.select("text", "lang", F.xxhash64("doc_id").alias("key"))
    model = language_id.fit(train)
    assert model.names == ["de", "en"] and model.temperature > 0
    rows = language_id.predict(edges, model, keep=["doc_id", "text", "row"]).collect()
    assert len(rows) == edges.count()
    for r in rows:
        if any(c.isalpha() for c in r.row.text or ""):
            assert r.lang_pred in model.names and 0.5 <= r.score <= 1
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language_id.fit(nothing.select("text", "lang", F.xxhash64("doc_id").alias("key"))) is None
    assert {r.lang_pred for r in language_id.predict(edges, None).collect()} == {"und"}
    assert language_id.predict(nothing, model).count() == 0


def test_elastic_net_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows = [(np.array([k, 10 + rng.integers(50)]), np.array([1.0, 0.1])) for k in (0, 1) * 100]
    w = language_id.ftrl(rows, np.array([0, 1] * 100), 2, language_id.Settings(l1=0.5))
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0]
    assert np.count_nonzero(w) < 20


# Token counts


def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_counts.VOCABULARY)
    return path, Tokenizer.from_file(path)


def test_token_counts_match_the_library(spark, edges, nothing):
    _, library = _library()
    rows = token_counts.count_tokens(edges, keep=["doc_id", "text"]).collect()
    assert len(rows) == edges.count()
    for r in rows:
        text = r.row.text or ""
        assert r.n_bytes == len(text.encode())
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert r.over_limit == (r.n_tokens > 512)
    assert token_counts.count_tokens(nothing).count() == 0


def test_tokens_of_odd_strings():
    path, library = _library()
    r = random.Random(1)
    texts = ["".join(r.choice(" \n\t'sltrevmdaA1!é中 ՘<|>") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += ["aaaaaaaaaaaaaaaaaaaaa", "<|endoftext|><|endoftext|> x", "<|endof" + "text|>", "a  \n", "  b", "'ll'll'd", ""]
    counter = token_counts.Counter(token_counts.vocabulary(path))
    got = np.concatenate([counter.count(x) for x in wordarrays.slices(pa.array(texts), 500)])
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert got.tolist() == want


# Kneser-Ney


def plain_model(texts, order=3):
    fold = lambda c: c.lower()[0] if c.isalpha() else " " if c.isspace() else "0" if c.isdigit() else c
    grams = lambda t: [tuple(("\1" * (order - 1) + "".join(map(fold, t)))[i : i + order]) for i in range(len(t))]
    counts = [Counter(g for t in texts for g in grams(t))]
    for _ in range(order - 1):
        counts.insert(0, Counter(g[1:] for g in counts[0]))
    c1 = counts[0]

    def discount(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1] or not n[2]:
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
        return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]

    levels = []
    for c in counts:
        d = discount(c)
        total, left = Counter(), Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        levels.append((c, d, total, left))

    def p(g):
        value = 1 / (len(c1) + 1)
        for k, (c, d, total, left) in enumerate(levels, start=1):
            own = g[order - k :]
            if total[own[:-1]]:
                n = c[own]
                value = (n - (d[min(n, 3) - 1] if n else 0) + left[own[:-1]] * value) / total[own[:-1]]
        return value

    return lambda t: math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(t))


def lots_and_model(docs, trusted, keep, order):
    lots = kneser_ney.deal(docs, [F.struct(*keep).alias("own"), trusted.alias("sure")], order=order)
    chosen = lots.select("lot", F.posexplode("rows.sure").alias("place", "sure")).filter("sure")
    return lots, kneser_ney.Model(lots, chosen.groupBy("lot").agg(F.collect_list("place").alias("chosen")), order)


@pytest.mark.parametrize("order", [3, 5])
def test_perplexities(spark, edges, order):
    trusted = F.expr("coalesce(length(text) between 1 and 5000 and doc_id >= 100, false)")
    some = edges.filter("text is null or length(text) < 3000")
    want = plain_model([r.text for r in some.filter(trusted).collect()], order)
    lots, model = lots_and_model(some, trusted, ["doc_id", "text", "size"], order)
    rows = kneser_ney.perplexities(lots, model).select("row.own.*", "perplexity").collect()
    assert len(rows) == some.count()
    for r in rows:
        if r.text:
            assert r.perplexity == pytest.approx(want(r.text), rel=1e-9)
        else:
            assert r.perplexity is None


@pytest.mark.parametrize("order", [3, 5])
def test_probabilities_sum_to_one(edges, order):
    _, model = lots_and_model(edges, F.expr("coalesce(doc_id >= 100, false)"), ["doc_id"], order)
    bits = kneser_ney.width(order)
    symbols = [r.key for r in model.tables[1].collect()]
    contexts = [r.context for r in model.tables[order].select("context").distinct().orderBy("context").limit(10).collect()] + [symbols[0]]
    keys = [((context << bits) | c,) for context in contexts for c in [*symbols, 4000]]
    total = defaultdict(float)
    for r in model.probabilities(edges.sparkSession.createDataFrame(keys, "key long")).collect():
        total[r.key >> bits] += math.exp(r.logp)
    assert len(total) == len(contexts) and all(v == pytest.approx(1.0) for v in total.values())


@pytest.mark.parametrize("order", [3, 5])
def test_keys_of_short_and_empty_rows(order):
    texts = ["", "a", "", "Ab9", "中" * 7, ""]
    bits, out = kneser_ney.width(order), []
    fold = {"A": "a", "9": "0"}
    for t in texts:
        codes = [kneser_ney.START] * (order - 1) + [ord(fold.get(c, c)) for c in t]
        codes = [c if c < 1 << bits else 1 << (bits - 1) | c & ((1 << (bits - 1)) - 1) for c in codes]
        out += [sum(c << bits * (order - 1 - j) for j, c in enumerate(codes[i : i + order])) for i in range(len(t))]
    text = next(wordarrays.slices(pa.array(texts)))
    assert kneser_ney.grams(*kneser_ney.symbols(text, order), order).tolist() == out
    single = next(wordarrays.slices(pa.array(["", "x"])))
    assert len(kneser_ney.grams(*kneser_ney.symbols(single, order), order)) == 1


def test_quality_verdicts(spark, edges, nothing):
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(100, 160), 6, None]] + [(6, 1, 0), (14, 0, 0)], "doc_id long, quality int, toxic int")
    rows = kneser_ney.classify(edges, labels).collect()
    assert len(rows) == edges.count()
    for r in rows:
        if r.perplexity is None or r.doc_id == 14:
            assert not r.kept
        elif (r.doc_id or 0) >= 100:
            assert r.kept
    cuts = {r.lang_key: r.threshold for r in kneser_ney.thresholds(spark.range(1, 101).selectExpr("if(id <= 50, 'x', 'y') lang_key", "id / 1.0D perplexity", "id tie"), 0.9).collect()}
    assert cuts == {"x": 45.0, "y": 95.0, "*": 90.0}
    assert kneser_ney.classify(nothing, labels).count() == 0
    assert {r.kept for r in kneser_ney.classify(edges, labels.filter("quality > 5")).filter("length(coalesce(lang, '')) >= 0 and perplexity is null").collect()} == {True, False}


# Decontamination

ITEM = "On Monday the farmer John sold 12 apples and 5 pears to Mary, then John walked 12 km back home with 7 coins."


def swapped(text, *pairs):
    for a, b in pairs:
        text = text.replace(a, b)
    return text


LEAKS = {
    1: ITEM,
    2: "Prefix words here. " + ITEM.upper() + " and a tail",
    3: swapped(ITEM, ("John", "Peter"), ("Mary", "Anna"), ("12", "31"), ("5", "8")),
    4: swapped(ITEM, ("John", "Peter Paul")),
}
CLEAN = {
    5: swapped(ITEM, ("12 apples", "99 apples"), ("John sold", "Mary sold")),  # slots disagree
    6: "On Monday the weather was fine and nobody sold apples.",
    7: "1 2 3 4 5 6 7 8 9 10 11 12",
    8: None,
    9: "",
}


def test_leaks_and_slots(spark, nothing):
    texts = [*LEAKS.items(), *CLEAN.items(), (None, ITEM), (1, ITEM)]
    docs = spark.createDataFrame([(i, t, "r", "w") for i, t in texts], "doc_id long, text string, row string, `window` string")
    bench = spark.createDataFrame([(0, ITEM), (1, None), (2, ""), (3, "two words"), (4, "9 9 9 9 9 9 9"), (0, ITEM)], "item_id long, text string")
    found = decontamination.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, 0) for i in [*LEAKS, None]}
    kept = decontamination.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(CLEAN)
    assert decontamination.find_leaks(nothing, bench).count() == 0
    assert decontamination.drop_leaks(docs, bench.limit(0)).count() == docs.count()


STORY = "If John has 5 apples and buys 7 more from Mary before John gives 3 away to Mary"


def test_copies_in_running_text_are_found(spark):
    before = ["the ", "(", '"', "1) ", "| ", "see Paul ", "as said: "]
    other = swapped(STORY, ("John", "Peter"), ("Mary", "Anna"))
    copies = [a + text + b for a in before for text in (STORY, other) for b in ("", " Smith went home", ") and so on")]
    copies.append("see " + swapped(STORY, ("before John", "before Mary")))  # most windows are there word for word
    shape = ["the " + swapped(other, ("5 apples", "3 apples")), "see " + swapped(other, ("before Peter", "before Anna"))]
    short = ["What is the capital of France?"]
    docs = [(i, t) for i, t in enumerate([*copies, *shape, f'They asked "{short[0]}" again'])]
    bench = spark.createDataFrame([(0, STORY), (0, STORY), (0, STORY), (1, short[0])], "item_id long, text string")
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    want = {(i, 0) for i in range(len(copies))} | {(len(docs) - 1, 1)}
    assert {(r.doc_id, r.item_id) for r in found} == want


POOR = [
    "Compute 12 + 37 * 4 - 8 / 2",
    "Barack Obama Met Angela Merkel In Berlin On Monday Morning",
    "Multiply 45 by 46",
    "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9 3",
    "Ada Bell, Carl Dorn, Eva Falk, Gus Hahn, Ida Jung, Kai Lang",
    "In 1990 Bonn And 1991 Berlin",
]


def test_items_poor_in_plain_words_are_found(spark):
    around = [("", ""), ("the ", " Then"), ("see Paul ", " 7"), ("1) ", " and so on"), ('He said "', '" once')]
    docs = [(10 * i + k, a + t + b) for i, t in enumerate(POOR) for k, (a, b) in enumerate(around)]
    other = ["Compute 13 + 38 * 5 - 9 / 3", "Joe Biden Met Olaf Scholz In Paris On Friday Evening", "Multiply 45 by 47", "2 7 1 8 2 8 1 8 2 8 4 5 9 0 4 5"]
    docs += [(1000 + i, t) for i, t in enumerate(other)]
    bench = spark.createDataFrame(list(enumerate(POOR)), "item_id long, text string")
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(10 * i + k, i) for i in range(len(POOR)) for k in range(len(around))}
    assert all(r.coverage > 0.5 for r in found)


def test_planted_leaks_are_found(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text").collect()
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    squeezed = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    want = {(d.doc_id, i.item_id) for d in docs for i in items if squeezed(i.text) in squeezed(d.text)}
    got = {(r.doc_id, r.item_id) for r in queries.op6(spark, "/root/testdata/sf0.01").collect()}
    assert want and got == want


# Jaccard join


def plain_classes(texts, percent=75):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    return sets, [find(i) for i in range(len(texts))]


def check_links(df, key="doc_id"):
    rows = jaccard_join.link_classes(df, keep=["doc_id", "text"]).collect()
    sets, label = plain_classes([r.row.text for r in rows])
    least = {}
    for r, own in zip(rows, label):
        if r.row.doc_id is not None:
            least[own] = min(least.get(own, r.row.doc_id), r.row.doc_id)
    for r, s, own in zip(rows, sets, label):
        assert r.n_shingles == len(s)
        assert r.component_id == (least.get(own) if s else r.row.doc_id)
    return rows


def test_links_of_edges(edges, nothing):
    assert len(check_links(edges)) == edges.count()
    assert jaccard_join.link_classes(nothing).count() == 0


@pytest.mark.parametrize("tile", [100_000, 8])
def test_near_copies_and_chains(spark, monkeypatch, tile):
    """A large group of near copies, chains that link only step by step, and a frequent passage."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(100)], [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(r.randint(1, 4)):
            own[r.randrange(100)] = word()
        texts.append(" ".join(own))
    chain = [word() for _ in range(80)]
    for step in range(20):
        texts.append(" ".join(chain[step * 3 :] + [word() for _ in range(step)]))
    texts += [" ".join(passage + [word() for _ in range(r.randint(5, 30))]) for _ in range(40)]
    check_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))


def test_bound_never_hides_a_link():
    r = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, 120).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: r.integers(80, 120)], r.integers(0, 2**63, 30).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        counts = np.array([jaccard_join._counts(a), jaccard_join._counts(b)])
        assert np.minimum(*counts.astype(int)).sum() >= shared
        linked = 100 * shared >= 75 * (len(a) + len(b) - shared)
        pairs = jaccard_join.tree_pairs(counts, np.array([len(a), len(b)]), np.array([1, 2]), 75)
        assert pairs or not linked


def test_finer_groups_part_long_sets_that_share_half():
    r = np.random.default_rng(9)
    draw = lambda k: r.integers(0, 2**64, k, dtype=np.uint64)
    for size in (300, 700, 1600, 5000, 20_000):
        shared = draw(size // 2)
        sets = [np.unique(np.concatenate([shared, draw(size // 2 + k)])) for k in range(0, 60, 10)]
        near = np.unique(np.concatenate([sets[0][: size * 9 // 10], draw(size // 40)]))
        fine = [jaccard_join._counts(x) for x in [*sets, near]]
        n = np.array([len(x) for x in [*sets, near]])
        assert jaccard_join.tree_pairs(fine, n, np.arange(len(n)), 75) == [(0, len(sets))]
    full = np.full(70_000, 5, dtype=np.uint64)  # one group that overflows
    fine = [jaccard_join._counts(full), jaccard_join._counts(full[:-9])]
    assert jaccard_join.tree_pairs(fine, np.array([70_000, 69_991]), np.arange(2), 75) == [(0, 1)]


def test_one_of_each_class_stays(edges, nothing):
    kept = jaccard_join.keep_one(edges)
    assert kept.columns == edges.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    rows = edges.select("doc_id", "text").collect()
    sets, label = plain_classes([r.text for r in rows])
    classes = {own for own, s in zip(label, sets) if s}
    assert sum(n for (_, t), n in got.items() if WORD.search(t or "")) == len(classes)
    assert sum(n for (_, t), n in got.items() if not WORD.search(t or "")) == sum(not s for s in sets)
    assert jaccard_join.keep_one(nothing).count() == 0


# Pipeline


def test_pipeline(spark):
    docs = queries.documents(spark, SF_DIR)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    got = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(str, got.collect())) == sorted(map(str, last.collect()))
    assert got.count() == docs.count() > 0

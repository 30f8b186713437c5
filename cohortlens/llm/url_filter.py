"""URL filters: rules first, boosted trees on lexical features for the rest.

Features are column expressions over the URL: lengths, depth, digit ratio, entropy,
parameter counts, and how urls of the same suffix were judged. The trees learn from
URLs that a rule judges, at most ``Settings.max_rows`` of them, drawn by hash; suffix
statistics count all of them. Scores come from the fitted trees written out as one
expression, so scoring is a projection.

Edge cases: a null URL or one without ``://`` has an empty host and path and no rule,
and is judged by the trees on its (empty) features; URLs of any length are read whole;
repeated rows are judged alike; without labelled URLs of both kinds there is nothing to
learn and the URLs without a rule are allowed; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import storage

# Fixed values: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789-_./%=&"
FEATURES = (
    "length host_length path_length depth labels digit_ratio hyphens entropy params query_length "
    "has_fragment is_https suffix_blocked suffix_allowed suffix_seen"
).split()


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled URLs that the trees are fitted on."""

    max_rows: int = 20_000
    trees: int = 10
    depth: int = 4
    step: float = 0.3
    seed: int = 11
    prior: float = 20.0  # pseudo-counts of the overall rate in a suffix rate


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, at, start = rule
    return ((host == at) | host.endswith("." + at)) & path.startswith(start)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = _fits(host, path, rule)
        text = F.when(fits, F.lit(rule[1] + rule[2])).otherwise(text)
        verdict = F.when(fits, F.lit(rule[0])).otherwise(verdict)
    return text, verdict


def _entropy(text: Column) -> Column:
    """Bits per character over a fixed set of symbols, and one class for all others."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS]
    rest = F.length(F.regexp_replace(text, r"[a-z0-9\-_./%=&]+", ""))
    out = F.lit(0.0)
    for c in [*counts, rest]:
        share = c.cast("double") / n
        out = out - F.when(c > 0, share * F.log2(share)).otherwise(0.0)
    return out


def lexical(pages: DataFrame, keep: Sequence[str], url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Struct ``row`` of kept columns, host, path, rule, verdict of the rule, and features."""
    raw = F.coalesce(F.col(url), F.lit(""))
    out = pages.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"),
        raw.alias("url"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    small = F.translate(F.col("url"), UPPER, LOWER)
    query = F.regexp_extract("url", r"(?s)\?([^#]*)", 1)
    length = F.length("url")
    number = lambda c: c.cast("double")
    return out.select(
        "row",
        "host",
        "path",
        rule.alias("rule"),
        verdict.alias("by_rule"),
        "url",
        number(length).alias("length"),
        number(F.length("host")).alias("host_length"),
        number(F.length("path")).alias("path_length"),
        number(F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).alias("depth"),
        number(F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))).alias("labels"),
        (number(length - F.length(F.regexp_replace("url", "[0-9]+", ""))) / F.greatest(length, F.lit(1))).alias("digit_ratio"),
        number(length - F.length(F.replace("url", F.lit("-"), F.lit("")))).alias("hyphens"),
        _entropy(small).alias("entropy"),
        number(F.when(F.length(query) > 0, F.regexp_count(query, F.lit("&")) + 1).otherwise(0)).alias("params"),
        number(F.length(query)).alias("query_length"),
        number(F.col("url").contains("#")).alias("has_fragment"),
        number(small.startswith("https:")).alias("is_https"),
    )


def suffix_statistics(rows: DataFrame, prior: float) -> DataFrame:
    """Per last label of a host, over all URLs: blocked and allowed shares, drawn towards the overall ones."""
    bad, good = F.col("by_rule").eqNullSafe("block"), F.col("by_rule").eqNullSafe("allow")
    sums = [F.sum(bad.cast("double")).alias("bad"), F.sum(good.cast("double")).alias("good"), F.count("*").alias("n")]
    whole = rows.agg(*sums).select((F.col("bad") / F.col("n")).alias("b"), (F.col("good") / F.col("n")).alias("g")).first()
    base_bad, base_good = (whole.b or 0.0), (whole.g or 0.0)
    per = rows.groupBy(public_suffix(F.col("host")).alias("suffix")).agg(*sums)
    return per.select(
        "suffix",
        ((F.col("bad") + base_bad * prior) / (F.col("n") + prior)).alias("suffix_blocked"),
        ((F.col("good") + base_good * prior) / (F.col("n") + prior)).alias("suffix_allowed"),
        F.log1p(F.col("n").cast("double")).alias("suffix_seen"),
    )


def public_suffix(host: Column) -> Column:
    """The last label of a host."""
    return F.regexp_extract(host, r"([^.]*)$", 1)


def _tree(node) -> Column:
    """A fitted regression tree as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    goes_left = F.col(FEATURES[split.featureIndex()]) <= F.lit(float(split.threshold()))
    return F.when(goes_left, _tree(node.leftChild())).otherwise(_tree(node.rightChild()))


def fit(rows: DataFrame, settings: Settings) -> Column | None:
    """The probability that a URL is to be blocked, as an expression over the features."""
    labelled = rows.filter(F.col("by_rule").isNotNull())
    n, kinds = labelled.agg(F.count("*"), F.countDistinct("by_rule")).first()
    if kinds < 2:
        return None
    share = min(1.0, settings.max_rows / n)
    drawn = labelled.filter(F.pmod(F.xxhash64(F.lit(settings.seed), "url"), F.lit(1 << 30)) < int(share * (1 << 30)))
    data = drawn.select((F.col("by_rule") == "block").cast("double").alias("label"), *FEATURES)
    # At most max_rows rows, in one order, so that reruns fit the same trees.
    data = data.repartition(1).sortWithinPartitions("label", *FEATURES)
    data = storage.materialize(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data), "url_train")
    model = GBTClassifier(
        maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.step, seed=settings.seed, cacheNodeIds=False
    ).fit(data.select("label", "features"))
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights):
        margin = margin + _tree(tree._call_java("rootNode")) * float(weight)
    return 1.0 / (1.0 + F.exp(-2.0 * margin))


def judge(
    pages: DataFrame,
    keep: Sequence[str] = ("page_id",),
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    settings: Settings = Settings(),
) -> DataFrame:
    """Struct ``row`` of kept columns, host, path, rule, verdict and the trees' ``score``."""
    rows = lexical(pages, keep, url, rules)
    statistics = storage.materialize(suffix_statistics(rows, settings.prior), "url_suffixes")
    rows = rows.withColumn("suffix", public_suffix(F.col("host"))).join(statistics, "suffix")
    score = fit(rows, settings)
    score = F.lit(0.0) if score is None else score
    rows = rows.withColumn("score", score)
    learned = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("row", "host", "path", "rule", F.coalesce("by_rule", learned).alias("verdict"), "score")

"""Embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import vectors as ops
from contract.registry import query, rounded
from contract.tables import V, table, vectors

TOKENS = ["w1", "w2", "w7", "w40"]
TRIPLES = [("w1", "w2", "w3"), ("w4", "w5", "w6"), ("w7", "w8", "w9")]


def _flat(df, *keys):
    """One row per vector element."""
    return df.select(*keys, F.posexplode("vec").alias("i", "x"))


@query(
    "embedding_lookup",
    f"WITH {V} SELECT token, i::INTEGER - 1 AS i, round(vec[i], 6) AS x FROM v, unnest(range(1, len(vec) + 1)) t(i) WHERE token IN ('w1', 'w2', 'w7', 'w40')",
)
def embedding_lookup(spark, d):
    return rounded(_flat(ops.lookup(vectors(spark, d), TOKENS), "token"), "x")


@query("embedding_shape", f"WITH {V} SELECT count(*) AS vocab_size, max(len(vec)) AS dimension FROM v")
def embedding_shape(spark, d):
    return ops.shape(vectors(spark, d))


def _tokens(spark, d):
    """Every third token of the table by name, the others unknown to it."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("pos"),
        F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("w"), "vec_id"))
        .otherwise(F.concat(F.lit("new"), "vec_id"))
        .alias("token"),
    )


_CUSTOM = f"""WITH {V}, tk AS (SELECT vec_id AS pos, CASE WHEN vec_id % 3 = 0 THEN 'w' ELSE 'new' END || vec_id AS token FROM embeddings),
  dm AS (SELECT max(len(vec)) AS n FROM v),
  cm AS (SELECT pos, tk.token, vec IS NOT NULL AS is_pretrained, coalesce(vec, list_transform(range(1, n + 1), lambda i:
      (('0x' || substr(md5(tk.token || ':' || i), 1, 8))::BIGINT / 4294967296 * 2 - 1) * sqrt(6 / (n + 1)))) AS vec
    FROM tk CROSS JOIN dm LEFT JOIN v USING (token))
SELECT pos, token, is_pretrained, i::INTEGER - 1 AS i, round(vec[i], 6) + 0 AS x FROM cm, unnest(range(1, len(vec) + 1)) t(i)"""


@query("embedding_custom", _CUSTOM)
def embedding_custom(spark, d):
    out = ops.custom_matrix(_tokens(spark, d), vectors(spark, d))
    return rounded(_flat(out, "pos", "token", "is_pretrained"), "x")


@query(
    "join_lookup_fallback",
    f"""WITH c AS ({_CUSTOM}) SELECT is_pretrained, count(DISTINCT pos) AS n_tokens, count(*) AS n_values,
      bool_and(is_pretrained OR abs(x) <= sqrt(6 / 65)) AS in_bounds FROM c GROUP BY 1""",
)
def join_lookup_fallback(spark, d):
    out = _flat(ops.custom_matrix(_tokens(spark, d), vectors(spark, d)), "pos", "is_pretrained")
    return out.groupBy("is_pretrained").agg(
        F.count_distinct("pos").alias("n_tokens"),
        F.count("*").alias("n_values"),
        F.bool_and(F.col("is_pretrained") | (F.abs("x") <= F.sqrt(F.lit(6.0 / 65)))).alias("in_bounds"),
    )


@query(
    "nearest_neighbors",
    f"""WITH {V}, q AS (SELECT token AS query, vec AS qv FROM v WHERE token IN ('w1', 'w2', 'w7', 'w40')),
      s AS (SELECT query, idx, token, list_distance(vec, qv) AS list_distance, round(list_distance(vec, qv), 6) AS distance FROM v CROSS JOIN q)
    SELECT query, idx, token, distance, (row_number() OVER (PARTITION BY query ORDER BY list_distance, idx))::INTEGER AS rank FROM s
    QUALIFY rank <= 10""",
)
def nearest_neighbors(spark, d):
    table = vectors(spark, d)
    queries = ops.lookup(table, TOKENS).select(F.col("token").alias("query"), "vec")
    return rounded(ops.nearest_neighbors(queries, table, 10), "distance")


@query(
    "analogy",
    f"""WITH {V}, t(w1, w2, w3) AS (VALUES ('w1', 'w2', 'w3'), ('w4', 'w5', 'w6'), ('w7', 'w8', 'w9')),
      q AS (SELECT w1, w2, w3, list_transform(range(1, len(a.vec) + 1), lambda i: c.vec[i] + (b.vec[i] - a.vec[i])) AS qv
        FROM t JOIN v a ON a.token = w1 JOIN v b ON b.token = w2 JOIN v c ON c.token = w3),
      s AS (SELECT w1, w2, w3, v.token, row_number() OVER (PARTITION BY w1, w2, w3
          ORDER BY list_distance(v.vec, qv), idx) AS rk FROM q CROSS JOIN v)
    SELECT w1, w2, w3, coalesce(string_agg(w1 || ' : ' || w2 || ' :: ' || w3 || ' : ' || token, chr(10) ORDER BY rk)
        FILTER (WHERE token NOT IN (w1, w2, w3)), 'Could not find nearest neighbors for computed vector!') AS answer
    FROM s WHERE rk <= 4 GROUP BY w1, w2, w3""",
)
def analogy(spark, d):
    triples = spark.createDataFrame(TRIPLES, "w1 string, w2 string, w3 string")
    return ops.analogy(triples, vectors(spark, d))


def _every_twentieth(spark, d):
    found = vectors(spark, d)
    return found, found.filter(F.col("idx") % 20 == 0).select(F.col("idx").alias("query"), "vec")


@query("approx_nearest_neighbors")
def approx_nearest_neighbors(spark, d):
    """About ten nearest rows of every twentieth row; near_neighbor_recall holds them against all rows."""
    table, queries = _every_twentieth(spark, d)
    return rounded(ops.approx_nearest_neighbors(queries, table, 10), "distance")


@query(
    "many_nearest_neighbors",
    f"""WITH {V}, s AS (SELECT q.idx AS query, v.idx, v.token, list_distance(v.vec, q.vec) AS far FROM v JOIN v q ON q.idx % 20 = 0)
    SELECT query, idx, token, round(far, 6) AS distance, (row_number() OVER (PARTITION BY query ORDER BY far, idx))::INTEGER AS rank FROM s
    QUALIFY rank <= 10""",
)
def many_nearest_neighbors(spark, d):
    table, queries = _every_twentieth(spark, d)
    return rounded(ops.nearest_neighbors(queries, table, 10), "distance")


@query(
    "near_neighbor_recall",
    f"""WITH {V} SELECT count(*) FILTER (WHERE idx % 20 = 0) AS n_queries,
      count(*) FILTER (WHERE idx % 20 = 0) * least(10, count(*)) AS n_exact, true AS recalled FROM v""",
)
def near_neighbor_recall(spark, d):
    """Whether the forest finds at least nine tenths of the exact neighbours."""
    table, queries = _every_twentieth(spark, d)
    exact = ops.nearest_neighbors(queries, table, 10).select("query", "idx", F.lit(1).alias("exact"))
    found = ops.approx_nearest_neighbors(queries, table, 10).select("query", "idx", F.lit(1).alias("found"))
    both = exact.join(found, ["query", "idx"], "left")
    return both.agg(
        F.count_distinct("query").alias("n_queries"), F.sum("exact").alias("n_exact"),
        (F.sum("found") >= 0.9 * F.sum("exact")).alias("recalled"),
    )

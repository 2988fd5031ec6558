"""Retrieval queries over embeddings and phrases. Queries are all rows whose id is divisible by
100, against all rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as X
from ..operators import retrieval
from .common import Plans

PLANS = Plans()
query = PLANS.query

_DENSE = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS asked FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, asked, vec_id AS row_id, label AS concept_id, round(list_inner_product(q, embedding::DOUBLE[]), 9) AS score FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s)
"""


def _dense(t, k):
    """The k nearest other rows of each query, with their label as concept."""
    e = t("embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.dense_topk(asked, e.select(F.col("vec_id").alias("row_id"), "embedding"), k + 1).where("row_id <> query_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))).where(F.col("rank") <= k)
    return found.join(e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("concept_id")), "row_id")


@query(f"WITH {_DENSE} SELECT query_id, row_id, round(score, 5) AS score, rank FROM r WHERE rank <= 128")
def dense_topk(t):
    return _dense(t, 128).select("query_id", "row_id", F.round("score", 5).alias("score"), F.col("rank").cast("long"))


@query(f"""
WITH {_DENSE}, f AS (SELECT query_id, concept_id, min(rank) AS raw_rank FROM r WHERE rank <= 128 GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, concept_id, raw_rank, row_number() OVER (PARTITION BY query_id ORDER BY raw_rank) AS distinct_rank FROM f) WHERE distinct_rank <= 16
""")
def dense_first_per_concept(t):
    out = retrieval.first_per_concept(_dense(t, 128), 16)
    return out.select("query_id", "concept_id", F.col("raw_rank").cast("long"), F.col("distinct_rank").cast("long"))


def _lanes(t):
    """Dense ranks of labels; a lexical lane in order of label, and one by reversed dense rank."""
    first = retrieval.first_per_concept(_dense(t, 128), 64).select("query_id", "concept_id", F.col("raw_rank").alias("rank"))
    lexical = first.where("concept_id % 2 = 0").select("query_id", "concept_id", (F.col("concept_id") + 1).alias("rank"))
    context = first.where("concept_id % 3 = 0").select("query_id", "concept_id", (F.lit(200) - F.col("rank")).alias("rank"))
    return first, lexical, context


_LANES = f"""
{_DENSE}, a AS (SELECT query_id, concept_id, min(rank) AS dense_rank FROM r WHERE rank <= 128 GROUP BY 1, 2),
l AS (SELECT query_id, concept_id, dense_rank, CASE WHEN concept_id % 2 = 0 THEN concept_id + 1 END AS lexical_rank, CASE WHEN concept_id % 3 = 0 THEN 200 - dense_rank END AS context_rank FROM a)
"""


@query(f"""
WITH {_LANES}, c AS (SELECT *, round(0.8 / (60 + dense_rank) + coalesce(0.2 / (60 + lexical_rank), 0) + coalesce(0.8 / (60 + context_rank), 0), 12) AS combined FROM l)
SELECT query_id, concept_id, round(combined, 8) AS combined, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, context_rank NULLS LAST, concept_id) AS fused_rank FROM c
""")
def rrf_fusion(t):
    return retrieval.fuse(*_lanes(t)).select("query_id", "concept_id", F.round("combined", 8).alias("combined"), F.col("fused_rank").cast("long"))


@query(f"""
WITH {_LANES}, w AS (SELECT CAST(unnest([0.0, 0.2, 0.5, 0.8, 1.0]) AS DOUBLE) AS weight),
f AS (SELECT weight, l.query_id, concept_id, row_number() OVER (PARTITION BY weight, l.query_id ORDER BY round(weight / (60 + dense_rank) + coalesce((1 - weight) / (60 + lexical_rank), 0), 12) DESC, concept_id) AS rank FROM l, w),
b AS (SELECT weight, f.query_id, min(CASE WHEN concept_id = asked THEN rank END) AS best FROM f JOIN q USING (query_id) GROUP BY 1, 2)
SELECT weight, k, round(avg(CASE WHEN best <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall FROM b, (SELECT unnest([1, 2, 4, 8]) AS k) GROUP BY weight, k
""")
def weight_sweep_recall(t):
    first, lexical, _ = _lanes(t)
    lanes = first.join(lexical.withColumnRenamed("rank", "lexical_rank"), ["query_id", "concept_id"], "left")
    weights = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.2, 0.5, 0.8, 1.0)]))
    rows = lanes.withColumn("weight", weights)
    score = F.round(F.col("weight") / (60 + F.col("rank")) + F.coalesce((1 - F.col("weight")) / (60 + F.col("lexical_rank")), F.lit(0.0)), 12)
    order = Window.partitionBy("weight", "query_id").orderBy(F.desc(score), "concept_id")
    rows = rows.withColumn("place", F.row_number().over(order))
    truth = t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"))
    best = rows.join(truth, "query_id").groupBy("weight", "query_id").agg(F.min(F.when(F.col("concept_id") == F.col("asked"), F.col("place"))).alias("best"))
    at = best.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))))
    return at.groupBy("weight", "k").agg(F.round(F.avg(F.when(F.col("best") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("recall"))


@query(f"""
WITH {_DENSE}, b AS (SELECT query_id, min(CASE WHEN concept_id = asked THEN rank END) AS best FROM r WHERE rank <= 128 GROUP BY 1)
SELECT k, round(avg(CASE WHEN best <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall FROM b, (SELECT unnest([1, 8, 16, 32, 64]) AS k) GROUP BY k
""")
def recall_at_k(t):
    truth = t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("concept_id"))
    out = retrieval.recall_at(_dense(t, 128), truth, [1, 8, 16, 32, 64])
    return out.select("k", F.round("recall", 6).alias("recall"))


@query(f"""
WITH {_DENSE} SELECT query_id, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 5) AS margin,
  count(*) FILTER (rank <= 8 AND score >= (SELECT max(score) FROM r x WHERE x.query_id = r.query_id) - 0.02) AS near_ties
FROM r GROUP BY query_id
""")
def score_margins(t):
    """Top score less the second (null with one candidate), and candidates near the top."""
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = _dense(t, 128).withColumns({"next": F.lead("score").over(w), "top": F.max("score").over(Window.partitionBy("query_id"))})
    near = (F.col("rank") <= 8) & (F.col("score") >= F.col("top") - 0.02)
    return rows.groupBy("query_id").agg(F.round(F.max(F.when(F.col("rank") == 1, F.col("score") - F.col("next"))), 5).alias("margin"), F.count_if(near).alias("near_ties"))


@query(f"""
WITH {_LANES}, k AS (SELECT DISTINCT label AS concept_id FROM embeddings WHERE label < 3),
have AS (SELECT query_id, concept_id, dense_rank FROM l WHERE dense_rank <= 20),
m AS (SELECT query_id, concept_id, 0 AS own, NULL::BIGINT AS rank FROM (SELECT query_id FROM q), k WHERE (query_id, concept_id) NOT IN (SELECT (query_id, concept_id) FROM have)),
u AS (SELECT * FROM m UNION ALL SELECT query_id, concept_id, 1, dense_rank FROM have)
SELECT * FROM (SELECT query_id, concept_id, row_number() OVER (PARTITION BY query_id ORDER BY own, rank NULLS FIRST, concept_id) AS place FROM u) WHERE place <= 8
""")
def injected_candidates(t):
    have = retrieval.first_per_concept(_dense(t, 128), 64).where("raw_rank <= 20").select("query_id", "concept_id", "score", F.col("raw_rank").alias("rank"))
    asked = t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    known = t("embeddings").where("label < 3").select(F.col("label").alias("concept_id")).distinct()
    recognised = asked.crossJoin(F.broadcast(known))
    return retrieval.inject(have, recognised, 8).select("query_id", "concept_id", F.col("place").cast("long"))


_CORPUS = "c AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS phrase FROM part)"


@query(f"""
WITH {_CORPUS}, q AS (SELECT DISTINCT lower(p_name) AS query FROM part WHERE p_partkey % 100 = 0),
gram AS (SELECT kind, phrase, substr(w, i, n) AS gram FROM (
  SELECT kind, phrase, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM (
    SELECT kind, phrase, w, unnest(range(2, least(5, length(w)) + 1)) AS n FROM (
      SELECT kind, phrase, ' ' || unnest(string_split(phrase, ' ')) || ' ' AS w FROM (SELECT 'c' AS kind, phrase FROM c UNION ALL SELECT 'q', query FROM q)) WHERE w <> '  '))),
tf AS (SELECT kind, phrase, gram, count(*) AS tf FROM gram GROUP BY ALL),
idf AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM c)) / (1 + count(*))) + 1 AS idf FROM tf WHERE kind = 'c' GROUP BY gram),
w AS (SELECT kind, phrase, gram, tf * idf AS w FROM tf JOIN idf USING (gram)),
n AS (SELECT kind, phrase, sqrt(sum(w * w)) AS norm FROM w GROUP BY kind, phrase),
u AS (SELECT kind, phrase, gram, w / norm AS w FROM w JOIN n USING (kind, phrase)),
s AS (SELECT a.phrase AS query, b.phrase AS phrase, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b ON a.gram = b.gram WHERE a.kind = 'q' AND b.kind = 'c' GROUP BY 1, 2)
SELECT query, count(*) AS n, round(max(score), 4) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, phrase) AS rank FROM s) WHERE rank <= 128 GROUP BY query
""")
def tfidf_charwb_topk(t):
    corpus = t("part").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("phrase")).distinct()
    asked = t("part").where("p_partkey % 100 = 0").select(F.lower("p_name").alias("query")).distinct()
    found = retrieval.sparse_topk(asked, corpus, 128)
    return found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 4).alias("best"))


@query(None)
def fuzzy_best_match(t):
    """For each reference phrase the extracted phrase it is most like; ties by phrase."""
    names = t("part").select(X.normalize_phrase(F.col("p_name")).alias("name")).distinct()
    asked = t("part").where("p_partkey % 100 = 0").select(X.normalize_phrase(F.concat_ws(" ", "p_brand", "p_name")).alias("reference")).distinct()
    pairs = asked.crossJoin(F.broadcast(names)).withColumn("score", F.round(fuzzy.fuzzy_weighted("reference", "name"), 6))
    return pairs.groupBy("reference").agg(F.max_by(F.struct("name", "score"), F.struct("score", "name")).alias("b")).select("reference", "b.*")


@query("""
WITH c AS (SELECT DISTINCT lower(p_name) AS phrase FROM part), q AS (SELECT DISTINCT lower(p_name) AS query FROM part WHERE p_partkey % 100 = 0),
w AS (SELECT query, list_filter(string_split(query, ' '), lambda x: length(x) > 2) AS a, phrase, string_split(phrase, ' ') AS b FROM q, c),
s AS (SELECT query, phrase, 100.0 * len(list_intersect(list_distinct(a), b)) / len(list_distinct(a)) AS score FROM w WHERE len(a) > 0)
SELECT query, phrase, round(score, 6) AS score FROM s WHERE score > 0
""")
def token_overlap(t):
    names = t("part").select(F.lower("p_name").alias("phrase")).distinct()
    asked = names.join(t("part").where("p_partkey % 100 = 0").select(F.lower("p_name").alias("phrase")).distinct(), "phrase", "left_semi").withColumnRenamed("phrase", "query")
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 2))
    q = asked.select("query", F.size(words("query")).alias("n"), F.explode(words("query")).alias("w"))
    c = names.select("phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("w"))
    return q.join(c, "w").groupBy("query", "phrase").agg(F.round(100.0 * F.count(F.lit(1)) / F.first("n"), 6).alias("score"))

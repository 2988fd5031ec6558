"""Statistics queries over labels, documents and per-order scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.metrics import Z95
from ..operators import scoring, stats
from .common import Plans
from .scoring import _SETS, rounded, sides

PLANS = Plans()
query = PLANS.query

_STRATA = f"""
g AS (SELECT lang || '|' || source AS stratum, count(*) AS observations, count(*) FILTER (quality = 1) AS matches FROM labels JOIN documents USING (doc_id) GROUP BY 1),
s AS (SELECT *, (matches + 1) / (observations + 2)::DOUBLE AS probability, greatest(0.0, (matches / observations::DOUBLE + {Z95} * {Z95} / (2 * observations)
  - {Z95} * sqrt(matches / observations::DOUBLE * (1 - matches / observations::DOUBLE) / observations + {Z95} * {Z95} / (4.0 * observations * observations))) / (1 + {Z95} * {Z95} / observations)) AS lower_95 FROM g)
"""


def _strata(t):
    rows = t("labels").join(t("documents").select("doc_id", "lang", "source"), "doc_id")
    return rounded(stats.strata(rows.select(F.concat_ws("|", "lang", "source").alias("stratum"), (F.col("quality") == 1).alias("correct"))), "probability", "lower_95")


@query(f"WITH {_STRATA} SELECT stratum, observations, matches, round(probability, 6) AS probability, round(lower_95, 6) AS lower_95 FROM s")
def calibration_strata(t):
    return _strata(t)


_PREFIX = f"""
{_STRATA}, o AS (SELECT *, row_number() OVER w AS k, CAST(sum(observations) OVER w AS BIGINT) AS accepted, CAST(sum(matches) OVER w AS BIGINT) AS correct FROM s
  WINDOW w AS (ORDER BY round(probability, 6) DESC, round(lower_95, 6) DESC, stratum ROWS UNBOUNDED PRECEDING)),
x AS (SELECT stratum, k, accepted, correct, round(correct::DOUBLE / accepted, 6) AS precision, round(correct::DOUBLE / (SELECT count(*) FROM labels WHERE quality = 1), 6) AS recall FROM o)
"""


@query(f"WITH {_PREFIX} SELECT * FROM x")
def policy_prefix(t):
    total = t("labels").where("quality = 1").agg(F.count(F.lit(1)).alias("total"))
    rows = _strata(t).crossJoin(F.broadcast(total))
    out = stats.policy_prefixes(rows, F.col("total"))
    return rounded(out.select("stratum", "k", "accepted", "correct", "precision", "recall"), "precision", "recall")


@query(f"WITH {_PREFIX} SELECT k, stratum, precision, recall FROM x WHERE precision >= 0.5 ORDER BY recall DESC, precision DESC, k LIMIT 1")
def best_policy(t):
    total = t("labels").where("quality = 1").agg(F.count(F.lit(1)).alias("total"))
    out = rounded(stats.policy_prefixes(_strata(t).crossJoin(F.broadcast(total)), F.col("total")), "precision", "recall")
    return stats.best_prefix(out, 0.5)


_GRID = """
d AS (SELECT least(1.0, n_chars / 5000.0)::DOUBLE AS score, quality = 1 AS correct FROM labels JOIN documents USING (doc_id)),
s AS (SELECT least(100, greatest(0, floor(score * 100 + 1e-9)))::INT AS s, correct FROM d),
g AS (SELECT i, count(*) FILTER (correct AND s >= i) AS tp, count(*) FILTER (NOT correct AND s >= i) AS fp, count(*) FILTER (correct AND s < i) AS fn FROM (SELECT unnest(range(0, 101)) AS i), s GROUP BY i),
m AS (SELECT *, i / 100.0::DOUBLE AS threshold, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM g)
"""


def _grid(t):
    rows = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return stats.threshold_grid(rows.select(F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"), (F.col("quality") == 1).alias("correct")))


@query(f"WITH {_GRID} SELECT round(threshold, 2) AS threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def threshold_grid(t):
    return rounded(_grid(t), "precision", "recall", "f1").withColumn("threshold", F.round("threshold", 2))


@query(f"WITH {_GRID} SELECT round(threshold, 2) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m ORDER BY round(m.f1, 12) DESC, round(m.recall, 12) DESC, m.threshold LIMIT 1")
def best_threshold(t):
    return rounded(stats.best_threshold(_grid(t)), "precision", "recall", "f1").withColumn("threshold", F.round("threshold", 2))


@query("""
WITH p AS (SELECT source AS name, (1 + count(*) FILTER (quality = 0)) / (count(*) * 20.0::DOUBLE + 1) AS p FROM labels JOIN documents USING (doc_id) GROUP BY 1),
r AS (SELECT name, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1)) AS raw FROM p)
SELECT name, round(p, 6) AS p, round(max(raw) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM r
""")
def holm_adjust(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").groupBy(F.col("source").alias("name"))
    p = rows.agg(((1 + F.count_if(F.col("quality") == 0)) / (F.count(F.lit(1)) * 20.0 + 1)).alias("p"))
    return rounded(stats.holm(p), "p", "adjusted")


@query("""
SELECT doc_id, lang, least(2, floor((row_number() OVER w - 1) * 3.0 / count(*) OVER (PARTITION BY lang)))::INT AS bin FROM documents WINDOW w AS (PARTITION BY lang ORDER BY n_chars, doc_id)
""")
def rank_bins(t):
    return stats.rank_bins(t("documents").select("doc_id", "lang", "n_chars"), "n_chars", "doc_id", 3, ["lang"]).drop("n_chars")


@query(None)
def stratified_sample(t):
    """60 documents over the languages: the sample is the feature."""
    return stats.stratified_sample(t("documents").select("doc_id", "lang"), "lang", "doc_id", 60, seed=11)


_UNIT = "('0x' || substr(sha256({}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"


@query(f"""
WITH {_SETS}, b AS (SELECT iteration, s.*, {_UNIT.format("'7/' || iteration || '/' || case_id")} AS u FROM s, (SELECT unnest(range(1, 21)) AS iteration)),
w AS (SELECT *, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.996340153172656)::INT + (u >= 0.9994058151824183)::INT + (u >= 0.9999167588507119)::INT AS w FROM b)
SELECT iteration::INT AS iteration, CAST(sum(tp * w) AS BIGINT) AS tp, CAST(sum(fp * w) AS BIGINT) AS fp, CAST(sum(fn * w) AS BIGINT) AS fn, round(2.0::DOUBLE * sum(tp * w) / (2 * sum(tp * w) + sum(fp * w) + sum(fn * w)), 6) AS f1 FROM w GROUP BY iteration
""")
def bootstrap_draws(t):
    cases = scoring.set_scores(*sides(t))
    return rounded(stats.bootstrap(cases, 20, seed=7), "f1").select("iteration", "tp", "fp", "fn", "f1")


@query(f"""
WITH {_SETS}, d AS (SELECT case_id, precision - recall AS d FROM s), o AS (SELECT avg(d) AS observed FROM d),
i AS (SELECT iteration, avg(CASE WHEN {_UNIT.format("'5/' || iteration || '/' || case_id")} < 0.5 THEN -d ELSE d END) AS m FROM d, (SELECT unnest(range(1, 51)) AS iteration) GROUP BY 1)
SELECT round(any_value(observed), 6) AS observed, round((count(*) FILTER (m >= observed - 1e-12) + 1) / 51.0::DOUBLE, 6) AS p_greater, round((count(*) FILTER (m <= observed + 1e-12) + 1) / 51.0::DOUBLE, 6) AS p_less,
  round((count(*) FILTER (abs(m) >= abs(observed) - 1e-12) + 1) / 51.0::DOUBLE, 6) AS p_two_sided FROM i, o
""")
def paired_inference(t):
    cases = scoring.set_scores(*sides(t)).select("case_id", (F.col("precision") - F.col("recall")).alias("d"))
    return rounded(stats.sign_flip(cases, 50, seed=5), "observed", "p_greater", "p_less", "p_two_sided")


@query("""
SELECT lang, count(*) AS n, min(n_chars) AS least, round(median(n_chars)::DOUBLE, 4) AS median, round(avg(n_chars), 4) AS mean, max(n_chars) AS most,
  round(quantile_cont(n_chars::DOUBLE, 0.25), 4) AS q25, round(stddev_samp(n_chars), 4) AS deviation FROM documents GROUP BY lang
""")
def descriptive_summary(t):
    n = "n_chars"
    return t("documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("least"), F.round(F.median(n), 4).alias("median"), F.round(F.avg(n), 4).alias("mean"), F.max(n).alias("most"),
        F.round(F.percentile(n, F.lit(0.25)), 4).alias("q25"), F.round(F.stddev_samp(n), 4).alias("deviation"),
    )


@query("SELECT n, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY n")
def value_histogram(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("orders"))


@query(f"""
WITH {_SETS}, o AS (SELECT case_id, row_number() OVER (ORDER BY tp + fn, case_id) - 1 AS k, count(*) OVER () AS n FROM s),
w AS (SELECT least(n - 1, floor((i + 0.5) * n / 20))::BIGINT AS k FROM (SELECT unnest(range(0, 20)) AS i), (SELECT any_value(n) AS n FROM o))
SELECT o.k AS place, case_id FROM o JOIN w USING (k)
""")
def even_positions(t):
    """20 cases at even places in order of their size. Places come from counts of sizes; only the
    sizes that hold a wanted place are numbered inside."""
    cases = scoring.set_scores(*sides(t)).select("case_id", (F.col("tp") + F.col("fn")).alias("size"))
    sizes = cases.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("n").alias("total"))
    wanted = cases.sparkSession.range(20).crossJoin(F.broadcast(total)).select(F.least(F.col("total") - 1, F.floor((F.col("id") + 0.5) * F.col("total") / 20)).alias("place"))
    at = wanted.join(F.broadcast(before), (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n")))
    held = cases.join(F.broadcast(at.select("size", "before").distinct()), "size")
    numbered = held.withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("size").orderBy("case_id")) - 1)
    return numbered.join(F.broadcast(wanted), "place", "left_semi").select("place", "case_id")

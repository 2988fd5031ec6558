"""Decision, state and input queries. Events stand for attempts and dispositions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.metrics import blank_as
from ..operators import decisions as D
from .common import Plans

PLANS = Plans()
query = PLANS.query

_STATUS = "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'view' THEN 'review' WHEN 'error' THEN 'rejected' END"
_PRIORITY = f"CASE {_STATUS} WHEN 'accepted' THEN 0 WHEN 'review' THEN 1 WHEN 'rejected' THEN 2 ELSE 3 END"


def _status():
    return F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "view", "review").when(F.col("event_type") == "error", "rejected")


@query(f"""
SELECT user_id, event_id, coalesce(status, 'absent') AS status FROM (
  SELECT user_id, event_id, {_STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY {_PRIORITY}, event_id) AS k FROM events) WHERE k = 1
""")
def disposition_dedup(t):
    rows = t("events").select("user_id", "event_id", _status().alias("status"))
    return D.deduplicate(rows, ["user_id"], "status", "event_id").withColumn("status", F.coalesce("status", F.lit("absent")))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_wins(t):
    return D.first_wins(t("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("""
WITH e AS (SELECT event_id, event_type = 'purchase' AS consensus,
  CASE user_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'ambiguous' ELSE 'unsupported' END AS verdict,
  CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, user_id % 2 = 0 AS first_pass, CASE WHEN event_id % 5 = 0 THEN 'negated' ELSE 'affirmed' END AS status FROM events),
d AS (SELECT *, CASE WHEN consensus THEN 'accepted' WHEN first_pass AND verdict IN ('supported', 'ambiguous') AND confidence IN ('high', 'medium') THEN 'accepted'
  WHEN verdict = 'supported' AND confidence IN ('high', 'medium') THEN 'accepted' WHEN verdict = 'unsupported' AND confidence = 'high' THEN 'rejected' ELSE 'review' END AS r FROM e)
SELECT event_id, CASE WHEN r = 'accepted' AND status <> 'affirmed' THEN 'review' ELSE r END AS review_status FROM d
""")
def review_decisions(t):
    u, e = F.col("user_id"), F.col("event_id")
    pick = lambda c, *v: F.get(F.array(*map(F.lit, v)), (c % len(v)).cast("int"))
    status = F.when(e % 5 == 0, "negated").otherwise("affirmed")
    out = D.review_status(F.col("event_type") == "purchase", pick(u, "supported", "ambiguous", "unsupported"), pick(e, "high", "medium", "low"), u % 2 == 0, status)
    return t("events").select("event_id", out.alias("review_status"))


_CASCADE = """
WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN 'exact' ELSE 'morphological' END AS evidence, 1 + l_partkey % 4 AS n,
  CASE WHEN l_suppkey % 3 = 0 THEN [l_partkey % 5, l_partkey % 5 + 1] ELSE [l_partkey % 5] END AS ids,
  CASE l_suppkey % 4 WHEN 0 THEN []::BIGINT[] WHEN 1 THEN [l_partkey % 5] ELSE [l_partkey % 3] END AS other, CASE WHEN l_returnflag = 'R' THEN 'negated' ELSE 'affirmed' END AS a FROM lineitem),
f AS (SELECT *, len(ids) = 1 AS uniq, len(other) > 0 AND len(list_intersect(ids, other)) > 0 AS agrees, len(other) > 0 AND len(list_intersect(ids, other)) = 0 AS against FROM m),
d AS (SELECT l_orderkey, l_linenumber, CASE WHEN a <> 'affirmed' THEN 'assertion_' || a
  WHEN evidence = 'exact' AND uniq AND n >= 2 AND agrees THEN 'exact_cross_method_agreement' WHEN evidence = 'exact' AND uniq AND n >= 3 AND NOT against THEN 'exact_specific_asserted'
  WHEN evidence = 'morphological' AND uniq AND n >= 2 AND agrees THEN 'morphological_cross_method_agreement' WHEN against THEN 'cross_method_disagreement' ELSE 'requires_verification' END AS reason FROM f),
s AS (SELECT *, CASE WHEN reason LIKE 'assertion%' THEN 'rejected_context' WHEN reason LIKE '%agreement' AND reason NOT LIKE '%dis%' OR reason = 'exact_specific_asserted' THEN 'accepted' ELSE 'abstained' END AS status FROM d)
"""


def _cascade(t):
    s = lambda c: c.cast("string")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    ids = F.when(supp % 3 == 0, F.array(s(part % 5), s(part % 5 + 1))).otherwise(F.array(s(part % 5)))
    other = F.when(supp % 4 == 0, F.array().cast("array<string>")).when(supp % 4 == 1, F.array(s(part % 5))).otherwise(F.array(s(part % 3)))
    evidence = F.when(F.col("l_linenumber") % 2 == 1, "exact").otherwise("morphological")
    out = D.cascade(evidence, 1 + part % 4, ids, other, F.when(F.col("l_returnflag") == "R", "negated").otherwise("affirmed"))
    return t("lineitem").select("l_orderkey", "l_linenumber", out.alias("d")).select("l_orderkey", "l_linenumber", "d.status", "d.reason")


@query(_CASCADE + "SELECT l_orderkey, l_linenumber, status, reason FROM s")
def cascade_decisions(t):
    return _cascade(t)


@query(_CASCADE + "SELECT coalesce(status, 'all') AS status, coalesce(reason, 'all') AS reason, count(*) AS n FROM s GROUP BY GROUPING SETS ((status), (reason))")
def cascade_counters(t):
    """Status and reason counts from one pass."""
    rows = _cascade(t)
    out = rows.groupingSets([[F.col("status")], [F.col("reason")]], "status", "reason").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("status", F.lit("all")).alias("status"), F.coalesce("reason", F.lit("all")).alias("reason"), "n")


@query(_CASCADE + """, p AS (SELECT 'accepted' AS policy, status = 'accepted' AS kept FROM s UNION ALL SELECT 'accepted_or_abstained', status <> 'rejected_context' FROM s UNION ALL SELECT 'agreement', reason LIKE '%cross_method_agreement' FROM s UNION ALL SELECT 'all', true FROM s)
SELECT policy, count(*) FILTER (kept) AS n FROM p GROUP BY policy""")
def policy_predicates(t):
    """Named policies as columns, unpivoted: one pass over the decisions."""
    flags = _cascade(t).select(
        (F.col("status") == "accepted").alias("accepted"), (F.col("status") != "rejected_context").alias("accepted_or_abstained"),
        F.col("reason").endswith("cross_method_agreement").alias("agreement"), F.lit(True).alias("all"),
    )
    return flags.unpivot([], flags.columns, "policy", "kept").groupBy("policy").agg(F.count_if("kept").alias("n"))


@query("""
SELECT event_id, CASE WHEN event_type <> 'error' AND value < 42 THEN NULL ELSE user_id END AS concept_id, CASE WHEN event_type = 'error' THEN 'error' WHEN value < 42 THEN 'no_candidate_fit' ELSE 'mapped' END AS mapping_status FROM events
""")
def score_threshold(t):
    rows = t("events").select("event_id", F.col("user_id").alias("concept_id"), F.col("value").alias("score"), F.when(F.col("event_type") == "error", "error").otherwise("mapped").alias("mapping_status"))
    return D.below_threshold(rows, 42.0).drop("score")


@query("""
WITH c AS (SELECT count(*) * 4 // 7 + 1 AS m FROM events), d AS (SELECT event_id % m AS item_id, min(event_type) AS verdict, count(*) AS n FROM events, c GROUP BY 1)
SELECT event_id AS item_id, CASE WHEN n = 1 THEN verdict END AS verdict, CASE WHEN n = 1 THEN NULL ELSE 'review' END AS review_status, CASE WHEN n = 1 THEN NULL ELSE 'incomplete_mapping_decision' END AS error_code
FROM events LEFT JOIN d ON event_id = item_id
""")
def decision_completeness(t):
    """Every event is an item and a decision: some are decided twice, some once, some never."""
    events = t("events")
    m = events.count() * 4 // 7 + 1
    made = events.select((F.col("event_id") % m).alias("item_id"), F.col("event_type").alias("verdict"))
    return D.complete_decisions(events.select(F.col("event_id").alias("item_id")), made)


@query("SELECT event_id, concat_ws('|', event_type, CASE WHEN value > 50 THEN 'high' ELSE 'none' END, 'set-' || least(user_id % 5, 3)) AS stratum FROM events")
def evidence_strata(t):
    high = F.when(F.col("value") > 50, "high")
    size = F.concat(F.lit("set-"), F.least(F.col("user_id") % 5, F.lit(3)).cast("string"))
    return t("events").select("event_id", F.concat_ws("|", "event_type", F.coalesce(high, F.lit("none")), size).alias("stratum"))


def _pending(events, writes):
    """Last write wins, then an anti-join."""
    last = writes.groupBy("row_index").agg(F.max_by("event_type", "event_id").alias("status"))
    rows = events.select(F.col("event_id").alias("row_index"))
    return rows.join(last.where(~F.col("status").isin("error", "click")), "row_index", "left_anti")


@query("""
WITH c AS (SELECT count(*) * 3 // 4 + 1 AS m FROM events), done AS (SELECT event_id % m AS row_index, arg_max(event_type, event_id) AS status FROM events, c GROUP BY 1)
SELECT e.event_id AS row_index FROM events e LEFT JOIN done d ON e.event_id = d.row_index WHERE d.row_index IS NULL OR d.status IN ('error', 'click')
""")
def resume_pending(t):
    """Every event is a row and a write: some rows are written twice, some once, some never."""
    events = t("events")
    m = events.count() * 3 // 4 + 1
    return _pending(events, events.select((F.col("event_id") % m).alias("row_index"), "event_id", "event_type"))


@query("SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS used, round(greatest(0, sum(value) - 200), 4) AS over FROM events GROUP BY user_id")
def usage_rollup(t):
    used = F.sum("value")
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(used, 4).alias("used"), F.round(F.greatest(F.lit(0.0), used - 200), 4).alias("over"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, regexp_extract_all(props, '[0-9]+')[1] AS first_number FROM events")
def json_candidates(t):
    """A cell that is JSON, or text with numbers in it."""
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.regexp_extract("props", "[0-9]+", 0).alias("first_number"))


@query("SELECT event_type, count(*) FILTER (coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'accepted' ELSE 'review' END, ''), 'accepted') = 'accepted') AS accepted FROM events GROUP BY event_type")
def accepted_predicate(t):
    raw = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "accepted").otherwise("review")
    return t("events").groupBy("event_type").agg(F.count_if(blank_as(raw, "accepted") == "accepted").alias("accepted"))


@query("""
SELECT event_id, substr(h, 1, 12) AS review_id, ('0x' || right(h, 1))::INT % 2 = 1 AS flipped FROM (SELECT event_id, sha256(user_id || '|' || event_type || '|' || event_id) AS h FROM events)
""")
def blinded_reviews(t):
    h = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string")), 256)
    return t("events").select("event_id", F.substring(h, 1, 12).alias("review_id"), (F.conv(F.right(h, F.lit(1)), 16, 10).cast("int") % 2 == 1).alias("flipped"))


_SPANS = """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS start, l_partkey % 50 + 1 + l_quantity::INT % 9 AS stop FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, a.start <= b.start AND a.stop >= b.stop AS contains
FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.start < b.stop AND a.stop > b.start
"""


def _spans(lines):
    """Half-open spans of a note that overlap; the note is the equi-join key."""
    s = lines.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + 1 + F.col("l_quantity").cast("int") % 9).alias("stop"))
    a, b = s.alias("a"), s.alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (F.col("a.start") < F.col("b.stop")) & (F.col("a.stop") > F.col("b.start"))
    inside = (F.col("a.start") <= F.col("b.start")) & (F.col("a.stop") >= F.col("b.stop"))
    return a.join(b, on).select("a.l_orderkey", F.col("a.l_linenumber").alias("a"), F.col("b.l_linenumber").alias("b"), inside.alias("contains"))


@query(_SPANS)
def span_overlaps(t):
    return _spans(t("lineitem"))


@query("""
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY k) AS kept FROM (
  SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) AS k FROM lineitem GROUP BY l_orderkey, l_partkey) WHERE k <= 3 GROUP BY l_orderkey
""")
def walk_acceptance(t):
    """An order-dependent walk; with only ``enough`` to satisfy it keeps the first concepts."""
    rows = t("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("concept_id"), F.lit(0.0).alias("score"), F.lit(False).alias("overlaps"))
    return D.walk_acceptance(rows, enough=3).select(F.col("query_id").alias("l_orderkey"), F.array_join("kept", "|").alias("kept"))


@query("""
SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
""")
def eligible_cases(t):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    rows = t("customer").select("c_custkey").join(o, "c_custkey", "left_semi").join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_semi")
    return rows.join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti")


@query("""
WITH a AS (SELECT l_orderkey AS c, l_linenumber AS s, l_partkey AS x FROM lineitem WHERE l_quantity > 20), b AS (SELECT l_orderkey AS c, l_linenumber AS s, l_suppkey AS y FROM lineitem WHERE l_discount < 0.05)
SELECT coalesce(a.c, b.c) AS case_id, coalesce(a.s, b.s) AS span, CASE WHEN x IS NULL THEN 'second' WHEN y IS NULL THEN 'first' ELSE 'both' END AS methods FROM a FULL JOIN b ON a.c = b.c AND a.s = b.s
""")
def span_agreement(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("span"), "l_quantity", "l_discount")
    a, b = (lines.where(c).select("case_id", "span", F.lit(True).alias(n)) for c, n in (("l_quantity > 20", "x"), ("l_discount < 0.05", "y")))
    says = F.when(F.col("x").isNull(), "second").when(F.col("y").isNull(), "first").otherwise("both")
    return a.join(b, ["case_id", "span"], "full").select("case_id", "span", says.alias("methods"))


@query("""
WITH e AS (SELECT user_id, event_id, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) FILTER (before = 'error') AS after_error FROM e GROUP BY user_id
""")
def retries_after_error(t):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").withColumn("before", before).groupBy("user_id").agg(F.count_if(F.col("before") == "error").alias("after_error"))

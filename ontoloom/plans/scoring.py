"""Scoring queries. Orders stand for cases and parts for concepts: what was returned is the
reference, what is large enough is predicted. Customers below nations below regions are the tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, scoring
from .common import Plans

PLANS = Plans()
query = PLANS.query

_SETS = """
p AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS id FROM lineitem WHERE l_quantity > 20),
r AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS id FROM lineitem WHERE l_discount < 0.06),
u AS (SELECT coalesce(p.case_id, r.case_id) AS case_id, coalesce(p.id, r.id) AS id, p.id IS NOT NULL AS x, r.id IS NOT NULL AS y FROM p FULL JOIN r ON p.case_id = r.case_id AND p.id = r.id),
c AS (SELECT case_id, count(*) FILTER (x AND y) AS tp, count(*) FILTER (x AND NOT y) AS fp, count(*) FILTER (y AND NOT x) AS fn FROM u GROUP BY case_id),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall FROM c),
s AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)
"""


def sides(t):
    lines = t("lineitem")
    pick = lambda c: lines.where(c).select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("id"))
    return pick("l_quantity > 20"), pick("l_discount < 0.06")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {_SETS} SELECT case_id, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s")
def set_scores(t):
    return rounded(scoring.set_scores(*sides(t)), "precision", "recall", "f1")


@query(f"""
WITH {_SETS}, t AS (SELECT count(*) AS cases, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(precision) AS a, avg(recall) AS b, avg(f1) AS c FROM s)
SELECT cases, tp, fp, fn, round(a, 6) AS macro_precision, round(b, 6) AS macro_recall, round(c, 6) AS macro_f1,
  round(tp::DOUBLE / (tp + fp), 6) AS micro_precision, round(tp::DOUBLE / (tp + fn), 6) AS micro_recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS micro_f1 FROM t
""")
def micro_macro_summary(t):
    return rounded(scoring.summarize(scoring.set_scores(*sides(t))), *[f"{a}_{b}" for a in ("micro", "macro") for b in ("precision", "recall", "f1")])


@query(f"""
WITH {_SETS} SELECT case_id, round(CASE WHEN 0.25 * precision + recall = 0 THEN 0.0 ELSE 1.25 * precision * recall / (0.25 * precision + recall) END, 6) AS fbeta FROM s
""")
def fbeta_scores(t):
    cases = scoring.set_scores(*sides(t))
    return cases.select("case_id", F.round(scoring.fbeta(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("fbeta"))


@query(f"""
WITH {_SETS}, e AS (SELECT DISTINCT o_orderkey AS case_id FROM orders WHERE o_orderstatus = 'P')
SELECT case_id, CASE WHEN e.case_id IS NULL THEN tp ELSE 0 END AS tp, CASE WHEN e.case_id IS NULL THEN round(f1, 6) END AS f1,
  CASE WHEN e.case_id IS NULL THEN 'scored' ELSE 'unscorable' END AS scoring_status FROM s LEFT JOIN e USING (case_id)
""".replace("e.case_id IS NULL", "e.bad IS NULL").replace("SELECT DISTINCT o_orderkey AS case_id FROM", "SELECT DISTINCT o_orderkey AS case_id, 1 AS bad FROM"))
def unscorable_marking(t):
    errors = t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("case_id"), F.lit("row_failure").alias("code"))
    out = scoring.mark_unscorable(scoring.set_scores(*sides(t)), errors)
    return out.select("case_id", "tp", F.round("f1", 6).alias("f1"), "scoring_status")


@query(f"WITH {_SETS} SELECT count(*) FILTER (x AND y) AS shared, count(*) FILTER (x AND NOT y) AS first_only, count(*) FILTER (y AND NOT x) AS second_only FROM u")
def recognizer_overlap(t):
    return scoring.overlap(*sides(t))


@query(f"""
WITH {_SETS}, j AS (SELECT case_id, count(*) FILTER (x AND y) AS i, count(*) AS n FROM u GROUP BY case_id)
SELECT case_id, i AS intersection, n AS union_size, round(i::DOUBLE / n, 6) AS jaccard FROM j
""")
def set_jaccard(t):
    cases = scoring.set_scores(*sides(t))
    n = F.col("tp") + F.col("fp") + F.col("fn")
    return cases.select("case_id", F.col("tp").alias("intersection"), n.alias("union_size"), F.round(F.col("tp") / n, 6).alias("jaccard"))


@query(f"""
WITH {_SETS}, bad AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS id FROM lineitem WHERE l_tax > 0.07)
SELECT case_id, id FROM p WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.case_id = p.case_id AND bad.id = p.id)
""")
def baseline_minus_rejected(t):
    p, _ = sides(t)
    bad = t("lineitem").where("l_tax > 0.07").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("id"))
    return p.distinct().join(bad, ["case_id", "id"], "left_anti")


@query(f"WITH {_SETS} SELECT case_id, id, string_agg(m, '|' ORDER BY m) AS methods FROM (SELECT *, 'a' AS m FROM p UNION ALL SELECT *, 'b' FROM r) GROUP BY case_id, id")
def merged_sources(t):
    p, r = sides(t)
    both = p.distinct().withColumn("m", F.lit("a")).unionByName(r.distinct().withColumn("m", F.lit("b")))
    return both.groupBy("case_id", "id").agg(F.array_join(F.array_sort(F.collect_set("m")), "|").alias("methods"))


@query(f"""
WITH runs AS (SELECT DISTINCT 1 AS run, l_orderkey AS case_id, l_partkey AS id FROM lineitem WHERE l_quantity > 10
  UNION SELECT 2, l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 15 UNION SELECT 3, l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.08),
p AS (SELECT case_id, id, count(*) AS n FROM runs GROUP BY ALL),
pr AS (SELECT unnest([1, 1, 2]) AS a, unnest([2, 3, 3]) AS b),
e AS (SELECT a, b, case_id, id, count(*) AS n FROM runs JOIN pr ON run = a OR run = b GROUP BY ALL),
j AS (SELECT a, b, case_id, count(*) FILTER (n = 2) / count(*)::DOUBLE AS j FROM e GROUP BY ALL)
SELECT (SELECT count(*) FROM p) AS union_size, (SELECT count(*) FILTER (n = 3) FROM p) AS stable_size,
  round((SELECT count(*) FILTER (n = 3) / count(*)::DOUBLE FROM p), 6) AS recurrence, round(avg(j), 6) AS mean_jaccard, min(j) AS min_jaccard FROM j
""")
def run_consistency(t):
    took = [F.when(F.expr(c), F.lit(k)) for k, c in ((1, "l_quantity > 10"), (2, "l_quantity > 15"), (3, "l_discount < 0.08"))]
    runs = t("lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("id"), F.explode(F.array_compact(F.array(*took))).alias("run"))
    return rounded(scoring.run_consistency(runs), "recurrence", "mean_jaccard")


def placed_lines(t):
    """Lines of an order together, each a finding of its own (line numbers come twice)."""
    lines = t("lineitem").select(F.col("l_orderkey").alias("case_id"), "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    return scoring.together(lines).withColumn("n", F.monotonically_increasing_id())


def _groups(t):
    """Findings as sets of alternatives: a line's part, and its neighbour by number."""
    lines = placed_lines(t).withColumns({"a": F.col("l_partkey") % 7, "b": F.col("l_suppkey") % 7})
    p = F.when(F.col("l_quantity") > 15, F.array_distinct(F.array("a", "b")))
    r = F.when(F.col("l_discount") < 0.07, F.array_distinct(F.array("b", F.col("a") + 1)))
    return lines.select("case_id", "n", p.alias("predicted"), r.alias("reference"))


@query(None)
def group_matching_scores(t):
    return rounded(scoring.placed_group_scores(_groups(t)), "precision", "recall", "f1")


@query(None)
def single_id_group_scores(t):
    """Single ids against groups of alternatives."""
    rows = _groups(t)
    single = rows.where("predicted IS NOT NULL").select("case_id", "n", F.slice("predicted", 1, 1).alias("ids")).dropDuplicates(["case_id", "ids"])
    return rounded(scoring.group_scores(single, rows.where("reference IS NOT NULL").select("case_id", "n", F.col("reference").alias("ids"))), "precision", "recall", "f1")


_TREE = """
tree AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region)
"""
_CLOSURE = f"""
{_TREE}, up AS (SELECT child, parent AS ancestor, 1 AS depth FROM tree UNION ALL SELECT up.child, tree.parent, depth + 1 FROM up JOIN tree ON up.ancestor = tree.child WHERE depth < 32),
anc AS (SELECT child, ancestor, min(depth) AS depth FROM up GROUP BY ALL)
"""


def _tree(t):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda df, a, b, c, d: df.select(key(a, b).alias("child"), key(c, d).alias("parent"))
    out = edge(t("nation"), "n", "n_nationkey", "r", "n_regionkey")
    out = out.unionByName(edge(t("supplier"), "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge(t("customer"), "c", "c_custkey", "n", "c_nationkey"))
    return out.unionByName(t("region").select(key("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT child, ancestor, CAST(depth AS INTEGER) AS depth FROM anc")
def hierarchy_closure(t):
    return graph.closure(_tree(t))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT child AS id FROM anc WHERE ancestor = 'r1' AND child NOT LIKE 's%' UNION ALL SELECT 'r1'")
def descendants(t):
    edges = _tree(t)
    active = edges.select(F.col("child").alias("id")).where("id NOT LIKE 's%'")
    return graph.descendants(edges, "r1", active)


_PAIRS = """
pairs AS (SELECT DISTINCT 'c' || c_custkey AS prediction, reference FROM customer, LATERAL (SELECT unnest(['n' || (c_custkey % 25), 'r' || (c_custkey % 5), 'c' || (c_custkey + 1), 'c' || c_custkey]) AS reference)
  UNION SELECT 'n' || n_nationkey, 'c' || (n_nationkey + 1) FROM nation)
"""


def _pairs(t):
    c = F.col("c_custkey")
    refs = F.array(*[F.concat(F.lit(p), x.cast("string")) for p, x in (("n", c % 25), ("r", c % 5), ("c", c + 1), ("c", c))])
    rows = t("customer").select(F.concat(F.lit("c"), c.cast("string")).alias("prediction"), F.explode(refs).alias("reference"))
    n = F.col("n_nationkey")
    return rows.unionByName(t("nation").select(F.concat(F.lit("n"), n.cast("string")).alias("prediction"), F.concat(F.lit("c"), (n + 1).cast("string")).alias("reference"))).distinct()


_RELATIONS = f"""
WITH RECURSIVE {_CLOSURE}, {_PAIRS}, sib AS (SELECT DISTINCT x.child AS a, y.child AS b FROM tree x JOIN tree y ON x.parent = y.parent)
SELECT prediction, reference,
  CASE WHEN prediction = reference THEN 'exact' WHEN u.depth IS NOT NULL THEN 'predicted_descendant' WHEN d.depth IS NOT NULL THEN 'predicted_ancestor' WHEN sib.a IS NOT NULL THEN 'sibling' ELSE 'unrelated' END AS relation,
  CAST(CASE WHEN prediction = reference THEN 0 WHEN u.depth IS NOT NULL THEN u.depth WHEN d.depth IS NOT NULL THEN d.depth WHEN sib.a IS NOT NULL THEN 2 END AS INTEGER) AS distance
FROM pairs LEFT JOIN anc u ON u.child = prediction AND u.ancestor = reference LEFT JOIN anc d ON d.child = reference AND d.ancestor = prediction LEFT JOIN sib ON sib.a = prediction AND sib.b = reference
"""


@query(_RELATIONS)
def relation_classify(t):
    edges = _tree(t)
    return graph.relations(_pairs(t), edges, graph.closure(edges))


def _layered(t):
    """Lines' suppliers against their orders' customers' nations, in tiers of distance 0, 1 and 2."""
    edges = _tree(t)
    # Lines without an order have no reference, so their cases don't count.
    p = t("lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id"))
    nation = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("id"))
    r = t("orders").join(nation, "o_custkey").select(F.col("o_orderkey").alias("case_id"), F.lit(0).alias("n"), "id")
    near = graph.closure(edges, 2).select(F.col("child").alias("prediction"), F.col("ancestor").alias("reference"), F.lit("predicted_descendant").alias("relation"), F.col("depth").alias("distance"))
    return p, r, near


_LAYERED = """
p AS (SELECT l_orderkey AS case_id, n_nationkey AS nation, count(*) AS n_p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL),
r AS (SELECT o_orderkey AS case_id, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT r.case_id, coalesce(sum(n_p), 0) AS n_p, coalesce(max(CASE WHEN p.nation = r.nation THEN 1 END), 0) AS tp FROM r LEFT JOIN p USING (case_id) GROUP BY r.case_id),
s AS (SELECT case_id, 0 AS exact_tp, tp AS related_tp, n_p - tp AS fp, 1 - tp AS fn, CASE WHEN n_p = 0 THEN 0.0 ELSE tp::DOUBLE / n_p END AS precision, tp::DOUBLE AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s)
"""


@query(f"WITH {_LAYERED} SELECT case_id, exact_tp, CAST(related_tp AS BIGINT) AS related_tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def layered_scores(t):
    """One reference a case: a supplier is one step below its nation, so tiers are easy to tell in SQL."""
    return rounded(scoring.layered_scores(*_layered(t)), "precision", "recall", "f1").drop("relations")


@query(f"""
WITH {_LAYERED}, t AS (SELECT count(*) AS cases, CAST(sum(related_tp) AS BIGINT) AS related_tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(f1) AS f1 FROM f)
SELECT cases, related_tp, fp, fn, round(f1, 6) AS macro_f1, round(2.0 * related_tp / (2 * related_tp + fp + fn), 6) AS micro_f1, 'predicted_descendant=' || related_tp AS relations FROM t
""")
def layered_summary(t):
    out = scoring.summarize_layered(scoring.layered_scores(*_layered(t)))
    told = F.array_join(F.transform(F.map_entries("relation_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
    return rounded(out.select("cases", "related_tp", "fp", "fn", "macro_f1", "micro_f1", told.alias("relations")), "macro_f1", "micro_f1")


@query(f"""
WITH RECURSIVE {_CLOSURE}, p AS (SELECT DISTINCT o_orderkey AS case_id, 'c' || o_custkey AS id FROM orders UNION SELECT o_orderkey, 'r' || (o_custkey % 5) FROM orders),
r AS (SELECT DISTINCT o_orderkey AS case_id, 'n' || c_nationkey AS id FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT o_orderkey, 'r' || (o_orderkey % 5) FROM orders),
e AS (SELECT case_id, id FROM p INTERSECT SELECT case_id, id FROM r),
x AS (SELECT p.case_id, p.id AS prediction, r.id AS reference FROM p JOIN r ON p.case_id = r.case_id JOIN anc ON child = p.id AND ancestor = r.id AND depth = 1 WHERE p.id LIKE 'c%')
SELECT case_id, id AS prediction, id AS reference, 'exact' AS relation, 0 AS distance FROM e UNION ALL SELECT case_id, prediction, reference, 'predicted_descendant', 1 FROM x
UNION ALL SELECT y.case_id, y.p, y.r, 'predicted_ancestor', 1 FROM (SELECT p.case_id, p.id AS p, r.id AS r FROM p JOIN r ON p.case_id = r.case_id JOIN anc ON child = r.id AND ancestor = p.id AND depth = 1) y
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.case_id = y.case_id AND e.id = y.p) AND NOT EXISTS (SELECT 1 FROM x WHERE x.case_id = y.case_id AND x.reference = y.r)
""")
def hierarchy_matches(t):
    """A customer and a region against the customer's nation and another region: the customer, which
    comes first, takes its nation before a region could."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")) if isinstance(c, str) else F.concat(F.lit(p), c.cast("string"))
    o, edges = t("orders").withColumn("case_id", F.col("o_orderkey")), _tree(t)
    nation = o.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), key("n", "c_nationkey").alias("id")), "o_custkey").select("case_id", "id")
    p = o.select("case_id", key("c", "o_custkey").alias("id")).unionByName(o.select("case_id", key("r", F.col("o_custkey") % 5).alias("id")))
    r = nation.unionByName(o.select("case_id", key("r", F.col("o_orderkey") % 5).alias("id")))
    up = graph.closure(edges).where("depth = 1")
    near = up.select(F.col("child").alias("prediction"), F.col("ancestor").alias("reference"), F.lit("predicted_descendant").alias("relation"), F.col("depth").alias("distance"))
    near = near.unionByName(up.select(F.col("ancestor").alias("prediction"), F.col("child").alias("reference"), F.lit("predicted_ancestor").alias("relation"), F.col("depth").alias("distance")))
    return scoring.hierarchy_match(p, r, near)


_OBSOLETE = """
WITH RECURSIVE l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey > 40 THEN o_orderkey // 2 WHEN o_orderkey % 10 = 5 THEN o_orderkey - 5 END AS next FROM orders),
w AS (SELECT id, id AS target, 0 AS n FROM l UNION ALL SELECT w.id, l.next, n + 1 FROM w JOIN l ON w.target = l.id WHERE l.next IS NOT NULL)
SELECT id, arg_max(target, n) AS target FROM w GROUP BY id
"""


def _resolved(orders):
    k = F.col("o_orderkey")
    half = F.when((k % 4 == 0) & (k > 40), F.expr("o_orderkey DIV 2"))
    return graph.resolve_obsolete(orders.select(k.alias("id"), half.alias("replaced_by"), F.when(k % 10 == 5, k - 5).alias("consider")))


@query(_OBSOLETE)
def obsolete_resolution(t):
    return _resolved(t("orders"))


@query("""
WITH a AS (SELECT o_orderkey AS source_id, min(o_custkey) AS target_id FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT l_orderkey, l_linenumber, coalesce(target_id, l_orderkey) AS id FROM lineitem LEFT JOIN a ON l_orderkey = source_id
""")
def alias_resolution(t):
    aliases = t("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_orderkey").alias("source_id")).agg(F.min("o_custkey").alias("target_id"))
    return graph.normalise_ids(t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("id")), aliases)


@query("""
SELECT status, count(*) AS n, count(DISTINCT o_custkey) AS ids FROM (
  SELECT o_custkey, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_acctbal < 0 AND c_custkey % 2 = 0 THEN 'obsolete_with_replacement' WHEN c_acctbal < 0 THEN 'obsolete' WHEN c_mktsegment = 'BUILDING' THEN 'alternate_id' ELSE 'current' END AS status
  FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 11 <> 0) ON o_custkey = c_custkey) GROUP BY status
""")
def id_status_counts(t):
    known = t("customer").where("c_custkey % 11 <> 0")
    rows = t("orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    low = F.col("c_acctbal") < 0
    status = F.when(F.col("c_custkey").isNull(), "missing").when(low & (F.col("c_custkey") % 2 == 0), "obsolete_with_replacement").when(low, "obsolete").when(F.col("c_mktsegment") == "BUILDING", "alternate_id").otherwise("current")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("ids"))


@query("SELECT l_orderkey AS case_id, l_partkey AS id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_pairs(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.v, '<missing>') AS before, coalesce(b.v, '<missing>') AS after FROM a FULL JOIN b ON a.id = b.id WHERE a.v IS DISTINCT FROM b.v
""")
def snapshot_diff(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))
    old, new = o.where("id % 3 <> 0"), o.where("id % 7 <> 0").withColumn("v", F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("v")))
    rows = old.withColumnRenamed("v", "a").join(new.withColumnRenamed("v", "b"), "id", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return rows.select("id", F.coalesce("a", F.lit("<missing>")).alias("before"), F.coalesce("b", F.lit("<missing>")).alias("after"))

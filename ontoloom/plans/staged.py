"""Queries of staged mapping and of what is done about its results. Events stand for result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_phrase
from ..operators import context, rescue, scoring
from ..operators import decisions as D
from ..operators import diagnostics as G
from ..sources import tables
from .common import Plans
from .scoring import _SETS, rounded, sides

PLANS = Plans()
query = PLANS.query

_METHODS = "[['native'], ['model-pass-1'], ['model-pass-2', 'native'], ['native', 'fasthpocr'], ['model-pass-1', 'fasthpocr'], ['other']][1 + event_id % 6]"
_ROWS = f"""
r AS (SELECT event_id, {_METHODS} AS m, ['supported', 'ambiguous', 'unsupported'][1 + user_id % 3] AS verdict, ['high', 'medium', 'low'][1 + event_id % 3] AS confidence,
  ['accepted', 'review', 'rejected'][1 + (event_id // 6) % 3] AS review, CASE WHEN event_id % 7 = 0 THEN 'Normal' ELSE 'Abnormal' END AS category, ['affirmed', 'affirmed', 'negated'][1 + (event_id // 2) % 3] AS status,
  event_id % 4 AS n, CASE WHEN event_type = 'error' THEN 'no_candidate_fit' ELSE 'mapped' END AS mapping_status,
  CASE WHEN event_id % 5 = 0 THEN 'incomplete_final_category' WHEN event_id % 11 = 0 THEN 'other' END AS error_code FROM events)
"""


def _pick(c, *values):
    return F.get(F.array(*map(F.lit, values)), (c % len(values)).cast("int"))


def _rows(t):
    e, u = F.col("event_id"), F.col("user_id")
    lists = (["native"], ["model-pass-1"], ["model-pass-2", "native"], ["native", "fasthpocr"], ["model-pass-1", "fasthpocr"], ["other"])
    methods = F.get(F.array(*[F.array(*map(F.lit, m)) for m in lists]), (e % 6).cast("int"))
    return t("events").select(
        e, u, methods.alias("methods"), _pick(u, "supported", "ambiguous", "unsupported").alias("mapping_verdict"), _pick(e, "high", "medium", "low").alias("confidence"),
        _pick(F.floor(e / 6), "accepted", "review", "rejected").alias("review_status"), F.when(e % 7 == 0, "Normal").otherwise("Abnormal").alias("category"),
        _pick(F.floor(e / 2), "affirmed", "affirmed", "negated").alias("assertion_status"), F.slice(F.array(*map(F.lit, "abc")), F.lit(1), (e % 4).cast("int")).alias("candidate_hpo_ids"),
        F.when(F.col("event_type") == "error", "no_candidate_fit").otherwise("mapped").alias("mapping_status"), F.lit(None).cast("string").alias("category_confidence"),
        F.when(e % 5 == 0, "incomplete_final_category").when(e % 11 == 0, "other").alias("error_code"),
    )


_FLAGS = """
f AS (SELECT *, len(list_filter(m, lambda x: starts_with(x, 'model-pass'))) > 0 AS model, list_has_any(m, ['native', 'fasthpocr']) AS recog, list_has_all(m, ['native', 'fasthpocr']) AS both_,
  list_contains(m, 'model-pass-1') AS p1, list_contains(m, 'model-pass-2') AS p2, review = 'accepted' AS a FROM r)
"""
_KEPT = {
    "accepted": "a",
    "accepted_high": "a AND confidence = 'high'",
    "accepted_model": "a AND model",
    "accepted_model_pass1": "a AND p1",
    "accepted_model_pass2": "a AND p2",
    "accepted_model_recognizer_agreement": "a AND model AND recog",
    "accepted_pass1_plus_model_recognizer_agreement": "a AND (p1 OR (model AND recog))",
    "accepted_pass1_plus_dual_recognizer": "a AND (p1 OR both_)",
    "accepted_plus_high_review": "a OR (review = 'review' AND confidence = 'high')",
    "all_mapped": "true",
    "all_mapped_model": "model",
    "all_mapped_model_pass1": "p1",
}


@query(f"WITH {_ROWS}, {_FLAGS} " + " UNION ALL ".join(f"SELECT '{k}' AS policy, count(*) FILTER (mapping_status = 'mapped' AND ({v})) AS n FROM f" for k, v in _KEPT.items()))
def result_policies(t):
    """All named policies in one pass over the mapped rows."""
    kept = D.policies(F.col("review_status"), F.col("confidence"), F.col("methods"))
    flags = _rows(t).where("mapping_status = 'mapped'").select(*[c.alias(n) for n, c in kept.items()])
    return flags.unpivot([], flags.columns, "policy", "kept").groupBy("policy").agg(F.count_if("kept").alias("n"))


_STRATUM = """
s AS (SELECT *, concat_ws('|', CASE WHEN model AND recog THEN 'model+recognizer' WHEN p1 THEN 'model-pass-1' WHEN p2 THEN 'model-pass-2' WHEN recog THEN 'recognizer' ELSE 'other' END,
  verdict, confidence, 'none', status, 'set-' || least(n, 3)) AS stratum FROM f)
"""


def _stratum():
    return D.evidence_stratum(F.col("methods"), F.col("mapping_verdict"), F.col("confidence"), F.col("category_confidence"), F.col("assertion_status"), F.size("candidate_hpo_ids"))


@query(f"WITH {_ROWS}, {_FLAGS}, {_STRATUM} SELECT stratum, count(*) AS n FROM s GROUP BY stratum")
def result_strata(t):
    return _rows(t).groupBy(_stratum().alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_ROWS}, {_FLAGS}, {_STRATUM}, k AS (SELECT stratum, count(*) / 100000.0::DOUBLE AS p FROM s WHERE event_id % 2 = 0 GROUP BY stratum)
SELECT event_id, CASE WHEN category = 'Abnormal' AND mapping_status = 'mapped' AND n > 0 THEN CASE WHEN s.stratum LIKE 'model+%' THEN 'accepted' ELSE 'review' END ELSE review END AS review_status,
  CASE WHEN category = 'Abnormal' AND mapping_status = 'mapped' AND n > 0 THEN round(coalesce(p, 0.5), 6) END AS overall_confidence FROM s LEFT JOIN k ON s.stratum = k.stratum
""")
def calibrated_results(t):
    rows = _rows(t).withColumn("stratum", _stratum())
    strata = rows.where("event_id % 2 = 0").groupBy("stratum").agg((F.count(F.lit(1)) / 100000.0).alias("probability"))
    listed = [r.stratum for r in rows.where("stratum LIKE 'model+%'").select("stratum").distinct().collect()]  # strata are few
    out = D.apply_calibration(rows, strata, listed, 0.5, "x")
    return rounded(out.select("event_id", "review_status", "overall_confidence"), "overall_confidence")


@query(f"WITH {_ROWS} SELECT event_id FROM r WHERE category = 'Abnormal' AND n > 0 AND (list_contains(m, 'model-pass-1') OR list_has_all(m, ['native', 'fasthpocr']))")
def replayable_results(t):
    return _rows(t).where(D.replayable(F.col("category"), F.col("candidate_hpo_ids"), F.col("methods"))).select("event_id")


@query(f"""
WITH {_ROWS} SELECT event_id, CASE WHEN error_code = 'incomplete_final_category' THEN NULL ELSE category END AS category,
  CASE WHEN error_code IS DISTINCT FROM 'incomplete_final_category' THEN review WHEN status <> 'affirmed' THEN 'review'
    WHEN mapping_status = 'mapped' AND n > 0 AND verdict IN ('supported', 'ambiguous') AND confidence IN ('high', 'medium') THEN 'accepted' WHEN verdict = 'unsupported' AND confidence = 'high' THEN 'rejected' ELSE 'review' END AS review_status FROM r
""")
def category_repairs(t):
    return D.before_categories(_rows(t)).select("event_id", "category", "review_status")


@query("""
WITH v AS (SELECT event_id, [NULL, 'select', 'abstain', 'reject'][1 + event_id % 4] AS verdict, ['high', 'low'][1 + user_id % 2] AS confidence FROM events)
SELECT event_id, CASE WHEN verdict = 'select' AND confidence = 'high' THEN 'accepted_verified' ELSE 'abstained' END AS status,
  CASE WHEN verdict IS NULL THEN 'requires_verification' WHEN verdict = 'select' AND confidence = 'high' THEN 'model_verified_high_confidence' ELSE 'model_' || verdict || '_' || confidence END AS reason FROM v
""")
def verified_decisions(t):
    e = F.col("event_id")
    verdict = F.when(e % 4 == 1, "select").when(e % 4 == 2, "abstain").when(e % 4 == 3, "reject")
    before = F.struct(F.lit("abstained").alias("status"), F.lit("requires_verification").alias("reason"))
    d = D.verified(before, F.array(F.lit("a"), F.lit("b")), verdict, _pick(F.col("user_id"), "high", "low"), F.when(verdict == "select", "b"))
    return t("events").select("event_id", d.alias("d")).select("event_id", "d.status", "d.reason")


@query("""
WITH x AS (SELECT event_id, event_id % 5 AS k, ['affirmed', 'negated', 'normal'][1 + user_id % 3] AS s FROM events)
SELECT event_id, s <> 'negated' AND k NOT IN (2, 3) AS eligible, CASE k WHEN 0 THEN '2:edema hands' WHEN 1 THEN '3:lens opacity' WHEN 2 THEN '' WHEN 3 THEN '' ELSE '2:atrophy of the glaucoma|3:glaucomatous atrophic' END AS variants FROM x
""")
def rescue_variants(t):
    phrase = normalize_phrase(_pick(F.col("event_id"), "Edematous hands", "opacity of the crystalline lens", "Marfan syndrome", "heart disease", "atrophic of the glaucomatous"))
    rows = t("events").select("event_id", phrase.alias("p"), _pick(F.col("user_id"), "affirmed", "negated", "normal").alias("s"))
    told = F.array_join(F.transform(rescue.variants(F.col("p")), lambda v: F.concat_ws(":", v["level"].cast("string"), v["phrase"])), "|")
    return rows.select("event_id", rescue.eligible(F.col("p"), F.col("s")).alias("eligible"), told.alias("variants"))


@query("""
WITH x AS (SELECT event_id, event_id % 4 AS k, user_id % 3 AS first FROM events)
SELECT event_id, CASE WHEN first = 0 THEN k IN (1, 2, 3) WHEN first = 1 THEN true ELSE k = 0 END AS target FROM x
""")
def coverage_targets(t):
    """A sentence and spans: none, a recogniser's that the first pass lacks, one that it has."""
    text = _pick(F.col("event_id"), "one and two", "raised pressure", "3.5 mg of it", "imaging: clear").alias("text")
    one = F.struct(F.lit(2).alias("start"), F.lit(6).alias("stop"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    case = F.col("user_id") % 3
    rows = t("events").select("event_id", F.struct(F.lit(0).alias("start"), F.lit(14).alias("stop"), text).alias("s"), F.when(case > 0, F.array(one)).otherwise(none).alias("r"), F.when(case == 2, F.array(one)).otherwise(none).alias("f"))
    return rows.select("event_id", context.coverage_target(F.col("s"), F.col("r"), F.col("f")).alias("target"))


@query("""
WITH x AS (SELECT event_id, event_id % 3 AS k, user_id % 2 AS few, CASE WHEN event_id % 5 = 0 THEN 'family_history' ELSE 'affirmed' END AS status FROM events)
SELECT event_id, CASE WHEN k = 1 THEN 'context-cue' WHEN few = 0 THEN 'close-candidate-scores' WHEN status <> 'affirmed' THEN 'assertion-disambiguation' END AS reason,
  CASE WHEN status = 'family_history' THEN 'relative' ELSE 'patient' END AS subject,
  CASE WHEN k > 0 AND (k = 1 OR few = 0 OR status <> 'affirmed') THEN CASE k WHEN 1 THEN repeat('a', 280) ELSE 'It grew.' END END AS preceding,
  CASE k WHEN 0 THEN 'm ' || repeat('a', 300) WHEN 1 THEN 'm ' || repeat('a', 280) || ' It grew.' ELSE 'm It grew. Last one.' END AS asked FROM x
""")
def context_packets(t):
    """A mention in the first, second or third of three sentences."""
    texts = ("a" * 300, "It grew.", "Last one.")
    sentences = F.array(*[F.struct(F.lit(1000 * k).alias("start"), F.lit(1000 * k + 900).alias("stop"), F.lit(x).alias("text")) for k, x in enumerate(texts)])
    k, few = (F.col("event_id") % 3).cast("int"), F.col("user_id") % 2
    score = lambda x, y: F.struct(F.lit(x).alias("lexical_score"), F.lit(y).alias("dense_score"))
    candidates = F.when(few == 0, F.array(score(90.0, 0.9), score(88.0, 0.5))).otherwise(F.array(score(90.0, 0.9)))
    rows = t("events").select("event_id", sentences.alias("s"), (k * 1000 + 5).alias("a"), candidates.alias("c"), F.when(F.col("event_id") % 5 == 0, "family_history").otherwise("affirmed").alias("status"))
    rows = rows.withColumn("i", context.sentence_index(F.col("s"), F.col("a"), F.col("a") + 4))
    own = F.get("s", F.col("i"))["text"]
    rows = rows.withColumn("p", context.packet(F.col("status"), F.lit(None).cast("string"), own, F.lit(3), F.col("c"), F.col("s"), F.col("i")))
    asked = context.retrieval_context(F.lit("m"), F.lit(1), F.col("s"), F.col("i"))
    return rows.select("event_id", F.col("p.extended_context_reason").alias("reason"), "p.subject", F.col("p.preceding_sentence").alias("preceding"), asked.alias("asked"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'a' ELSE 'a|b' END AS kept, CASE WHEN l_partkey % 3 = 0 THEN 'm|n' ELSE 'm' END AS modifiers FROM lineitem")
def modifier_split(t):
    ids = F.when(F.col("l_partkey") % 3 == 0, F.array(*map(F.lit, "nam"))).otherwise(F.array(*map(F.lit, "bma")))
    d = context.without_modifiers(ids, F.array(*map(F.lit, "mnx")))
    return t("lineitem").select("l_orderkey", "l_linenumber", d.alias("d")).select("l_orderkey", "l_linenumber", F.array_join("d.kept", "|").alias("kept"), F.array_join("d.modifiers", "|").alias("modifiers"))


@query("""
SELECT p_partkey, r AS rank, CASE WHEN r <= 4 THEN 160 ELSE 0 END AS definition_chars, CASE WHEN r <= 4 THEN 'a|b|c' ELSE '' END AS synonyms, CASE WHEN r <= 4 THEN 'p|q' ELSE '' END AS parents, 'dense' || CASE WHEN r % 2 = 0 THEN '|lexical' ELSE '' END AS methods
FROM (SELECT p_partkey, 1 + p_partkey % 8 AS r FROM part)
""")
def candidate_payloads(t):
    rank = 1 + F.col("p_partkey") % 8
    row = context.candidate_row(F.lit("x"), F.col("p_name"), F.lit(0.5), F.repeat(F.lit("d"), 700), F.array(*map(F.lit, "dcabca")), F.array(*map(F.lit, "pqr")), {"dense": rank, "lexical": F.when(rank % 2 == 0, rank)})
    rows = t("part").select("p_partkey", rank.alias("rank"), row.alias("c")).withColumn("b", context.bounded_candidate(F.col("c"), F.col("rank")))
    return rows.select("p_partkey", "rank", F.length("b.definition").alias("definition_chars"), F.array_join("b.synonyms", "|").alias("synonyms"), F.array_join("b.parents", "|").alias("parents"), F.array_join("c.source_methods", "|").alias("methods"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS case_id, string_agg(DISTINCT c, '|' ORDER BY c) AS codes FROM (
  SELECT user_id, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'row_failure' END WHEN event_id % 3 = 0 THEN 'incomplete_final_category' END AS c FROM events) WHERE c IS NOT NULL GROUP BY user_id
""")
def case_errors(t):
    e = F.col("event_id")
    code = F.when((F.col("event_type") == "error") & (e % 2 == 0), "timeout").when(F.col("event_type") == "error", " ").when(e % 3 == 0, "incomplete_final_category").otherwise("note")
    rows = t("events").select(F.col("user_id").cast("string").alias("patient_id"), F.when(F.col("event_type") == "error", "error").otherwise("mapped").alias("mapping_status"), code.alias("error_code"))
    return tables.calculation_errors(rows).select("case_id", F.array_join("codes", "|").alias("codes"))


_RUNS = f"""
{_SETS}, o AS (SELECT case_id, CAST(sum(x::INT * y::INT) AS BIGINT) AS tp, CAST(sum((x AND NOT y)::INT) AS BIGINT) AS fp, CAST(sum((y AND NOT x)::INT) AS BIGINT) AS fn FROM u WHERE id % 2 = 0 GROUP BY case_id)
"""


def _halves(t):
    """All parts, and those of even number: two runs over the cases that both have."""
    p, r = sides(t)
    return scoring.set_scores(p, r), scoring.set_scores(p.where("id % 2 = 0"), r.where("id % 2 = 0"))


@query(f"WITH {_RUNS} SELECT (SELECT sum(tp + fp) FROM o)::BIGINT - (SELECT sum(tp + fp) FROM s)::BIGINT AS predicted_positive, (SELECT sum(tp) FROM o)::BIGINT - (SELECT sum(tp) FROM s)::BIGINT AS tp, (SELECT sum(fp) FROM o)::BIGINT - (SELECT sum(fp) FROM s)::BIGINT AS fp, (SELECT sum(fn) FROM o)::BIGINT - (SELECT sum(fn) FROM s)::BIGINT AS fn")
def metric_shifts(t):
    return G.metric_shift(*_halves(t))


@query(f"WITH {_RUNS} SELECT s.case_id, round(f1, 6) AS first, round(CASE WHEN o.tp = 0 THEN 0.0 ELSE 2.0::DOUBLE * o.tp / (2 * o.tp + o.fp + o.fn) END - f1, 6) + 0.0 AS d FROM s JOIN o ON s.case_id = o.case_id")
def paired_scores(t):
    first, second = _halves(t)
    out = G.paired(first.join(second.select("case_id"), "case_id", "left_semi"), second)
    return rounded(out.select("case_id", "first", "d"), "first", "d")

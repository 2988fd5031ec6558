"""Accept, review and reject policies as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How good a status is, the best first.
PRIORITY = {"accepted": 0, "review": 1, "rejected": 2}
ABSENT = 3


def priority(status: Column) -> Column:
    out = F.lit(ABSENT)
    for name, k in PRIORITY.items():
        out = F.when(status == name, k).otherwise(out)
    return out


def deduplicate(rows: DataFrame, keys: list[str], status: str, seq: str) -> DataFrame:
    """The best row of each key, the earliest of equals; null keys are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(priority(F.col(status)), seq)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(seq)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def review_status(consensus: Column, verdict: Column, confidence: Column, first_pass: Column, status: Column) -> Column:
    """Consensus is accepted; so are supported ones, and first-pass ambiguous ones, of high or
    medium confidence; confidently unsupported ones are rejected, others go to review. What is not
    affirmed is never accepted."""
    sure = confidence.isin("high", "medium")
    out = (
        F.when(consensus, "accepted")
        .when(first_pass & verdict.isin("supported", "ambiguous") & sure, "accepted")
        .when((verdict == "supported") & sure, "accepted")
        .when((verdict == "unsupported") & (confidence == "high"), "rejected")
        .otherwise("review")
    )
    return F.when((out == "accepted") & (status != "affirmed"), "review").otherwise(out)


def native_decision(ids: Column, status: Column) -> Column:
    """(hpo_id, verdict, confidence, review) from a recogniser's ids alone."""
    one = F.size(ids) == 1
    return F.struct(
        F.when(one, F.get(ids, 0)).alias("selected_id"),
        F.when(one, "supported").otherwise("ambiguous").alias("verdict"),
        F.when(one, "high").otherwise("medium").alias("confidence"),
        F.when(one & (status == "affirmed"), "accepted").otherwise("review").alias("review_status"),
    )


def cascade(evidence: Column, n_tokens: Column, ids: Column, other_ids: Column, status: Column) -> Column:
    """Struct (status, reason): what two recognisers and the assertion decide without a model."""
    second = F.size(F.coalesce(other_ids, F.array().cast("array<string>"))) > 0
    agrees = second & F.arrays_overlap(ids, F.coalesce(other_ids, F.array().cast("array<string>")))
    against = second & ~agrees
    unique = F.size(ids) == 1
    both = unique & (n_tokens >= 2) & agrees
    says = lambda s, r: F.struct(F.lit(s).alias("status"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return (
        F.when(status != "affirmed", says("rejected_context", F.concat(F.lit("assertion_"), status)))
        .when((evidence == "exact") & both, says("accepted", "exact_cross_method_agreement"))
        .when((evidence == "exact") & unique & (n_tokens >= 3) & ~against, says("accepted", "exact_specific_asserted"))
        .when((evidence == "morphological") & both, says("accepted", "morphological_cross_method_agreement"))
        .when(against, says("abstained", "cross_method_disagreement"))
        .otherwise(says("abstained", "requires_verification"))
    )


def below_threshold(rows: DataFrame, threshold: float) -> DataFrame:
    """Mapped rows whose score is too small keep their place and lose their id."""
    low = (F.col("mapping_status") == "mapped") & (F.col("score") < threshold)
    return rows.withColumns({"concept_id": F.when(~low, F.col("concept_id")), "mapping_status": F.when(low, "no_candidate_fit").otherwise(F.col("mapping_status"))})


def complete_decisions(items: DataFrame, decisions: DataFrame, key: str = "item_id") -> DataFrame:
    """Items with their decision: unknown ones are dropped, ids decided twice count as undecided,
    and undecided items go to review with an error code."""
    once = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("verdict").alias("verdict")).where("_n = 1").drop("_n")
    rows = items.join(once, key, "left")
    missing = F.col("verdict").isNull()
    return rows.withColumns({"review_status": F.when(missing, "review"), "error_code": F.when(missing, "incomplete_mapping_decision")})


def in_scope(chosen: Column, candidates: Column) -> Column:
    """Struct (kept, dropped): chosen ids that are among the candidates, and that are not."""
    return F.struct(F.array_intersect(chosen, candidates).alias("kept"), F.array_except(chosen, candidates).alias("dropped"))


def evidence_stratum(methods: Column, verdict: Column, confidence: Column, category_confidence: Column, status: Column, n_candidates: Column) -> Column:
    """What a mapping rests on: its lane, verdict, confidences, assertion and number of candidates."""
    model = F.exists(methods, lambda m: m.startswith("model-pass"))
    recognised = F.arrays_overlap(methods, F.lit(["native", "fasthpocr"]))
    lane = (
        F.when(model & recognised, "model+recognizer").when(F.array_contains(methods, "model-pass-1"), "model-pass-1")
        .when(F.array_contains(methods, "model-pass-2"), "model-pass-2").when(recognised, "recognizer").otherwise("other")
    )
    parts = [F.coalesce(F.nullif(c, F.lit("")), F.lit("none")) for c in (verdict, confidence, category_confidence, status)]
    return F.concat_ws("|", lane, *parts, F.concat(F.lit("set-"), n_candidates.cast("string")))


def check_calibration(manifest: dict, pipeline: str, prompts_sha256: str, artifacts_sha256: str) -> None:
    """A calibration is for one pipeline, prompt bundle and artifact manifest: any other is an error."""
    for key, want in (("pipeline_schema_version", pipeline), ("prompt_bundle_sha256", prompts_sha256), ("artifact_manifest_sha256", artifacts_sha256)):
        if manifest.get(key) != want:
            raise ValueError(f"the calibration is for another {key}")


def apply_calibration(rows: DataFrame, strata: DataFrame, accepted: list[str], overall: float, identity: str = "") -> DataFrame:
    """From rows with category, mapping_status, review_status, candidate_hpo_ids and stratum: abnormal
    mapped ones with candidates get their stratum's probability, or the overall one, and are accepted
    where the stratum is listed, else up for review. Others are left as they are."""
    found = rows.join(strata.select("stratum", F.col("probability").alias("_probability")), "stratum", "left")
    use = F.coalesce((F.col("category") == "Abnormal") & (F.col("mapping_status") == "mapped") & (F.size("candidate_hpo_ids") > 0), F.lit(False))
    old = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    return found.withColumns({
        "overall_confidence": F.when(use, F.coalesce("_probability", F.lit(overall))).otherwise(old("overall_confidence", "double")),
        "confidence_basis": F.when(use, F.lit(f"held-out-calibration:{identity}")).otherwise(old("confidence_basis", "string")),
        "review_status": F.when(use, F.when(F.col("stratum").isin(accepted), "accepted").otherwise("review")).otherwise(F.col("review_status")),
    }).drop("_probability")


def policies(review: Column, confidence: Column, methods: Column) -> dict[str, Column]:
    """The named policies over mapped rows: which rows each keeps."""
    accepted, has = review == "accepted", lambda m: F.array_contains(methods, m)
    model = F.exists(methods, lambda m: m.startswith("model-pass"))
    some, both = F.arrays_overlap(methods, F.lit(["native", "fasthpocr"])), has("native") & has("fasthpocr")
    return {
        "accepted": accepted,
        "accepted_high": accepted & (confidence == "high"),
        "accepted_model": accepted & model,
        "accepted_model_pass1": accepted & has("model-pass-1"),
        "accepted_model_pass2": accepted & has("model-pass-2"),
        "accepted_model_recognizer_agreement": accepted & model & some,
        "accepted_pass1_plus_model_recognizer_agreement": accepted & (has("model-pass-1") | (model & some)),
        "accepted_pass1_plus_dual_recognizer": accepted & (has("model-pass-1") | both),
        "accepted_plus_high_review": accepted | ((review == "review") & (confidence == "high")),
        "all_mapped": F.lit(True),
        "all_mapped_model": model,
        "all_mapped_model_pass1": has("model-pass-1"),
    }


def replayable(category: Column, candidates: Column, methods: Column) -> Column:
    """Rows worth mapping anew: abnormal, with candidates, from the first pass or both recognisers."""
    both = F.array_contains(methods, "native") & F.array_contains(methods, "fasthpocr")
    return F.coalesce((category == "Abnormal") & (F.size(candidates) > 0) & (F.array_contains(methods, "model-pass-1") | both), F.lit(False))


def verified(decision: Column, candidates: Column, verdict: Column, confidence: Column, selected: Column) -> Column:
    """(status, reason, selected_id) of an abstained decision (status, reason) after a verifier's answer.
    Only a confident selection accepts; an id outside the candidates, or one beside another verdict, is
    an error; decisions without an answer stay."""
    wrong = ((verdict == "select") & ~F.coalesce(F.array_contains(candidates, selected), F.lit(False))) | ((verdict != "select") & selected.isNotNull())
    sure = (verdict == "select") & (confidence == "high")
    none = F.lit(None).cast("string")
    out = F.when(verdict.isNull(), F.struct(decision["status"].alias("status"), decision["reason"].alias("reason"), none.alias("selected_id")))
    out = out.when(wrong, F.raise_error(F.lit("the verifier's answer is outside its question")).cast("struct<status:string,reason:string,selected_id:string>"))
    out = out.when(sure, F.struct(F.lit("accepted_verified").alias("status"), F.lit("model_verified_high_confidence").alias("reason"), selected.alias("selected_id")))
    return out.otherwise(F.struct(decision["status"].alias("status"), F.concat_ws("_", F.lit("model"), verdict, confidence).alias("reason"), none.alias("selected_id")))


def before_categories(rows: DataFrame) -> DataFrame:
    """Rows whose final category failed, as they were before it, to be decided anew; others stay."""
    failed = F.coalesce(F.col("error_code") == "incomplete_final_category", F.lit(False))
    fits = (F.col("mapping_status") == "mapped") & (F.size("candidate_hpo_ids") > 0) & F.col("mapping_verdict").isin("supported", "ambiguous") & F.col("confidence").isin("high", "medium")
    rejected = (F.col("mapping_verdict") == "unsupported") & (F.col("confidence") == "high")
    was = F.when(F.col("assertion_status") != "affirmed", "review").when(fits, "accepted").when(rejected, "rejected").otherwise("review")
    return rows.withColumns({
        "review_status": F.when(failed, was).otherwise(F.col("review_status")),
        **{c: F.when(~failed, F.col(c)) for c in ("category", "category_confidence", "error_code", "error_message") if c in rows.columns},
    })


def walk_acceptance(candidates: DataFrame, budget: int = 500, enough: int = 15, most: int = 20, floor: float = 0.35) -> DataFrame:
    """From (query_id, rank, concept_id, score, overlaps): candidates by rank; each further row of
    a concept uses up budget; a row stays if it overlaps, scores ``floor`` or fewer than ``enough``
    have stayed; at most ``most`` concepts. A fold, as each step depends on the ones before."""
    one = F.struct("rank", "concept_id", "score", "overlaps")
    rows = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    start = F.struct(F.transform(F.slice("all", 1, 0), lambda x: x["concept_id"]).alias("kept"), F.lit(0).alias("repeats"))

    def step(acc: Column, x: Column) -> Column:
        again = F.array_contains(acc["kept"], x["concept_id"])
        fits = ~again & (acc["repeats"] < budget) & (F.size(acc["kept"]) < most) & (x["overlaps"] | (x["score"] >= floor) | (F.size(acc["kept"]) < enough))
        kept = F.when(fits, F.array_append(acc["kept"], x["concept_id"])).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), (acc["repeats"] + again.cast("int")).alias("repeats"))

    return rows.select("query_id", F.aggregate("all", start, step)["kept"].alias("kept"))

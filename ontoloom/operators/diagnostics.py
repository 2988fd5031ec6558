"""Why references were missed and predictions wrong, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def miss_stage(exact: Column, relation: Column, alignment: Column, category: Column, in_eight: Column, in_candidates: Column) -> Column:
    """Where a reference was lost."""
    return (
        F.when(exact, "mapped_exact")
        .when(relation.isin("predicted_ancestor", "predicted_descendant"), "exact_scoring_disagreement")
        .when(alignment.isNull() | (alignment < 75), "absent_extraction")
        .when(category != "Abnormal", "excluded_category")
        .when(in_eight, "mapper_choice_or_rejection")
        .when(in_candidates, "retrieval_breadth")
        .otherwise("embedding_retrieval_miss")
    )


def error_class(relation: Column, similarity: Column) -> Column:
    """What a false positive is."""
    return (
        F.when(relation == "predicted_descendant", "greater_specificity")
        .when(relation == "predicted_ancestor", "lesser_specificity")
        .when(relation == "sibling", "related_sibling")
        .when(similarity >= 85, "wrong_mapping")
        .otherwise("unresolved_possible_manual_omission")
    )


def loss_cause(recognised: Column, retrieved: Column, shrunk: Column, bounded: Column, payload: Column, deferred: Column, forced: Column, mapped: Column, off_category: Column) -> Column:
    """The first of nine causes that holds for a lost reference group."""
    return (
        F.when(~(recognised | retrieved), "extraction miss")
        .when(shrunk & ~retrieved, "span alignment")
        .when(~retrieved, "retrieval miss")
        .when(~bounded, "candidate truncation")
        .when((deferred | ~payload) & forced, "premature deferral")
        .when(deferred | ~payload, "mapper reasoning")
        .when(~mapped, "mapper reasoning")
        .when(off_category, "category assignment")
        .when(mapped, "threshold exclusion")
        .otherwise("evaluation disagreement")
    )


def best_relation(relations: DataFrame) -> DataFrame:
    """For each (case_id, prediction): the closest reference, by kind of relation, then distance."""
    kind = F.when(F.col("relation") == "exact", -1).when(F.col("relation") == "predicted_descendant", 0).when(F.col("relation") == "predicted_ancestor", 1).when(F.col("relation") == "sibling", 2).otherwise(3)
    order = F.struct(kind, F.coalesce("distance", F.lit(10**9)), "reference")
    return relations.groupBy("case_id", "prediction").agg(F.min_by(F.struct("reference", "relation", "distance"), order).alias("b")).select("case_id", "prediction", "b.*")


def greedy_assignment(edges: DataFrame) -> DataFrame:
    """(case_id, left, right): left nodes in order, each to its first free right node; greedy, so
    not always a largest matching. A fold over each case's short list of edges."""
    rows = edges.groupBy("case_id").agg(F.sort_array(F.collect_set(F.struct("left", "right"))).alias("all"))
    free = lambda kept, e: ~F.exists(kept, lambda k: (k["left"] == e["left"]) | (k["right"] == e["right"]))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, e: F.when(free(acc, e), F.array_append(acc, e)).otherwise(acc))
    return rows.select("case_id", F.explode(kept).alias("e")).select("case_id", "e.left", "e.right")


def rerank(candidates: DataFrame, k: int = 16) -> DataFrame:
    """From (query_id, query, place, term, score): score, half the share of query words in the term,
    and 2 for the same text; equal ones keep their order."""
    q, t = F.lower(F.trim("query")), F.lower(F.trim("term"))
    words = F.array_distinct(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, F.split(t, r"\s+"))) / F.size(words)).otherwise(0.0)
    total = F.coalesce("score", F.lit(0.0)) + share * 0.5 + F.when(q == t, 2.0).otherwise(0.0)
    rows = candidates.withColumn("total", F.round(total, 9))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("total"), "place")))
    return rows.where(F.col("rank") <= k)


def repeat_variability(cases: DataFrame) -> DataFrame:
    """From (run, case_id, f1): each case's range and deviation over its runs."""
    return cases.groupBy("case_id").agg((F.max("f1") - F.min("f1")).alias("f1_range"), F.coalesce(F.stddev_samp("f1"), F.lit(0.0)).alias("f1_deviation"))


def conclusion(low: Column, high: Column, p: Column) -> Column:
    """better or worse where the interval leaves zero out and p is below 0.05."""
    return F.when((low > 0) & (p < 0.05), "better").when((high < 0) & (p < 0.05), "worse").otherwise("inconclusive")


def hybrid_verdict(agrees: Column, status: Column, located: Column, verdict: Column, confidence: Column) -> Column:
    """(status, reason) of a model's finding: agreement is accepted; what is not affirmed or not
    found in the text is kept as ambiguous; only a confident unsupported review rejects."""
    says = lambda s, r: F.struct(F.lit(s).alias("status"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    affirmed = status.isNull() | (status == "affirmed")
    reviewed = F.concat(F.lit("model_review_"), verdict, F.lit("_"), confidence)
    return (
        F.when(agrees & affirmed, says("accepted", "recognizer_agreement"))
        .when(~affirmed, says("retained_ambiguous", F.concat(F.lit("assertion_"), status, F.lit("_retained"))))
        .when(~located, says("retained_ambiguous", "phrase_not_located"))
        .when((verdict == "unsupported") & (confidence == "high"), says("rejected", reviewed))
        .when(verdict == "supported", says("accepted", reviewed))
        .otherwise(says("retained_ambiguous", reviewed))
    )


def final_category(rows: DataFrame, decisions: DataFrame, key: str = "mention_id") -> DataFrame:
    """Rows without category take the decision (mention_id, category, confidence) made once for
    them. What isn't abnormal loses its id; low confidence sends accepted rows to review; rows
    without a decision are kept as abnormal, for review."""
    once = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("category").alias("_category"), F.first("confidence").alias("_confidence")).where("_n = 1")
    rows = rows.join(once, key, "left")
    open_, found = F.col("category").isNull(), F.col("_category").isNotNull()
    off = open_ & found & (F.col("_category") != "Abnormal")
    review = (
        F.when(open_ & ~found, "review")
        .when(off, F.when(F.col("_confidence").isin("high", "medium"), "accepted").otherwise("review"))
        .when(open_ & (F.col("_confidence") == "low") & (F.col("review_status") == "accepted"), "review")
        .otherwise(F.col("review_status"))
    )
    return rows.withColumns({
        "review_status": review,
        "hpo_id": F.when(~off, F.col("hpo_id")),
        "mapping_status": F.when(off, "not_mapped_category").otherwise(F.col("mapping_status")),
        "error_code": F.when(open_ & ~found, "incomplete_final_category"),
        "category": F.when(open_, F.coalesce("_category", F.lit("Abnormal"))).otherwise(F.col("category")),
    }).drop("_n", "_category", "_confidence")


def fingerprint(hashes: DataFrame, digits: int = 2) -> DataFrame:
    """One row (rows, fingerprint) for a column ``h`` of hexadecimal digests in any order: digests are
    sorted and hashed by their first ``digits``, then those hashes in order. Take more digits for more
    rows, so that a part stays a short list."""
    parts = hashes.groupBy(F.substring("h", 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("d"))
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n")
    return parts.agg(F.sum("n").alias("rows"), F.sha2(all_, 256).alias("fingerprint"))


def metric_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of two tables of cases (tp, fp, fn) how much the sums differ, and the predicted positives."""
    sums = lambda df, n: df.agg(*[F.sum(c).alias(f"{n}_{c}") for c in ("tp", "fp", "fn")])
    rows = sums(old, "old").crossJoin(sums(new, "new"))
    less = {c: F.col(f"new_{c}") - F.col(f"old_{c}") for c in ("tp", "fp", "fn")}
    return rows.select((less["tp"] + less["fp"]).alias("predicted_positive"), *[d.alias(c) for c, d in less.items()])


def paired(first: DataFrame, second: DataFrame, value: str = "f1", case: str = "case_id") -> DataFrame:
    """(case, first, second, d) of two runs over the same cases; a case that one lacks is an error."""
    both = first.select(case, F.col(value).alias("first")).join(second.select(case, F.col(value).alias("second")), case, "full")
    missing = F.col("first").isNull() | F.col("second").isNull()
    d = F.when(missing, F.raise_error(F.concat(F.lit("one run lacks case "), F.col(case).cast("string"))).cast("double")).otherwise(F.col("second") - F.col("first"))
    return both.withColumn("d", d)

"""The whole annotation without a model: notes and an ontology in, result rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import assertion, lexical
from ..operators.decisions import deduplicate, native_decision
from ..sources import obo, sinks


def annotate(notes: DataFrame, phrases: DataFrame, labels: DataFrame) -> DataFrame:
    """From notes (patient_id, clinical_note), phrases (concept_id, phrase, record_key) and labels
    (id, label): result rows. Texts are joined back only to notes with mentions."""
    notes = notes.select(F.xxhash64("patient_id", "clinical_note").alias("note_id"), "patient_id", F.col("clinical_note").alias("text"))
    exact = lexical.lexicon(phrases)
    found = lexical.longest_nonoverlapping(lexical.mentions(notes, exact, lexical.morphological_lexicon(exact)))
    rows = assertion.with_assertion(found.join(notes, "note_id"))
    phrase = F.expr("substring(text, start + 1, stop - start)")
    rows = rows.withColumn("phrase", phrase).withColumn("d", native_decision(F.col("ids"), F.col("status")))
    category = assertion.routing_category(F.col("status"), F.col("phrase"))
    abnormal = category == "Abnormal"
    rows = rows.join(labels.withColumnsRenamed({"id": "_id", "label": "_label"}), F.col("d.selected_id") == F.col("_id"), "left")
    out = rows.select(
        "patient_id", "phrase", category.alias("category"),
        F.when(abnormal, F.col("d.selected_id")).alias("hpo_id"), F.when(abnormal, F.col("_label")).alias("hpo_term"),
        F.when(~abnormal, "not_mapped_category").when(F.col("d.selected_id").isNull(), "no_candidate_fit").otherwise("mapped").alias("mapping_status"),
        F.col("start").alias("evidence_start"), F.col("stop").alias("evidence_end"), F.col("status").alias("assertion_status"), F.col("d.confidence").alias("confidence"),
        F.col("d.review_status").alias("review_status"), F.array(F.lit("native")).alias("source_methods"), F.slice("ids", 1, 3).alias("candidate_hpo_ids"),
        F.array(F.struct(F.col("start").alias("start"), F.col("stop").alias("end"))).alias("evidence_segments"), F.col("d.verdict").alias("mapping_verdict"),
        F.lit("uncalibrated-evidence").alias("confidence_basis"), F.col("sentence").alias("evidence_text"), F.xxhash64("note_id", "start").alias("_seq"),
    )
    out = deduplicate(out.withColumn("_phrase", F.lower("phrase")), ["patient_id", "hpo_id", "evidence_start", "evidence_end", "_phrase"], "review_status", "_seq")
    return sinks.result_rows(out)


def annotate_file(spark, notes_path: str, obo_path: str) -> tuple[DataFrame, DataFrame]:
    """(results, invalid input rows) of a CSV of notes and an ontology file."""
    from ..sources.tables import load_notes

    terms = obo.terms(spark, obo_path)
    active = terms.where("NOT obsolete")
    good, bad = load_notes(spark, notes_path)
    return annotate(good, obo.phrases(active), active.select("id", "label")), sinks.result_rows(bad)


def hashed_embedding(phrase: Column, size: int = 64) -> Column:
    """An offline stand-in for an encoder: character n-grams hashed to signed places, length one."""
    from ..operators.retrieval import char_grams

    grams = F.transform(char_grams(F.lower(phrase)), lambda g: F.xxhash64(g))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(grams, F.lit(0.0), lambda a, h: a + F.when(F.pmod(h, F.lit(size)) == k, F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).cast("array<float>")


def vectorize(phrases: DataFrame, labels: DataFrame) -> DataFrame:
    """The vector entries of phrases (row_id, hp_id, phrase, term, definition, source, embedding)."""
    rows = phrases.join(labels.withColumnsRenamed({"id": "concept_id", "label": "term"}), "concept_id")
    row_id = F.xxhash64("record_key")
    return rows.select(row_id.alias("row_id"), F.col("concept_id").alias("hp_id"), "phrase", "term", F.lit("").alias("definition"), "source", hashed_embedding(F.col("phrase")).alias("embedding"))

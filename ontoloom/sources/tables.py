"""Notes, references, predictions and selections from CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import blank_as
from ..functions.text import canonical_note
from ..operators.graph import normalise_ids

#: Fixed value: the shape of a concept id.
ID = r"HP:\d{7}"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Everything a string; a byte-order mark before the header is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def load_notes(spark: SparkSession, path: str, ids: tuple[str, ...] = ("patient_id", "Case"), text: str = "clinical_note") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows: row_index, patient_id, clinical_note, note_sha256. The id is the first
    of ``ids`` that is present and not blank, else the 1-based row; blank notes are invalid."""
    df = read_csv(spark, path)
    if text not in df.columns:
        raise ValueError(f"{path} has no column {text}")
    # The file's own order: a file of notes is one partition, as quoted fields may hold newlines.
    rows = df.withColumn("row_index", F.monotonically_increasing_id())
    known = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ids if c in df.columns]
    note = canonical_note(F.col(text))
    rows = rows.select("row_index", F.coalesce(*known, (F.col("row_index") + 1).cast("string")).alias("patient_id"), note.alias("clinical_note"))
    rows = rows.withColumn("note_sha256", F.sha2("clinical_note", 256))
    bad = rows.where("clinical_note IS NULL").select("row_index", "patient_id", F.lit("error").alias("mapping_status"), F.lit("invalid_input").alias("error_code"))
    return rows.where("clinical_note IS NOT NULL"), bad


def manual_note(spark: SparkSession, patient_id: str, text: str) -> DataFrame:
    rows = spark.createDataFrame([(0, patient_id, text)], "row_index long, patient_id string, clinical_note string")
    return rows.withColumn("clinical_note", canonical_note(F.col("clinical_note"))).withColumn("note_sha256", F.sha2("clinical_note", 256))


def candidate_ids(cell: Column) -> Column:
    """A cell that holds a JSON list of ids, or text with ids in it."""
    return F.coalesce(F.from_json(cell, "array<string>", {"mode": "PERMISSIVE"}), F.regexp_extract_all(cell, F.lit(f"({ID})"), F.lit(1)))


def reference_groups(rows: DataFrame, aliases: DataFrame, case: str = "Patient ID", cell: str = "hpo_term") -> DataFrame:
    """(case_id, n, ids): one finding for each row, with its alternatives; equal rows stay apart."""
    rows = rows.withColumn("n", F.monotonically_increasing_id()).select(F.trim(F.col(case)).alias("case_id"), "n", F.explode(F.regexp_extract_all(cell, F.lit(f"({ID})"), F.lit(1))).alias("id"))
    return normalise_ids(rows, aliases).groupBy("case_id", "n").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def reference_sets(rows: DataFrame, aliases: DataFrame, case: str = "Patient ID", cell: str = "hpo_term") -> DataFrame:
    flat = reference_groups(rows, aliases, case, cell).select("case_id", F.explode("ids").alias("id"))
    return flat.groupBy("case_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def accepted(rows: DataFrame) -> Column:
    """Null and empty statuses count as accepted and mapped."""
    review = blank_as(F.col("review_status"), "accepted") if "review_status" in rows.columns else F.lit("accepted")
    mapped = blank_as(F.col("mapping_status"), "mapped") if "mapping_status" in rows.columns else F.lit("mapped")
    return (review == "accepted") & (mapped == "mapped")


def prediction_sets(rows: DataFrame, aliases: DataFrame, accepted_only: bool = True) -> DataFrame:
    """(case_id, ids): a case with no usable id stays, with an empty set."""
    use = accepted(rows) if accepted_only else F.lit(True)
    flat = normalise_ids(rows.withColumn("id", F.when(use, F.nullif(F.col("hpo_id"), F.lit("")))), aliases)
    return flat.groupBy(F.col("patient_id").alias("case_id")).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def prediction_groups(rows: DataFrame, aliases: DataFrame, most: int = 3) -> DataFrame:
    """(case_id, n, ids): a set of candidates for each row, the first of equal sets of a case.
    More than ``most`` candidates are an error."""
    listed = candidate_ids(F.col("candidate_hpo_ids").cast("string")) if "candidate_hpo_ids" in rows.columns else F.lit(None).cast("array<string>")
    ids = F.coalesce(F.when(F.size(listed) > 0, listed), F.when(F.nullif(F.col("hpo_id"), F.lit("")).isNotNull(), F.array("hpo_id")))
    rows = rows.where(accepted(rows)).withColumn("n", F.monotonically_increasing_id()).select(F.col("patient_id").alias("case_id"), "n", ids.alias("ids")).where("ids IS NOT NULL")
    rows = rows.withColumn("ids", F.when(F.size("ids") > most, F.raise_error(F.lit("too many candidates"))).otherwise(F.col("ids")).cast("array<string>"))
    flat = normalise_ids(rows.select("case_id", "n", F.explode("ids").alias("id")), aliases)
    sets = flat.groupBy("case_id", "n").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return sets.groupBy("case_id", "ids").agg(F.min("n").alias("n")).select("case_id", "n", "ids")


def selected_cases(spark: SparkSession, path: str, keys: tuple[str, ...] = ("selected_case_ids", "confirmation_case_ids", "repeat_case_ids", "case_ids")) -> DataFrame:
    """(place, case_id) of the first of ``keys`` that a manifest has, at its top or below
    ``selection``."""
    df = spark.read.json(path, multiLine=True)
    nested = df.schema["selection"].dataType.names if "selection" in df.columns else []
    found = [F.col(f"selection.{k}") for k in keys if k in nested] + [F.col(k) for k in keys if k in df.columns]
    if not found:
        raise ValueError(f"{path} has none of {', '.join(keys)}")
    return df.select(F.posexplode(F.coalesce(*[c.cast("array<string>") for c in found])).alias("place", "case_id"))


#: Codes of rows whose calculation is missing, so that their case can't be scored.
CALCULATION_ERRORS = ("incomplete_mapping_decision", "incomplete_final_category")


def calculation_errors(rows: DataFrame) -> DataFrame:
    """(case_id, codes): what makes a case unscorable. Rows in error count with their code, or as
    row_failure; others only with one of CALCULATION_ERRORS."""
    code = F.nullif(F.trim(F.coalesce("error_code", F.lit(""))), F.lit(""))
    found = F.when(F.col("mapping_status") == "error", F.coalesce(code, F.lit("row_failure"))).when(code.isin(*CALCULATION_ERRORS), code)
    named = rows.withColumn("code", found).where(F.col("code").isNotNull() & (F.trim("patient_id") != ""))
    return named.groupBy(F.trim("patient_id").alias("case_id")).agg(F.array_sort(F.collect_set("code")).alias("codes"))

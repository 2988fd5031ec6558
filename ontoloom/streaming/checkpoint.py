"""Resumable row state as an append-only table: the last write of a row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "row_index long, patient_id string, note_sha256 string, status string, results_json string, error_code string, error_message string, attempt long"


class RowState:
    """State below ``folder``. ``identity`` (a flat dict of strings) must be that of the run that
    began it; a run that doesn't resume begins anew."""

    def __init__(self, spark: SparkSession, folder: str, identity: dict[str, str], resume: bool = True):
        self.spark, self.folder = spark, folder
        said = spark.createDataFrame(sorted(identity.items()), "key string, value string")
        try:
            known = spark.read.schema("key string, value string").parquet(f"{folder}/identity")
            known.isEmpty()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        if known is not None and resume:
            if not known.exceptAll(said).isEmpty() or not said.exceptAll(known).isEmpty():
                raise ValueError("the state belongs to another run")
            return
        said.coalesce(1).write.mode("overwrite").parquet(f"{folder}/identity")
        spark.createDataFrame([], STATE).write.mode("overwrite").parquet(f"{folder}/rows")

    def rows(self) -> DataFrame:
        """The last write of each row."""
        table = self.spark.read.schema(STATE).parquet(f"{self.folder}/rows")
        last = F.max_by(F.struct(*table.columns), "attempt")
        return table.groupBy("row_index").agg(last.alias("r")).select("r.*")

    def pending(self, notes: DataFrame) -> DataFrame:
        """Notes (row_index, note_sha256) that are not complete. A note that changed since it was
        completed is an error."""
        done = self.rows().where("status = 'complete'").select("row_index", F.col("note_sha256").alias("seen"))
        rows = notes.join(done, "row_index", "left")
        changed = F.when(F.col("seen") != F.col("note_sha256"), F.raise_error(F.lit("a note changed since it was completed"))).otherwise(F.col("seen"))
        return rows.withColumn("seen", changed.cast("string")).where("seen IS NULL").drop("seen")

    def save(self, results: DataFrame, attempt: int) -> None:
        """Append finished rows (those columns of STATE that ``results`` has)."""
        names = [f.split()[0] for f in STATE.split(", ")]
        kinds = dict(f.split() for f in STATE.split(", "))
        row = [(F.col(n) if n in results.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names if n != "attempt"]
        results.select(*row, F.lit(attempt).cast("long").alias("attempt")).write.mode("append").parquet(f"{self.folder}/rows")

    def attach(self, stream: DataFrame, location: str):
        """Save a stream of finished rows, a micro-batch at a time; the batch number is the attempt,
        so a batch that is written twice changes nothing."""
        return stream.writeStream.foreachBatch(lambda df, n: self.save(df, n + 1)).option("checkpointLocation", location).trigger(availableNow=True).start()

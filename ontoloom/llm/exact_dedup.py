"""Exact deduplication with streaming state on disk (operator 3).

Texts are equal when they are identical after deleting white space (0x20, 0x09-0x0D); null counts
as empty. Of equal texts the row with the most code points in its text stays, then the smallest
doc_id (null after all), then the first in the order in which rows were taken in.

``ExactDedup.add`` reduces documents to entries in the shared folder: digest, code points, doc_id and
the row's locator (a number that it gets there). A streaming query over that folder keeps, for each
digest, the number of entries and the first of them in the order above; it aggregates before it
shuffles, so a text that fills a third of the table arrives at its state as one row for each task. The
state is in RocksDB, has no watermark and so never expires; its snapshots are in the shared folder,
and more documents can be added at any time, by another session too.

A hit, which is an entry whose digest others have, is believed only when its bytes are those of the
others: the distinct texts of each such digest are found, first inside tasks, then over all, so of a
text that many rows have each task passes on one copy. Should different texts ever share a digest,
their groups are made from the texts.

Rows that are alike in everything are rows like others: one of them stays. Extra columns are ignored,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BATCHES, new_folder, settings, stored, text_or_empty, unused

#: Duplicated digests up to which 8 bytes of each are broadcast to find the rows that have them.
BROADCAST_DIGESTS = 2_000_000
#: Duplicated texts up to which the table of their decisions (about 150 bytes each) is broadcast.
BROADCAST_GROUPS = 200_000
#: Groups with more than this share of all rows are joined by broadcast in any case: there are at most
#: as many as its inverse.
HEAVY = 1 / 1000
_ENTRY = "row long, call string, doc_id long, n_points int, digest binary"

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # Many small stores: without this each one reserves megabytes of disk for its log.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: In a local folder (tests, or one that machines share) the default manager runs a shell command
#: for each status it reads; this one doesn't.
_LOCAL = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}
#: Entries for which one more state partition is worth opening a store, up to the session's number.
PER_STORE = 20_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class ExactDedup:
    """``folder``: where entries and state are kept; the same folder goes on from there."""

    def __init__(self, spark: SparkSession, folder: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.digest = spark, digest
        self.folder = folder or new_folder(spark, "exact-dedup")

    def add(self, docs: DataFrame) -> None:
        """Take in documents (doc_id, text) and bring the state up to date."""
        text = text_or_empty()
        entries = docs.select(F.monotonically_increasing_id().alias("row"), F.lit(uuid.uuid4().hex).alias("call"), F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("n_points"), self.digest(normalised(text)).alias("digest"))
        with settings(self.spark, BATCHES):
            entries.write.mode("append").parquet(f"{self.folder}/entries")
        rows = self.spark.read.parquet(f"{self.folder}/entries").count()
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # A state that is there already keeps its number of partitions.
        values = _STATE | {"spark.sql.shuffle.partitions": str(min(most, max(4, rows // PER_STORE)))}
        if self.folder.startswith(("file:", "/")):
            values |= _LOCAL
        with settings(self.spark, values):
            first = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("without"), "doc_id", "call", "row"))
            entries = self.spark.readStream.schema(_ENTRY).parquet(f"{self.folder}/entries")
            state = entries.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
            query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()

    def state(self) -> DataFrame:
        """digest, group_size, keep_id, keep_points, keep_call, keep_row: what is retained of each text."""
        rows = self.spark.read.format("statestore").load(f"{self.folder}/state")
        value = {f.name: F.col(f"value.`{f.name}`") for f in rows.schema["value"].dataType.fields}
        count, first = value["count"], value["min"]
        return rows.select(
            F.col("key.digest").alias("digest"), count.alias("group_size"),
            first["doc_id"].alias("keep_id"), (-first["less"]).alias("keep_points"), first["call"].alias("keep_call"), first["row"].alias("keep_row"),
        )

    def entries(self) -> DataFrame:
        return self.spark.read.schema(_ENTRY).parquet(f"{self.folder}/entries")

    def decide(self, docs: DataFrame) -> DataFrame:
        """For each entry doc_id, digest, keep_id, group_size and kept. ``docs`` are all rows that were
        taken in: their texts are compared."""
        groups = stored(self.state().where("group_size > 1"), "groups")
        n_groups, entries = groups.count(), self.entries()
        clash = self._clashes(docs, groups, n_groups)
        clashes = not clash.isEmpty()
        sure = groups.join(clash, "digest", "left_anti") if clashes else groups
        single = entries.join(clash, "digest", "left_anti") if clashes else entries
        rows = self._grouped(single, sure, n_groups)
        alone = F.col("group_size").isNull()
        out = rows.select(
            "doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (alone | ((F.col("call") == F.col("keep_call")) & (F.col("row") == F.col("keep_row")))).alias("kept"),
        )
        return out.unionByName(self._by_text(docs, clash)) if clashes else out

    def kept_rows(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs``, which are those that were taken in, that stay: with all their columns.

        Most are told by digest, doc_id and length. Where several rows of a text are alike in these, or
        digests clash, one row is taken from those of each text, first inside tasks."""
        groups = stored(self.state().where("group_size > 1").select("digest", "group_size", "keep_id", "keep_points"), "groups")
        n_groups = groups.count()
        as_kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
        repeated = self._grouped(self.entries(), groups, n_groups).where(as_kept).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
        special = stored(repeated.union(self._clashes(docs, groups, n_groups)).distinct(), "special")
        names = {c: unused(docs, f"_{c}") for c in ("digest", "group_size", "keep_id", "keep_points")}
        digest = names["digest"]
        rows, text = docs.withColumn(digest, self.digest(normalised(text_or_empty()))), text_or_empty()
        told = groups.join(special, "digest", "left_anti").withColumnsRenamed(names)
        stays = F.col(names["group_size"]).isNull() | (F.col("doc_id").cast("long").eqNullSafe(F.col(names["keep_id"])) & (F.char_length(text) == F.col(names["keep_points"])))
        several = special.withColumnRenamed("digest", digest)
        n_special = special.count()
        several = F.broadcast(several) if n_special <= BROADCAST_GROUPS else several
        plain = rows.join(several, digest, "left_anti") if n_special else rows
        if n_groups <= BROADCAST_GROUPS:
            out = plain.join(F.broadcast(told), digest, "left").where(stays).select(*docs.columns)
        else:
            # Only rows that may have copies are shuffled, and none of a heavy group.
            short = groups.select(F.xxhash64("digest").alias("_short"))
            short = F.broadcast(short) if n_groups <= BROADCAST_DIGESTS else short
            among = F.xxhash64(digest) == F.col("_short")
            heavy = F.col(names["group_size"]) > HEAVY * self.entries().count()
            hits = plain.join(short, among, "left_semi").join(F.broadcast(told.where(heavy)), digest, "left")
            light = hits.where(F.col(names["group_size"]).isNull()).select(*rows.columns).join(told.where(~heavy), digest, "left")
            out = plain.join(short, among, "left_anti").select(*docs.columns)
            out = out.unionByName(hits.where(F.col(names["group_size"]).isNotNull() & stays).select(*docs.columns)).unionByName(light.where(stays).select(*docs.columns))
        if not n_special:
            return out
        order = F.struct(-F.char_length(text), F.col("doc_id").isNull(), F.col("doc_id").cast("long"))
        own = rows.join(several, digest, "left_semi").groupBy(digest, normalised(text).alias("plain")).agg(F.min_by(F.struct(*docs.columns), order).alias("kept"))
        return out.unionByName(own.select("kept.*"))

    def _clashes(self, docs: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
        """Digests (few, if any) that different texts have."""
        plain = docs.select(normalised(text_or_empty()).alias("plain")).withColumn("digest", self.digest(F.col("plain")))
        short = groups.select(F.xxhash64("digest").alias("short"))
        if n_groups <= BROADCAST_DIGESTS:
            short = F.broadcast(short)
        # By 8 bytes of the digest: what more comes through makes the comparison no less exact. Beyond
        # the broadcast, texts are shuffled once, after the distinct ones of each task were found.
        hits = plain.distinct().join(short, F.xxhash64("digest") == F.col("short"), "left_semi") if n_groups > BROADCAST_DIGESTS else plain.join(short, F.xxhash64("digest") == F.col("short"), "left_semi").distinct()
        return stored(hits.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "clashes")

    def _grouped(self, entries: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
        """``entries`` with their group, where they have one."""
        if n_groups <= BROADCAST_GROUPS:
            return entries.join(F.broadcast(groups), "digest", "left")
        heavy = groups.where(F.col("group_size") > HEAVY * entries.count())
        many = stored(entries.join(F.broadcast(heavy), "digest", "left"), "with-heavy")
        light = many.where("group_size IS NULL").select(*entries.columns).join(groups, "digest", "left")
        return many.where("group_size IS NOT NULL").unionByName(light)

    def _by_text(self, docs: DataFrame, clash: DataFrame) -> DataFrame:
        """The decisions for digests that different texts share."""
        text = text_or_empty()
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("n_points"), normalised(text).alias("plain"))
        rows = stored(rows.withColumn("digest", self.digest(F.col("plain"))).join(clash, "digest", "left_semi"), "clashing")
        among = Window.partitionBy("digest", "plain")
        order = among.orderBy(-F.col("n_points"), F.asc_nulls_last("doc_id"))
        return rows.select(
            "doc_id", "digest", F.first("doc_id").over(order).alias("keep_id"), F.count(F.lit(1)).over(among).alias("group_size"),
            (F.row_number().over(order) == 1).alias("kept"),
        )


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The decisions for one table: doc_id, keep_id, group_size, kept, text_sha256."""
    dedup = ExactDedup(docs.sparkSession, digest=digest)
    dedup.add(docs)
    out = dedup.decide(docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    dedup = ExactDedup(docs.sparkSession, digest=digest)
    dedup.add(docs)
    return dedup.kept_rows(docs)

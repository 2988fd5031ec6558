"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of whole texts that a reader, and a worker's batch, hold at a time: the usual thousands are
#: arrays of tens of megabytes in each task.
SMALL = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Rows that a worker makes Python objects of at a time.
ROWS = 256


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings are ``values`` inside, and what they were after."""
    kept = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` (or a folder set on the context) names. Only where neither is set
    and all tasks run on this machine, as in tests, is a temporary folder made and set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ontoloom-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, values: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and what later steps read
    is one fixed set of rows even when executors are lost. Session settings are ``values`` meanwhile."""
    path = new_folder(df.sparkSession, name)
    with settings(df.sparkSession, values or {}):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import SMALL as BATCHES
from ..sources.shared import new_folder, settings, shared_dir
from ..sources.shared import stored as write

__all__ = ["lower_ascii", "new_folder", "settings", "shared_dir", "sliced", "stored", "text_key", "text_or_empty", "unused", "without_texts"]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key() -> Column:
    """What tells rows apart where doc_id is missing or repeated: the SHA-256 of the text, null as
    empty."""
    return F.unhex(F.sha2(text_or_empty(), 256))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (see ``sources.shared``), in small batches."""
    return write(df, name, BATCHES)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_texts(docs: DataFrame, lost: DataFrame, name: str, broadcast: int = 200_000) -> DataFrame:
    """``docs`` without the rows whose ``text_key`` is in ``lost`` (one column); up to ``broadcast``
    keys are broadcast. Beyond, the join shuffles: rows of one text that are very many then meet the
    one row of ``lost`` for it, a partition that adaptive execution can split."""
    key = unused(docs, "_lost")
    lost = stored(lost.toDF(key).distinct(), name)
    if lost.count() <= broadcast:
        lost = F.broadcast(lost)
    return docs.join(lost, text_key() == F.col(key), "left_anti")

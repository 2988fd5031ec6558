"""Exact token counts at every prefix (operator 7).

Null and empty texts have no prefixes and zero tokens. Repeated rows give repeated rows, extra
columns stay, and an empty table gives an empty one. The output columns are ``prefix_deltas``
(binary, int16 little-endian for each code point: how much the token count changes with it),
``n_tokens``, ``n_bytes`` and, where a budget is given, ``n_points_within``; columns of the same names
in the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .shared import sliced
from .tokens import longest_prefix, prefix_counter


def _lengths(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def prefix_token_counts(docs: DataFrame, tokenizer: str, text: str = "text", keep_deltas: bool = True, budget: int | None = None) -> DataFrame:
    """Add the prefix table of each text, its token count and its length in UTF-8 bytes; with ``budget``
    also the code points of the longest prefix of at most that many tokens.

    ``keep_deltas=False`` computes the same table and returns only what was asked of it.
    """
    kept = docs.drop("prefix_deltas", "n_tokens", "n_bytes", "n_points_within")
    fields = list(kept.schema.fields) + [T.StructField("prefix_deltas", T.BinaryType())] * keep_deltas
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())]
    fields += [T.StructField("n_points_within", T.LongType())] * (budget is not None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer)
        for batch in sliced(batches):
            deltas, tokens, sizes, within = [], [], [], []
            for t in _lengths(batch, text):
                d = counter.deltas(t)
                tokens.append(int(d.sum(dtype=np.int64)))
                sizes.append(len(t.encode()) if t else 0)
                if budget is not None:
                    within.append(len(d) if tokens[-1] <= budget else longest_prefix(d, budget))
                if keep_deltas:
                    deltas.append(d.tobytes())
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns += [pa.array(deltas, pa.binary())] * keep_deltas
            columns += [pa.array(tokens, pa.int64()), pa.array(sizes, pa.int64())]
            columns += [pa.array(within, pa.int64())] * (budget is not None)
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return kept.mapInArrow(count, T.StructType(fields))


def tokens_in_prefix(deltas: str, length: Column | int) -> Column:
    """Token count of the first ``length`` code points, from the stored table alone."""

    @pandas_udf(T.LongType())
    def answer(table, k):
        return table.combine(k, lambda d, n: int(np.frombuffer(d or b"", np.int16)[: max(0, int(n))].sum(dtype=np.int64)))

    return answer(F.col(deltas), length if isinstance(length, Column) else F.lit(length))


def prefix_within(deltas: str, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from the stored table
    alone: ``substring(text, 1, that)`` truncates without encoding anew."""

    @pandas_udf(T.LongType())
    def answer(table, most):
        return table.combine(most, lambda d, n: longest_prefix(np.frombuffer(d or b"", np.int16), int(n)))

    return answer(F.col(deltas), budget if isinstance(budget, Column) else F.lit(budget))

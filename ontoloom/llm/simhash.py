"""SimHash near-duplicates by multi-index hashing (operator 9).

A fingerprint has a bit set where over half of the document's shingle hashes have it. Texts are
lower-cased (A-Z), cut at ASCII white space; shingles are three words with one space between,
repeats included; shorter texts are one shingle, texts without words (null too) have fingerprint
zero and are linked like any other. Rows that repeat a doc_id each have a row, and the same
component_id if they have the same fingerprint; rows without doc_id take part like others, and name a
component only where all of its rows are without (null comes last). Extra columns are ignored, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import sliced, stored, text_key

#: Words that are hashed and counted at once, so that long texts need no more memory.
_AT_ONCE = 65_536


def fingerprint(text: str | None, words: int = 3) -> int:
    """As an unsigned 64-bit number."""
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for low in range(0, n, _AT_ONCE):
        part = w[low : min(low + _AT_ONCE, n) + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and its fingerprint (as a signed long), and ``_key`` (binary) if docs have it."""
    keys = [c for c in docs.columns if c == "_key"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *keys])

    schema = "doc_id long, fp long" + "".join(f", {c} binary" for c in keys)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keys).mapInArrow(compute, schema)


def near_pairs(fps: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a, b) of different fingerprints ``fp`` that differ in at most ``distance`` bits.

    The 64 bits are cut into segments. Two fingerprints that near differ in at most
    ``distance // segments`` bits of some segment: so each one looks up, for every segment, the
    values of that small Hamming ball in the table of all, and each match's whole distance is
    verified in the join. Which of two looks up the other doesn't matter, so only the larger
    does. Fingerprints must be distinct.
    """
    radius = distance // segments
    bounds = [64 * k // segments for k in range(segments + 1)]
    if radius > 1:
        raise ValueError("balls of radius two and more are not enumerated; use more segments")
    table, probes = [], []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        value = F.shiftrightunsigned("fp", low).bitwiseAND((1 << (high - low)) - 1)
        table.append(F.struct(F.lit(k).alias("segment"), value.alias("value")))
        flips = [0] + [1 << b for b in range(high - low)] * radius
        probes += [F.struct(F.lit(k).alias("segment"), value.bitwiseXOR(F.lit(f).cast("long")).alias("value")) for f in flips]
    owners = fps.select(F.col("fp").alias("b"), F.explode(F.array(*table)).alias("at")).select("b", "at.*")
    seekers = fps.select(F.col("fp").alias("a"), F.explode(F.array(*probes)).alias("at")).select("a", "at.*")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("a") > F.col("b"))
    owners = owners.withColumnsRenamed({"segment": "s", "value": "v"})
    # Merged even where one side is small enough for a broadcast: rows of the table come apart in the join.
    return seekers.join(owners.hint("merge"), (F.col("segment") == F.col("s")) & (F.col("value") == F.col("v")) & near).select("a", "b").distinct()


def simhash_components(docs: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links of at most ``distance`` bits
    reach. Copies share a fingerprint and are linked through it, so a group of copies takes part
    in the search as one row."""
    rows = stored(fingerprints(docs, words), "fingerprints")
    named = _least_linked(rows, F.col("doc_id"), distance)
    return rows.join(named, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def _least_linked(rows: DataFrame, order: Column, distance: int) -> DataFrame:
    """fp, least: for each fingerprint of ``rows`` the least ``order`` that its links reach."""
    distinct = stored(rows.groupBy("fp").agg(F.min(order).alias("own")), "distinct")
    roots = components(near_pairs(distinct, distance))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    linked = rooted.join(roots.select("root").distinct(), "root", "left_semi")
    ids = linked.groupBy("root").agg(F.min("own").alias("least"))
    return rooted.join(ids, "root", "left").select("fp", F.coalesce("least", "own").alias("least"))


def near_copies(docs: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """``text_key`` (as _key) of the texts that go when of linked ones the one with the smallest
    doc_id stays (rows without doc_id come last, then the key decides)."""
    rows = stored(fingerprints(docs.select("doc_id", "text", text_key().alias("_key")), words), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_key")
    least = _least_linked(rows, order, distance).withColumnRenamed("fp", "at")
    found = rows.join(least, F.col("fp") == F.col("at"))
    return found.where(F.col("_key") != F.col("least._key")).select("_key")

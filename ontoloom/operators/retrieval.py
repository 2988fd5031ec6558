"""Candidate retrieval: dense and sparse neighbours, rank fusion and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank fusion weights and constant.
DENSE, LEXICAL, CONTEXT, SPARSE, FUZZY, RANK_CONSTANT = 0.8, 0.2, 0.8, 0.8, 0.2, 60
#: Queries and rows that are multiplied at a time, and queries that a pass over the rows holds. Until a
#: query has its k rows all scores of a tile are sorted, at some 100 bytes each: 13 MB.
TILE, PASS = (64, 2_048), 16_384


def nearest_of_parts(queries: DataFrame, corpus: DataFrame, k: int, tile: tuple[int, int] = TILE) -> DataFrame:
    """(query_id, row_id, score): for each query the k largest inner products of each partition of the
    corpus, exact.

    Queries (query_id, embedding) go to every partition as one array, PASS of them at a time. A worker
    multiplies tiles, and of a tile only scores that reach a query's k-th so far are kept, so it holds k
    rows a query and a few tiles, whatever the table's size, and passes those on once."""
    asked = queries.select("query_id", "embedding").toArrow()
    out = None
    for low in range(0, max(1, asked.num_rows), PASS):
        part = asked.slice(low, PASS)
        shared = corpus.sparkSession.sparkContext.broadcast((part.column(0).to_numpy(), _matrix(part.column(1).combine_chunks())))
        found = corpus.select("row_id", "embedding").mapInArrow(_nearest(shared, k, tile), "query_id long, row_id long, score double")
        out = found if out is None else out.unionByName(found)
    return out


def _matrix(vectors) -> np.ndarray:
    """An Arrow list column as rows of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _nearest(shared, k: int, tile: tuple[int, int]):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        n = len(query_ids)
        best, rows = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        for batch in batches:
            for low in range(0, batch.num_rows, tile[1]):
                part = batch.slice(low, tile[1])
                ids, matrix = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1))
                for at in range(0, n, tile[0]):
                    scores = np.round(vectors[at : at + tile[0]] @ matrix.T, 9)
                    # Of equal scores the smaller id stays, so those that equal the k-th are looked at, too.
                    q, r = np.nonzero(scores >= best[at : at + tile[0], -1:])
                    if not len(q):
                        continue
                    touched, q = np.unique(q, return_inverse=True)
                    old_scores, old_rows = best[at + touched], rows[at + touched]
                    who = np.concatenate([np.repeat(np.arange(len(touched)), k), q])
                    all_scores = np.concatenate([old_scores.ravel(), scores[touched[q], r]])
                    all_rows = np.concatenate([old_rows.ravel(), ids[r]])
                    order = np.lexsort((all_rows, -all_scores, who))
                    starts = np.searchsorted(who[order], np.arange(len(touched)))
                    order = order[starts[:, None] + np.arange(k)]
                    best[at + touched], rows[at + touched] = all_scores[order], all_rows[order]
        for at in range(0, n, tile[0]):
            q, r = np.nonzero(np.isfinite(best[at : at + tile[0]]))
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[at + q]), pa.array(rows[at + q, r]), pa.array(best[at + q, r])], ["query_id", "row_id", "score"])

    return multiply


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, score, rank): the k largest inner products for each query, exact. What is
    shuffled is k rows a query and partition, and ranking happens per query."""
    found = nearest_of_parts(queries, corpus, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def first_per_concept(ranked: DataFrame, limit: int) -> DataFrame:
    """From (query_id, concept_id, score, rank): each concept's first raw rank (gaps stay) and its
    place among concepts, the first ``limit`` of them."""
    first = ranked.groupBy("query_id", "concept_id").agg(F.min("rank").alias("raw_rank"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("raw_rank"))
    return first.withColumn("distinct_rank", place).where(F.col("distinct_rank") <= limit)


def char_grams(phrase: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside words, each word with a space on both sides."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        sizes = F.sequence(F.lit(low), F.least(F.lit(high), F.length(padded)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, n))))

    return F.flatten(F.transform(F.filter(F.split(phrase, " "), lambda w: w != ""), of_word))


def tfidf(phrases: DataFrame, key: str = "phrase", idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((phrase, gram, weight), (gram, idf)): rows of length one, with
    ``idf = ln((1 + n) / (1 + df)) + 1``; another corpus's idf can be given."""
    counts = phrases.select(key, F.explode(char_grams(F.col(key))).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))
    if idf is None:
        total = phrases.agg(F.count(F.lit(1)).alias("n"))
        df = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        idf = df.join(F.broadcast(total)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = counts.join(idf, "gram").select(key, "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norms, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("weight")), idf


def sparse_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query, phrase, score, rank): largest TF-IDF cosines; an equi-join on grams, so only phrases
    that share one are compared."""
    weights, idf = tfidf(corpus)
    asked, _ = tfidf(queries.withColumnRenamed("query", "phrase"), idf=idf)
    asked = asked.withColumnsRenamed({"phrase": "query", "weight": "asked"})
    scores = asked.join(weights, "gram").groupBy("query", "phrase").agg(F.round(F.sum(F.col("asked") * F.col("weight")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "phrase"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def rrf(weight: float, rank: Column) -> Column:
    return F.when(rank.isNull(), F.lit(0.0)).otherwise(weight / (RANK_CONSTANT + rank))


def fuse(dense: DataFrame, lexical: DataFrame, context: DataFrame, weights: tuple[float, float, float] = (DENSE, LEXICAL, CONTEXT)) -> DataFrame:
    """Full outer join of the lanes (query_id, concept_id, rank) and the fused order: score, then
    dense, lexical and context rank with missing ones last, then id."""
    lanes = zip(("dense", "lexical", "context"), (dense, lexical, context))
    a, b, c = (df.select("query_id", "concept_id", F.col("rank").alias(f"{name}_rank")) for name, df in lanes)
    rows = a.join(b, ["query_id", "concept_id"], "full").join(c, ["query_id", "concept_id"], "full")
    ranks = ("dense_rank", "lexical_rank", "context_rank")
    rows = rows.withColumn("combined", F.round(sum((rrf(w, F.col(r)) for w, r in zip(weights, ranks)), F.lit(0.0)), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("combined"), *[F.asc_nulls_last(r) for r in ranks], "concept_id")
    return rows.withColumn("fused_rank", F.row_number().over(order))


def recall_at(ranked: DataFrame, truth: DataFrame, ks: list[int], rank: str = "rank") -> DataFrame:
    """Share of queries with an acceptable concept within k: (k, recall), one row for each k."""
    hits = truth.join(ranked, ["query_id", "concept_id"], "left").groupBy("query_id").agg(F.min(rank).alias("best"))
    cut = hits.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), (F.coalesce("best", F.lit(1 << 30))).alias("best"))
    return cut.groupBy("k").agg(F.avg((F.col("best") <= F.col("k")).cast("double")).alias("recall"))


def inject(candidates: DataFrame, recognised: DataFrame, limit: int) -> DataFrame:
    """Recognised ids that retrieval missed go before the candidates (score 0, by id), then the
    first ``limit`` stay."""
    missing = recognised.join(candidates, ["query_id", "concept_id"], "left_anti").distinct()
    both = missing.select("query_id", "concept_id", F.lit(0.0).alias("score"), F.lit(0).alias("_own"), F.lit(None).cast("int").alias("rank"))
    both = both.unionByName(candidates.select("query_id", "concept_id", "score", F.lit(1).alias("_own"), "rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_own", "rank", "concept_id"))
    return both.withColumn("place", place).where(F.col("place") <= limit).drop("_own", "rank")

"""Queries over small tables of odd rows, against their SQL or plain Python."""

import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa

from ontoloom.functions import text as X
from ontoloom.operators import extraction, graph, lexical, retrieval
from ontoloom.plans import ALL

QUERIES = {k: f for p in ALL for k, f in p.queries.items()}
SQL = {k: sql for p in ALL for k, sql in p.sql.items()}


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL, sorted, over DataFrames by table name."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(folder))
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=str), sorted(found, key=str)


def test_cues_beside_letters_beyond_ascii(spark, tmp_path):
    texts = ["Ano novo, noé", "não posso", "éno x", "no", "possibleé", "not_x nots", "x-no", None, ""]
    turns = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "conv_id long, turn int, text string")
    got, want = both(spark, tmp_path, "assertion_cues", conversations=turns)
    assert got == want and ("1", "no") in {(str(r[0]), r[2]) for r in got}


def test_only_runs_that_may_be_phrases_are_made(spark):
    """Runs of words that are all in the lexicon, but in no phrase in that order, were rows before."""
    phrases = spark.createDataFrame([(f"c{k}", p, f"k{k}") for k, p in enumerate(["red eye", "long QT interval", "Kopf weh", "ÖDEM der Füße", "swollen fingers today"])], "concept_id string, phrase string, record_key string")
    exact = lexical.lexicon(phrases)
    texts = ["eye red long interval QT weh Kopf " * 50, "Red  eye, LONG-qt interval", "ödem DER füsse; red_eye; finger swollen today", None, ""]
    notes = spark.createDataFrame(list(enumerate(texts)), "note_id long, text string")
    runs = lexical.spans(notes, exact).where("note_id > 0").select("key", "start", "stop", "phrase").collect()
    assert sorted(runs) == [("long qt interval", 10, 26, "LONG-qt interval"), ("red eye", 0, 8, "Red  eye"), ("ödem der füsse", 0, 14, "ödem DER füsse")]
    assert lexical.spans(notes, exact).where("note_id = 0").isEmpty()
    found = lexical.mentions(notes, exact, lexical.morphological_lexicon(exact)).where("evidence = 'morphological' AND note_id = 2").collect()
    assert [(r.phrase, r.ids) for r in found] == [("finger swollen today", ["c4"])]


def test_merging_reads_texts_once(spark, tmp_path):
    """A broad mention, and narrow ones inside it, however far apart the spans start; the texts are no
    part of the plan any more."""
    for name, rows in (("benchmark", [(k, "blue sky over far hills and seas") for k in (0, 3, 5)]), ("documents", [(1, "x " * 200 + "Blue sky, over far hills. blue sky"), (2, None)])):
        spark.createDataFrame(rows, f"{'item' if name == 'benchmark' else 'doc'}_id long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    df = QUERIES["merged_mentions"](spark, str(tmp_path))
    assert not [f for f in df.inputFiles() if "documents" in f]
    got = sorted((r.start, r.phrase, r.ids, r.methods) for r in df.collect())
    assert got == [(400, "blue sky over far hills", "B:3", "native|second"), (426, "blue sky", "B:0", "native")]


def test_dense_passes_on_the_best_of_a_partition(spark):
    """Rows go on once a partition, not once a batch; equal scores by id, in tiles of any size."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (700, 4)).astype(float)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "row_id long, embedding array<float>").repartition(3)
    asked = rows.where("row_id % 10 = 0").select(rows.row_id.alias("query_id"), "embedding")
    parts = retrieval.nearest_of_parts(asked, rows, 5, tile=(16, 32))
    assert parts.count() <= 70 * 3 * 5
    want = []
    for q in range(0, 700, 10):
        scores = vectors @ vectors[q]
        want += [(q, int(k), float(scores[k]), n) for n, k in enumerate(np.lexsort((np.arange(700), -scores))[:5], 1)]
    got = retrieval.dense_topk(asked, rows, 5).select("query_id", "row_id", "score", "rank").collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[3])) == want


def test_dense_worker_is_bounded(spark, monkeypatch):
    """What a worker holds beside the k best of a pass is one tile, however many rows it reads and also
    where all are equal; several passes give what one gives."""
    vectors = np.random.default_rng(5).standard_normal((4000, 8))

    def peak(rows, copies, n=300, k=129):
        batches = [pa.RecordBatch.from_arrays([pa.array(range(c * 4000, c * 4000 + 4000)), pa.array(list(rows), pa.list_(pa.float32()))], ["row_id", "embedding"]) for c in range(copies)]
        shared = SimpleNamespace(value=(np.arange(n), rows[:n].astype(float)))
        tracemalloc.start()
        count = sum(b.num_rows for b in retrieval._nearest(shared, k, retrieval.TILE)(iter(batches)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == n * k
        return most

    for rows in (vectors, np.ones((4000, 8))):
        once, often = peak(rows, 1), peak(rows, 5)
        assert once < 25e6 and often < 1.1 * once
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors[:400])], "row_id long, embedding array<float>").repartition(3)
    asked = rows.where("row_id % 10 = 0").select(rows.row_id.alias("query_id"), "embedding")
    want = sorted(map(tuple, retrieval.dense_topk(asked, rows, 5).collect()))
    monkeypatch.setattr(retrieval, "PASS", 15)
    assert sorted(map(tuple, retrieval.dense_topk(asked, rows, 5).collect())) == want and len(want) == 200


def test_spans_of_a_large_batch_are_few_objects():
    texts = pa.array(["Ab cd ef. " * 80, None, "", "ü"] * 500)
    tracemalloc.start()
    words, sentences = X.token_spans.func(texts), X.sentence_spans.func(texts)
    placed = extraction.placed.func(texts.slice(0, 600), pa.array([["ef cd", "ab"], None] * 300))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and [len(x) for x in (words, sentences, placed)] == [2000, 2000, 600]
    assert words[4].as_py()[240 - 1] == {"id": 239, "start": 796, "stop": 798, "text": "ef"} and words[1].as_py() == [] and len(sentences[1996]) == 80
    assert placed[2].as_py() == [] and placed[596].as_py()[-1] == {"phrase": "Ab", "how": "literal", "segments": [{"start": 0, "stop": 2}]}


def test_only_open_walks_go_on(spark, tmp_path):
    """A walk that has ended is written once; ids on cycles end where they would meet themselves."""
    links = spark.createDataFrame([(k, k + 1 if k < 6 else None, None) for k in range(1, 7)] + [(k, None, None) for k in range(100, 200)] + [(300, 301, None), (301, None, 300), (302, 302, None)], "id long, replaced_by long, consider long")
    written, real = [], graph.stored
    graph.stored = lambda df, name: (written.append(df.count()), real(df, name))[1]
    try:
        got = {r.id: r.target for r in graph.resolve_obsolete(links).collect()}
    finally:
        graph.stored = real
    assert got == {k: 6 for k in range(1, 7)} | {k: k for k in range(100, 200)} | {300: 301, 301: 300, 302: 302} and sum(written) < 200

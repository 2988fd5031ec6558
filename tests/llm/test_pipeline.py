"""The stages of the pipeline: rows without doc_id, odd tables, and all of it against brute force."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from test_others import plain_contamination, plain_scores, toxic_table

import corpus_pipeline
from ontoloom.llm import shared
from ontoloom.llm.exact_dedup import without_copies
from ontoloom.llm.packing import best_two_fit, cuts
from ontoloom.llm.simhash import fingerprint
from ontoloom.llm.tokens import byte_bpe
from ontoloom.llm.toxicity import held_out


def test_rows_without_doc_id(spark, tmp_path):
    rng = random.Random(3)
    common = ["".join(rng.choice("abcdehil") for _ in range(4)) for _ in range(300)]
    text = lambda n: [rng.choice(common) for _ in range(n)]
    rows, labels = [], []
    for k in range(600):
        words = text(30)
        if k % 5 == 0:
            words[3], words[17] = "vile", "nastyone"
        rows.append((k, " ".join(words), "x"))
        labels.append((k, 0, int(k % 5 == 0)))
    passage, long = " ".join(text(40)), text(400)
    near = next(" ".join([*long[:i], "new", *long[i + 1 :]]) for i in range(400) if bin(fingerprint(" ".join(long)) ^ fingerprint(" ".join([*long[:i], "new", *long[i + 1 :]]))).count("1") <= 3)
    clean, copy, bad, again, long = " ".join(text(30)), " ".join(text(30)), " ".join(["vile", *text(28), "nastyone"]), " ".join(text(30)), " ".join(long)
    # The last: clean, with the id of a toxic document.
    odd = [(None, clean), (None, copy), (None, copy), (None, bad), (None, passage + " more"), (None, long), (None, near), (0, again)]
    spark.createDataFrame([*rows, *((d, t, "odd") for d, t in odd)], "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == ["doc_id", "text", "source"]
        left.append(sorted(r.text for r in docs.where("source = 'odd'").collect()))
    stay = sorted([clean, copy, again])
    assert left[0] == sorted([*stay, copy, passage + " more", long, near])
    assert left[1] == sorted([*stay, passage + " more", long, near])
    assert left[2] in (sorted([*stay, passage + " more", x]) for x in (long, near))
    assert left[3] in (sorted([*stay, x]) for x in (long, near))
    assert docs.where("source = 'x'").count() == 480


def test_longest_copy_without_doc_id_stays(spark):
    rows = [(None, "a b", 1), (None, "a  b ", 2), (None, "ab", 3), (None, None, 4), (7, "", 5)]
    out = without_copies(spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)).collect()
    assert sorted(r.n for r in out) == [2, 5]


def tables(spark, folder, docs, labels, items, more=()):
    names = {c: "text" for c in more}
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).selectExpr("*", *[f"{v} AS {c}" for c, v in names.items()])
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return df.columns


MORE = ("_lost", "_id", "_sha", "_key", "_row", "row", "text_key", "fp", "score", "digest")


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, columns of clashing names."""
    docs = [(None, None, None), (None, None, None), (1, "", "x"), (1, "", "x"), (2, "word " * 30_000, "x"), (3, "one two", None), (3, "three four five six", "x")]
    columns = tables(spark, tmp_path, docs, [(1, 0), (None, 1), (3, None)], [(1, None), (2, "one two"), (None, "zz")], MORE)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece) for r in out if r.piece == 0) == Counter([(1, 0), (2, 0), (3, 0)])


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shuffles_in_place_of_broadcasts(spark):
    docs = spark.createDataFrame([(k, f"t{k % 5}") for k in range(40)], "doc_id long, text string")
    lost = docs.where("doc_id < 2").select(shared.text_key())
    for limit in (0, 100):
        assert sorted(r.doc_id for r in shared.without_texts(docs, lost, "lost", broadcast=limit).collect()) == [k for k in range(40) if k % 5 > 1]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    docs, labels = toxic_table(240)
    words = sorted({w for _, t, _ in docs for w in t.split() if len(w) == 4 and w != "vile"})
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(text(n))) for k, n in enumerate((40, 25, 9, 14))]
    extra = []
    for k in range(8):
        long = text(150)
        extra += [(1000 + 10 * k + c, " ".join(long[:c] + ["nu"] * bool(c) + long[c + 1 :]), "near") for c in range(3)]
        extra += [(2000 + 10 * k + c, " ".join(long) + " " * c, "copy") for c in range(3)]
        extra.append((3000 + k, " ".join(text(10) + items[k % 4][1].split() + text(k)), "leak"))
    extra += [(4000, None, "x"), (4001, "", "x"), (4002, " ".join(text(3000)), "x")]
    return docs + extra, labels, items


def test_run_by_brute_force(spark, tmp_path, corpus):
    docs, labels, items = corpus
    tables(spark, tmp_path, docs, labels, items)
    held = {r[0] for r in spark.createDataFrame(labels, "doc_id long, toxic int").where(held_out()).select("doc_id").collect()}
    score = plain_scores(docs, [x for x in labels if x[0] not in held], 30)
    stay = [(d, t or "") for d, t, _ in docs if score[d] < 0.3]
    groups = defaultdict(list)
    for d, t in stay:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d, t))
    stay = sorted((d, t) for _, d, t in (min(g) for g in groups.values()))
    fp = {d: fingerprint(t) for d, t in stay}
    root = {d: d for d in fp}
    for _ in range(4):
        for a in fp:
            for b in fp:
                if bin(fp[a] ^ fp[b]).count("1") <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    stay = [(d, t) for d, t in stay if root[d] == d]
    leaks = plain_contamination(stay, items)
    stay = [(d, t) for d, t in stay if not leaks[d][4]]
    left = {d for d, _ in stay}
    assert not left & set(range(3000, 3008)) and {4000, 4001} & left and 4002 in left and len([d for d in left if d < 240]) > 170
    bpe = byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = [(d, k, start, n) for d, t in stay for k, (start, n) in enumerate(cuts(len(bpe.ids(t)) + 1, 1024))]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in out) == sorted(pieces)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        ends = 0
        for offset, n in sorted(own):
            assert offset == ends
            ends += n
        assert ends <= 1024
    assert len(bins) == sum(times for _, times in best_two_fit(Counter(n for *_, n in pieces), 1024))

import pandas as pd
from pyspark.sql import functions as F

from ontoloom.operators import diagnostics, extraction
from ontoloom.plans import annotate

OBO = """data-version: v1

[Term]
id: HP:0000001
name: Root

[Term]
id: HP:0000002
name: Short stature
synonym: "Small stature" EXACT []

[Term]
id: HP:0000003
name: Mesenteric mass

[Term]
id: HP:0000004
name: obsolete Short stature
is_obsolete: true
replaced_by: HP:0000002
"""


def test_file_to_rows(spark, tmp_path):
    (tmp_path / "o.obo").write_text(OBO)
    (tmp_path / "n.csv").write_text('patient_id,clinical_note\np1,"Short stature was noted. No mesenteric mass."\np2,Nothing here\np3,\n')
    results, invalid = annotate.annotate_file(spark, str(tmp_path / "n.csv"), str(tmp_path / "o.obo"))
    got = sorted((r.patient_id, r.phrase, r.category, r.hpo_id, r.mapping_status, r.review_status, r.assertion_status) for r in results.collect())
    assert got == sorted(
        [("p1", "Short stature", "Abnormal", "HP:0000002", "mapped", "accepted", "affirmed"), ("p1", "mesenteric mass", "Normal", None, "not_mapped_category", "review", "negated")], key=str
    )
    assert len(results.columns) == 26 and [r.error_code for r in invalid.collect()] == ["invalid_input"]


def test_vectors_have_length_one(spark):
    df = spark.createDataFrame([("Short stature",), ("x",), ("",)], "p string")
    rows = df.select("p", annotate.hashed_embedding(F.col("p")).alias("e")).collect()
    for r in rows:
        assert abs(sum(x * x for x in r.e) - (1.0 if r.p else 0.0)) < 1e-5


def test_placing():
    note = "Fever. Multiple cutaneous and plexiform neurofibromas were found; fever again"
    got = extraction.place(note, ["fever", "fever", "cutaneous neurofibromas", "plexiform neurofibroma5", "nowhere at all"])
    assert [(p["how"], p["phrase"]) for p in got] == [("literal", "Fever"), ("literal", "fever"), ("coordinated", "cutaneous neurofibromas"), ("fuzzy", "plexiform neurofibromas")]
    assert [note[s["start"] : s["stop"]] for s in got[2]["segments"]] == ["cutaneous", "neurofibromas"]
    assert extraction.coordinated("one three", "one. Two three") is None


def test_provider_requests_are_halved(spark):
    def connect():
        def client(rows):
            if len(rows) > 2 or any(r["item_id"] == 5 for r in rows):
                raise extraction.TooLarge
            return [{"item_id": r["item_id"], "verdict": "supported"} for r in rows]

        return client

    items = spark.range(9).withColumnRenamed("id", "item_id").coalesce(1)
    got = sorted(r.item_id for r in extraction.decide(items, connect, "item_id long, verdict string").collect())
    assert got == [0, 1, 2, 3, 4, 6, 7, 8]


def test_answers(spark):
    raw = ['```json\n{"decisions": [{"mention_id": "a", "verdict": "supported"}]}\n```', '{"a": {"verdict": "x"}, "b": {"mention_id": "c"}}', "no json", '{"verdict": "x"}', '{"decision": [{"mention_id": "a"}, {"mention_id": "b"}]}']
    df = spark.createDataFrame(pd.DataFrame({"raw": raw})).select(extraction.batch_decisions(F.col("raw")).alias("d"))
    assert [[x.mention_id for x in r.d] if r.d is not None else None for r in df.collect()] == [["a"], ["a", "c"], None, [None], ["a", "b"]]


def test_greedy_is_not_largest(spark):
    edges = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 0)], "case_id int, left int, right int")
    assert [(r.left, r.right) for r in diagnostics.greedy_assignment(edges).collect()] == [(0, 0)]

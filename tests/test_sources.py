import pytest
from pyspark.sql import functions as F

from ontoloom.sources import obo, sinks, tables
from ontoloom.streaming.checkpoint import RowState

OBO = """format-version: 1.2
data-version: hp/releases/2026-01-01

[Term]
id: HP:0000001
name: Root

[Term]
id: HP:0000002
name: Parent
def: "A \\"quoted\\" text." [x:y]
is_a: HP:0000001 ! Root

[Term]
id: HP:0000003
name: Child A
alt_id: HP:9000003
synonym: "Third" EXACT layperson [z]
synonym: "child a" RELATED []
is_a: HP:0000002 ! Parent

[Term]
id: HP:0000004
name: Child B
is_a: HP:0000002 ! Parent

[Term]
id: HP:0000005
name: obsolete Old
is_obsolete: true
replaced_by: HP:0000004

[Typedef]
id: part_of
name: part of
"""


@pytest.fixture()
def ontology(spark, tmp_path):
    (tmp_path / "o.obo").write_text(OBO)
    return str(tmp_path / "o.obo")


def test_terms(spark, ontology):
    terms = obo.terms(spark, ontology)
    rows = {r.id: r for r in terms.collect()}
    assert sorted(rows) == [f"HP:000000{k}" for k in range(1, 6)]
    assert rows["HP:0000002"].definition == 'A "quoted" text.' and rows["HP:0000002"].parents == ["HP:0000001"]
    assert [(s.text, s.scope) for s in rows["HP:0000003"].synonyms] == [("Third", "EXACT"), ("child a", "RELATED")]
    assert rows["HP:0000005"].obsolete and not rows["HP:0000001"].obsolete
    assert obo.data_version(spark, ontology) == "hp/releases/2026-01-01"
    for aliases in (obo.loader_aliases(terms), obo.snapshot_aliases(terms)):
        got = dict(map(tuple, aliases.collect()))
        assert got["HP:9000003"] == "HP:0000003" and got["HP:0000005"] == "HP:0000004"
        assert obo.alias_conflicts(aliases).isEmpty()
    own = obo.phrases(terms)
    assert sorted((r.phrase, r.source) for r in own.where("concept_id = 'HP:0000003'").collect()) == [("Child A", "label"), ("Third", "synonym")]
    addons = spark.createDataFrame([("HP:9000003", "Hard to breathe"), ("HP:9000003", "third")], "HP_ID string, info string")
    more = obo.with_addons(own, addons, obo.loader_aliases(terms))
    assert [(r.phrase, r.concept_id) for r in more.where("source = 'addon'").collect()] == [("Hard to breathe", "HP:0000003")]
    with pytest.raises(Exception, match="unknown id"):
        obo.with_addons(own, spark.createDataFrame([("HP:1", "x y")], "HP_ID string, info string"), obo.loader_aliases(terms)).collect()


def test_notes(spark, tmp_path):
    (tmp_path / "n.csv").write_text('﻿Case,clinical_note\n7,"Two\nlines, with a ""quote"""\n,second\n9,"  "\n')
    good, bad = tables.load_notes(spark, str(tmp_path / "n.csv"))
    assert sorted((r.patient_id, r.clinical_note) for r in good.collect()) == [("2", "second"), ("7", 'Two\nlines, with a "quote"')]
    assert [r.patient_id for r in bad.collect()] == ["9"]


def test_predictions(spark, tmp_path, ontology):
    aliases = obo.loader_aliases(obo.terms(spark, ontology))
    refs = spark.createDataFrame([("1", "HP:0000002, HP:9000003"), ("1", "HP:0000004")], "`Patient ID` string, hpo_term string")
    assert sorted(r.ids for r in tables.reference_groups(refs, aliases).collect()) == [["HP:0000002", "HP:0000003"], ["HP:0000004"]]
    assert tables.reference_sets(refs, aliases).first().ids == ["HP:0000002", "HP:0000003", "HP:0000004"]
    preds = spark.createDataFrame([("1", "HP:9000003", "", None), ("1", "HP:0000003", None, None), ("1", "HP:0000004", "review", None), ("2", "HP:0000001", "rejected", None)], "patient_id string, hpo_id string, review_status string, candidate_hpo_ids string")
    got = {r.case_id: r.ids for r in tables.prediction_sets(preds, aliases).collect()}
    assert got == {"1": ["HP:0000003"], "2": []}
    groups = tables.prediction_groups(preds.withColumn("candidate_hpo_ids", F.lit('["HP:0000002","HP:0000004"]')), aliases)
    assert [r.ids for r in groups.collect()] == [["HP:0000002", "HP:0000004"]]
    with pytest.raises(Exception, match="too many"):
        tables.prediction_groups(preds.withColumn("candidate_hpo_ids", F.lit("HP:0000001 HP:0000002 HP:0000003 HP:0000004")), aliases).collect()
    (tmp_path / "s.json").write_text('{"selection": {"selected_case_ids": ["3", "1"]}}')
    assert [r.case_id for r in tables.selected_cases(spark, str(tmp_path / "s.json")).orderBy("place").collect()] == ["3", "1"]


def test_results(spark, tmp_path):
    df = spark.createDataFrame([("p", ["a", "b"], [(1, 3), (5, 9)])], "patient_id string, source_methods array<string>, evidence_segments array<struct<start:int,end:int>>")
    flat = sinks.flat_results(df).first()
    assert flat.source_methods == "a|b" and flat.evidence_segments == "1:3|5:9" and len(flat) == 26
    sinks.export_results(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/csv"), header=True).columns == sinks.result_rows(df).columns
    vectors = spark.createDataFrame([(0, "HP:1", "a", "A", "", "s", [1.0, 0.0])], "row_id long, hp_id string, phrase string, term string, definition string, source string, embedding array<float>")
    sinks.write_vectors(vectors, str(tmp_path / "v"))
    assert sinks.load_vectors(spark, str(tmp_path / "v")).count() == 1
    vectors.write.mode("append").parquet(str(tmp_path / "v/vectors"))
    with pytest.raises(ValueError):
        sinks.load_vectors(spark, str(tmp_path / "v"))


def test_state(spark, tmp_path):
    folder = str(tmp_path / "state")
    notes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row_index long, note_sha256 string")
    state = RowState(spark, folder, {"model": "m"})
    assert state.pending(notes).count() == 3
    state.save(spark.createDataFrame([(0, "a", "complete"), (1, "b", "error")], "row_index long, note_sha256 string, status string"), 1)
    again = RowState(spark, folder, {"model": "m"})
    assert sorted(r.row_index for r in again.pending(notes).collect()) == [1, 2]
    again.save(spark.createDataFrame([(1, "b", "complete")], "row_index long, note_sha256 string, status string"), 2)
    assert [r.row_index for r in again.pending(notes).collect()] == [2]
    with pytest.raises(ValueError):
        RowState(spark, folder, {"model": "other"})
    with pytest.raises(Exception, match="changed"):
        again.pending(notes.withColumn("note_sha256", F.lit("z"))).collect()
    assert RowState(spark, folder, {"model": "other"}, resume=False).pending(notes).count() == 3

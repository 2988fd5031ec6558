import itertools
import random

import pytest
from pyspark.sql import functions as F

from ontoloom.operators import decisions, graph, scoring, stats


def ids(spark, rows):
    return spark.createDataFrame(rows, "case_id string, id string")


def test_sets(spark):
    (r,) = scoring.set_scores(ids(spark, [("a", "1"), ("a", "9"), ("a", "1")]), ids(spark, [("a", "1"), ("a", "2")])).collect()
    assert (r.tp, r.fp, r.fn, r.f1) == (1, 1, 1, 0.5)
    s = scoring.summarize(scoring.set_scores(ids(spark, []), ids(spark, []))).first()
    assert s.cases == 0 and s.micro_f1 == 0.0


def test_groups(spark):
    schema = "case_id string, n long, ids array<string>"
    p = spark.createDataFrame([("a", 0, ["1"]), ("a", 1, ["2"])], schema)
    r = spark.createDataFrame([("a", 0, ["1", "2"]), ("a", 1, ["2"])], schema)
    assert scoring.group_scores(p, r).first().tp == 2
    one = spark.createDataFrame([("a", 0, ["1", "2"])], schema)
    both = spark.createDataFrame([("a", 0, ["2"]), ("a", 1, ["1"])], schema)
    got = scoring.group_scores(one, both).first()
    assert (got.tp, got.fp, got.fn) == (1, 0, 1)


def test_matching_is_largest():
    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randint(0, 5), rng.randint(1, 5)
        edges = {a: [b for b in range(m) if rng.random() < 0.4] for a in range(n)}
        most = max((sum(b is not None for b in pick) for pick in itertools.product(*[[None, *edges[a]] for a in range(n)]) if len({b for b in pick if b is not None}) == sum(b is not None for b in pick)), default=0)
        got = scoring.augmenting_matches(edges)
        assert len(got) == most and len(set(got.values())) == most and all(b in edges[a] for b, a in got.items())
    long = {a: [a, a + 1] for a in range(3000, -1, -1)}
    assert len(scoring.augmenting_matches(long)) == 3001


TREE = [("2", "1"), ("3", "2"), ("4", "2")]


def test_tree(spark):
    edges = spark.createDataFrame(TREE, "child string, parent string")
    up = graph.closure(edges)
    assert sorted(map(tuple, up.collect())) == [("2", "1", 1), ("3", "1", 2), ("3", "2", 1), ("4", "1", 2), ("4", "2", 1)]
    pairs = spark.createDataFrame([("3", "2"), ("2", "3"), ("3", "4"), ("3", "3"), ("1", "9")], "prediction string, reference string")
    got = {(r.prediction, r.reference): (r.relation, r.distance) for r in graph.relations(pairs, edges, up).collect()}
    assert got == {("3", "2"): ("predicted_descendant", 1), ("2", "3"): ("predicted_ancestor", 1), ("3", "4"): ("sibling", 2), ("3", "3"): ("exact", 0), ("1", "9"): ("unrelated", None)}
    assert sorted(r.id for r in graph.descendants(edges, "2").collect()) == ["2", "3", "4"]
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert sorted(map(tuple, graph.closure(cycle).collect())) == [("a", "a", 2), ("a", "b", 1), ("b", "a", 1), ("b", "b", 2)]


def test_tiers(spark):
    edges = spark.createDataFrame(TREE, "child string, parent string")
    p = spark.createDataFrame([("x", 0, "3"), ("x", 1, "4")], "case_id string, n long, id string")
    r = spark.createDataFrame([("x", 0, "2"), ("x", 1, "4")], "case_id string, n long, id string")
    near = graph.closure(edges).select(F.col("child").alias("prediction"), F.col("ancestor").alias("reference"), F.lit("d").alias("relation"), F.col("depth").alias("distance"))
    for most, want in ((0, (1, 0, 1, 1)), (1, (1, 1, 0, 0))):
        got = scoring.layered_scores(p, r, near, most).first()
        assert (got.exact_tp, got.related_tp, got.fp, got.fn) == want


def test_obsolete(spark):
    rows = [("1", "2", None), ("2", None, "3"), ("3", None, None), ("x", "y", None), ("y", "x", None)]
    got = dict(map(tuple, graph.resolve_obsolete(spark.createDataFrame(rows, "id string, replaced_by string, consider string")).collect()))
    assert got == {"1": "3", "2": "3", "3": "3", "x": "y", "y": "x"}


def test_long_chains(spark):
    """Longer than any limit of steps there was (16 and 32)."""
    links = [(str(k), str(k + 1) if k < 20 else None, None) for k in range(21)]
    got = dict(map(tuple, graph.resolve_obsolete(spark.createDataFrame(links, "id string, replaced_by string, consider string")).collect()))
    assert got == {str(k): "20" for k in range(21)}
    edges = spark.createDataFrame([(k, k + 1) for k in range(35)], "child long, parent long")
    assert sorted(map(tuple, graph.closure(edges).collect())) == [(a, b, b - a) for a in range(36) for b in range(a + 1, 36)]


def test_holm(spark):
    got = stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")).orderBy("name").collect()
    assert [r.adjusted for r in got] == pytest.approx([0.03, 0.06, 0.06])


def test_allocation():
    assert stats.allocate({"a": 10, "b": 10, "c": 1}, 3) == {"a": 1, "b": 1, "c": 1}
    got = stats.allocate({"a": 70, "b": 20, "c": 10}, 10)
    assert got == {"a": 7, "b": 2, "c": 1}
    with pytest.raises(ValueError):
        stats.allocate({"a": 1}, 2)


def test_bootstrap_and_interval(spark):
    cases = spark.createDataFrame([(str(k), k % 3, 1, 1) for k in range(60)], "case_id string, tp int, fp int, fn int")
    draws = stats.bootstrap(cases, 200, seed=1)
    got = stats.interval(draws, "f1").first()
    assert got.low < 0.5 < got.high and got.low <= got.median <= got.high
    flip = stats.sign_flip(spark.createDataFrame([(str(k), 0.5) for k in range(12)], "case_id string, d double"), 100, seed=2).first()
    assert flip.observed == 0.5 and flip.p_greater < 0.05 and flip.p_two_sided < 0.05


def test_decisions(spark):
    df = spark.createDataFrame([("exact", 3, ["a"], None, "affirmed"), ("exact", 2, ["a"], ["a", "b"], "affirmed"), ("morphological", 2, ["a"], ["a"], "affirmed"), ("exact", 3, ["a"], ["b"], "affirmed"), ("exact", 1, ["a"], None, "affirmed"), ("exact", 3, ["a"], None, "negated")], "e string, n int, ids array<string>, o array<string>, s string")
    got = [r.d.reason for r in df.select(decisions.cascade(*map(F.col, ("e", "n", "ids", "o", "s"))).alias("d")).collect()]
    assert got == ["exact_specific_asserted", "exact_cross_method_agreement", "morphological_cross_method_agreement", "cross_method_disagreement", "requires_verification", "assertion_negated"]
    native = spark.createDataFrame([(["a"], "affirmed"), (["a"], "negated"), (["a", "b"], "affirmed")], "ids array<string>, s string").select(decisions.native_decision(F.col("ids"), F.col("s")).alias("d")).collect()
    assert [(r.d.selected_id, r.d.review_status) for r in native] == [("a", "accepted"), ("a", "review"), (None, "review")]


def plain_consistency(rows):
    """Union, intersection over all runs, mean and least Jaccard of two runs, by sets."""
    runs, seen = sorted({r for r, _, _ in rows}), {}
    for r, c, i in rows:
        seen.setdefault((c, i), set()).add(r)
    j = []
    for a, b in itertools.combinations(runs, 2):
        for case in {c for _, c, _ in rows}:
            of = [{i for r, c, i in rows if r == run and c == case} for run in (a, b)]
            if of[0] | of[1]:
                j.append(len(of[0] & of[1]) / len(of[0] | of[1]))
    return len(seen), sum(len(v) == len(runs) for v in seen.values()), sum(j) / len(j), min(j)


def test_runs_repeated_and_many(spark, monkeypatch):
    """Rows that come twice count once; more runs than a word has bits, and more pairs than a pass takes."""
    schema = "run string, case_id long, id string"
    twice = [("a", 1, "x"), ("a", 1, "x"), ("b", 1, "x"), ("b", 1, "y"), ("b", 2, "y")]
    rng = random.Random(3)
    many = [(f"r{k}", case, str(i)) for k in range(5) for case in range(3) for i in range(4) if i == 0 or rng.random() < 0.7]
    for rows, at_once, bits in ((twice, 64, 62), (many, 4, 2)):
        monkeypatch.setattr(scoring, "BITS", bits)
        got = scoring.run_consistency(spark.createDataFrame(rows, schema), at_once).first()
        assert tuple(got[:2]) == plain_consistency(rows)[:2] and (got.mean_jaccard, got.min_jaccard) == pytest.approx(plain_consistency(rows)[2:])
    empty = scoring.run_consistency(spark.createDataFrame([], schema)).first()
    assert (empty.union_size, empty.stable_size, empty.recurrence, empty.mean_jaccard) == (0, 0, 1.0, None)


def test_tasks_of_runs_are_bounded(spark, monkeypatch):
    """Tasks are as many as rows ask for, whatever the session's partitions."""
    monkeypatch.setattr(scoring, "ROWS_OF_A_TASK", 100)
    rows = spark.range(2_000).selectExpr("id % 3 AS run", "id DIV 6 AS case_id", "id % 2 AS id")
    plan = scoring.run_consistency(rows)._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in plan and ", 21" in plan


def test_groups_like_edges(spark):
    """Sizes of matchings by keys are those by edges; cases go over batches; repeated numbers are one finding."""
    rng = random.Random(5)
    sides = [[(case, n, [rng.choice("abcdefg") for _ in range(rng.randint(0, 3))]) for case in range(300) for n in range(rng.randint(0, 7))] for _ in range(2)]
    sides[0].append((7, 0, ["a", None]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        p, r = (spark.createDataFrame(x, "case_id long, n long, ids array<string>") for x in sides)
        got = {x.case_id: (x.tp, x.fp, x.fn) for x in scoring.group_scores(p, r).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for case in {c for c, _, _ in sides[1]}:
        left, right = ([(n, {*g} - {None}) for c, n, g in side if c == case] for side in sides)
        edges = {a: sorted({b for m, g in left if m == a for b, h in right if g & h}) for a, _ in left}
        tp = len(scoring.augmenting_matches(edges))
        want[case] = (tp, len(left) - tp, len(right) - tp)
    assert got == want


def test_many_that_share_an_id(spark):
    """Findings that share one id are not paired each with each: 4,000 on both sides were 16 million edges."""
    p, r = (spark.range(4_000).selectExpr("1 AS case_id", "id AS n", f"array('x', '{s}' || id) AS ids") for s in "pr")
    plan = scoring.group_scores(p, r)
    assert "Join" not in plan._jdf.queryExecution().toString() and plan.first().tp == 4_000


def test_groups_of_sides_dealt_already(spark):
    """Sides that come by case_id, of sizes that are coalesced differently, still meet."""
    rows = spark.range(30_000).selectExpr("id DIV 3 AS case_id", "id AS n", "array('x', uuid()) AS ids").repartition("case_id")
    got = scoring.group_scores(rows.dropDuplicates(["case_id", "ids"]), rows.where("n % 3 = 0").select("case_id", "n", F.slice("ids", 1, 1).alias("ids")))
    assert tuple(got.agg(F.count("*"), F.sum("tp"), F.sum("fp"), F.sum("fn")).first()) == (10_000, 10_000, 20_000, 0)


def test_closure_ends_at_a_depth(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(5)], "child long, parent long")
    for most in (1, 2):
        assert sorted(map(tuple, graph.closure(edges, most).collect())) == [(a, b, b - a) for a in range(6) for b in range(a + 1, min(6, a + most + 1))]

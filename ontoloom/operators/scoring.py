"""Scoring predictions against references: sets, alternative groups and hierarchy tiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.metrics import precision_recall_f1, ratio
from ..sources.shared import stored


#: Rows that a task of ``run_consistency`` gets, as its memory grows with them.
ROWS_OF_A_TASK = 1_000_000
#: Runs that one whole number tells.
BITS = 62


def set_scores(predicted: DataFrame, reference: DataFrame, case: str = "case_id") -> DataFrame:
    """From (case, id) rows: tp, fp, fn, precision, recall, f1 of every case on either side. Ids
    are counted once; one aggregation over the union, no join."""
    rows = predicted.select(case, "id", F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(reference.select(case, "id", F.lit(0).alias("p"), F.lit(1).alias("r")))
    ids = rows.groupBy(case, "id").agg(F.max("p").alias("p"), F.max("r").alias("r"))
    tp, fp, fn = (F.sum(F.when((F.col("p") == p) & (F.col("r") == r), 1).otherwise(0)) for p, r in ((1, 1), (1, 0), (0, 1)))
    cases = ids.groupBy(case).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return cases.withColumns(precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def summarize(cases: DataFrame) -> DataFrame:
    """One row of micro and macro metrics; an empty input gives zeros."""
    sums = cases.agg(
        F.count(F.lit(1)).alias("cases"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
    )
    return sums.withColumns({f"micro_{k}": v for k, v in precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")).items()})


def mark_unscorable(cases: DataFrame, errors: DataFrame, case: str = "case_id") -> DataFrame:
    """Cases with calculation errors have no metrics and count nothing."""
    codes = errors.groupBy(case).agg(F.array_sort(F.collect_set("code")).alias("error_codes"))
    rows = cases.join(codes, case, "left")
    bad = F.col("error_codes").isNotNull()
    out = {c: F.when(bad, F.lit(0)).otherwise(F.col(c)).alias(c) for c in ("tp", "fp", "fn")}
    out |= {c: F.when(~bad, F.col(c)) for c in ("precision", "recall", "f1")}
    return rows.withColumns({**out, "scoring_status": F.when(bad, "unscorable").otherwise("scored")})


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """How many distinct (case_id, id) both, only the first and only the second have."""
    rows = first.select("case_id", "id", F.lit(1).alias("side")).unionByName(second.select("case_id", "id", F.lit(2).alias("side")))
    sides = rows.groupBy("case_id", "id").agg(F.sum_distinct("side").alias("sides"))
    return sides.agg(*[F.count_if(F.col("sides") == k).alias(n) for k, n in ((3, "shared"), (1, "first_only"), (2, "second_only"))])


# --- one-to-one matching --------------------------------------------------------------------


def augmenting_matches(edges: dict[int, list[int]]) -> dict[int, int]:
    """A maximum matching right -> left: left nodes in order, each along the first augmenting path
    in its edges' order; without recursion, so long paths are no matter."""
    owner: dict[int, int] = {}
    for root in sorted(edges):
        visited: set[int] = set()
        path: list[tuple[int, int]] = []
        stack = [(root, iter(edges[root]))]
        while stack:
            left, rest = stack[-1]
            right = next((r for r in rest if r not in visited), None)
            if right is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            visited.add(right)
            path.append((left, right))
            if right not in owner:
                for a, b in path:
                    owner[b] = a
                break
            stack.append((owner[right], iter(edges.get(owner[right], []))))
    return owner


_EDGE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("tier", "left", "right")])


@pandas_udf(T.ArrayType(_EDGE))
def _matched(edges: pd.Series) -> pd.Series:
    def one(rows) -> list[dict]:
        out, lefts, rights = [], set(), set()
        by_tier: dict[int, dict[int, list[int]]] = {}
        for e in rows:
            by_tier.setdefault(e["tier"], {}).setdefault(e["left"], []).append(e["right"])
        for tier in sorted(by_tier):
            free = {a: [b for b in own if b not in rights] for a, own in by_tier[tier].items() if a not in lefts}
            for b, a in augmenting_matches(free).items():
                out.append({"tier": tier, "left": a, "right": b})
                lefts.add(a)
                rights.add(b)
        return out

    return edges.map(one)


_PAIR = T.StructType([T.StructField(n, T.IntegerType()) for n in ("left", "right")])


@pandas_udf(T.ArrayType(_PAIR))
def _matched_in_order(edges: pd.Series) -> pd.Series:
    def one(rows) -> list[dict]:
        by_left: dict[int, list[int]] = {}
        for e in rows:
            by_left.setdefault(e["left"], []).append(e["right"])
        return [{"left": a, "right": b} for b, a in augmenting_matches(by_left).items()]

    return edges.map(one)


def match_edges(edges: DataFrame) -> DataFrame:
    """From (case_id, left, right and, if there are tiers, tier): the matched rows.

    Within a case, edges of tier 0 are matched first, what they match is taken out, then tier 1
    and so on. A case's edges are one array (its findings are a short list), so that many cases
    go to Python in one Arrow batch.
    """
    if "tier" not in edges.columns:
        edges = edges.withColumn("tier", F.lit(0))
    one = F.struct(*[F.col(c).cast("int").alias(c) for c in ("tier", "left", "right")])
    by_case = edges.groupBy("case_id").agg(F.sort_array(F.collect_list(one)).alias("edges"))
    return by_case.select("case_id", F.explode(_matched("edges")).alias("m")).select("case_id", "m.left", "m.right", "m.tier")


def largest_matching(first: list[int], keys: list[int], starts: list[int], rights: list[int]) -> list[int]:
    """The right node of each left node in a largest matching, -1 for none. Left node k has
    ``keys[first[k]:first[k + 1]]``, and key k leads to ``rights[starts[k]:starts[k + 1]]``; edges are
    not written out, so what this takes grows with the keys, however many nodes share one."""
    at, right_of, owner, dead = starts[:-1], [-1] * (len(first) - 1), {}, bytearray(len(starts))
    for root in range(len(first) - 1):
        parent, queue, seen, found = {root: -1}, [root], [], False
        for left in queue:
            for key in keys[first[left] : first[left + 1]]:
                if dead[key]:
                    continue
                low, high = at[key], starts[key + 1]
                while low < high and rights[low] in owner:  # what is taken stays taken
                    low += 1
                at[key] = low
                if low < high:
                    right, found = rights[low], True
                    break
                dead[key] = 1
                seen.append(key)
                for right in rights[starts[key] : high]:
                    other = owner[right]
                    if other not in parent:
                        parent[other] = left
                        queue.append(other)
            if found:
                break
        if found:
            while left >= 0:
                owner[right] = left
                right, right_of[left], left = right_of[left], right, parent[left]
            for key in seen:
                dead[key] = 0
        # Else no later path gets through the keys seen, so they stay dead.
    return right_of


def together(rows: DataFrame) -> DataFrame:
    """Rows with each case's (case_id) in one partition, one after another. They are dealt by a hash of it:
    Spark leaves a repartition by case_id out over a union of sides that are so dealt already, then
    coalesces the sides each its own way."""
    return rows.repartition(F.xxhash64("case_id")).sortWithinPartitions("case_id")


def _whole_cases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Arrow batches cut anew so that no case is in two, with the place where each case begins."""

    def begins(batch: pa.RecordBatch) -> np.ndarray:
        codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(begins(batch)[-1])
        if held and (cut or held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py()):
            whole = pa.concat_batches([*held, batch.slice(0, cut)])
            yield whole, begins(whole)
            held = []
        elif cut:
            whole = batch.slice(0, cut)
            yield whole, begins(whole)
        held.append(batch.slice(cut))
    if held:
        whole = pa.concat_batches(held)
        yield whole, begins(whole)


def _group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, begins in _whole_cases(batches):
        case = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, batch.num_rows)))
        numbers = batch.column(1).dictionary_encode()
        node = case * (len(numbers.dictionary) + 1) + numbers.indices.fill_null(len(numbers.dictionary)).to_numpy(zero_copy_only=False)
        _, some, node = np.unique(node, return_index=True, return_inverse=True)
        sides = [batch.column(2), batch.column(3)]
        have = [c.is_valid().to_numpy(zero_copy_only=False) for c in sides]
        rows = np.concatenate([np.repeat(np.arange(batch.num_rows), c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) for c in sides])
        flat = [c.flatten() for c in sides]
        ids = pa.concat_arrays(flat).dictionary_encode()
        code, known = ids.indices.fill_null(0).to_numpy(zero_copy_only=False), ids.indices.is_valid().to_numpy(zero_copy_only=False)
        _, key = np.unique(case[rows] * (len(ids.dictionary) + 1) + code, return_inverse=True)
        is_left = np.arange(len(rows)) < len(flat[0])
        n_keys = int(key.max()) + 1 if len(key) else 0
        right = known & ~is_left
        left = known & is_left & np.isin(key, key[right])
        right, left = np.flatnonzero(right), np.flatnonzero(left)
        right, left = right[np.argsort(key[right], kind="stable")], left[np.argsort(node[rows[left]], kind="stable")]
        first = np.searchsorted(node[rows[left]], np.arange(len(some) + 1))
        starts = np.searchsorted(key[right], np.arange(n_keys + 1))
        matched = np.array(largest_matching(first.tolist(), key[left].tolist(), starts.tolist(), node[rows[right]].tolist()), np.int64)
        tp = np.bincount(case[some[matched >= 0]], minlength=len(begins))
        n_p, n_r = (np.add.reduceat(h.astype(np.int64), begins) for h in have)
        scored = np.flatnonzero(n_r)  # cases with references count
        counts = [pa.array(x[scored], pa.int64()) for x in (tp, n_p - tp, n_r - tp)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begins[scored])), *counts], ["case_id", "tp", "fp", "fn"])


def placed_group_scores(rows: DataFrame) -> DataFrame:
    """``group_scores`` of rows that are ``together``: (case_id, n, predicted, reference), the arrays of
    ids of a finding on either side, null for none. Nothing is joined or shuffled any more."""
    rows = rows.select("case_id", "n", F.when(F.col("case_id").isNotNull(), F.col("predicted")).alias("predicted"), "reference")
    counts = T.StructType([rows.schema["case_id"], *[T.StructField(n, T.LongType()) for n in ("tp", "fp", "fn")]])
    return rows.mapInArrow(_group_counts, counts).withColumns(precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def group_scores(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """From (case_id, n, ids array) on both sides, one row for each finding: findings match when
    their sets of alternatives meet, one to one, as many as can be. Cases with references count."""
    side = lambda df, k: df.select("case_id", "n", F.coalesce("ids", F.array()).alias("ids"), F.lit(k).alias("side"))
    rows = together(side(predicted, 0).unionByName(side(reference, 1)))
    return placed_group_scores(rows.select("case_id", "n", *[F.when(F.col("side") == k, F.col("ids")).alias(c) for k, c in ((0, "predicted"), (1, "reference"))]))


def layered_scores(predicted: DataFrame, reference: DataFrame, relations: DataFrame, most: int = 2) -> DataFrame:
    """``group_scores`` in tiers: exact first, then relations (prediction, reference, relation,
    distance) of distance 1 up to ``most``. From (case_id, n, id). ``relations`` counts the relations of
    the matches; cases with references count."""
    exact = predicted.alias("p").join(reference.alias("r"), ["case_id", "id"]).select("case_id", F.col("p.n").alias("left"), F.col("r.n").alias("right"), F.lit(0).alias("tier"))
    # Only relations to what is a reference at all: else each prediction meets all its ancestors' rows.
    near = relations.where((F.col("distance") <= most) & (F.col("distance") > 0))
    near = near.join(reference.select(F.col("id").alias("reference")).distinct(), "reference", "left_semi")
    p = predicted.select("case_id", F.col("n").alias("left"), F.col("id").alias("prediction"))
    r = reference.select("case_id", F.col("n").alias("right"), F.col("id").alias("reference"))
    wide = p.join(near, "prediction").join(r, ["case_id", "reference"]).select("case_id", "left", "right", F.col("distance").cast("int").alias("tier"), "relation")
    # Of several relations of one pair the nearest, then the first by prediction and reference order.
    edges = exact.withColumn("relation", F.lit("exact")).unionByName(wide).groupBy("case_id", "left", "right").agg(F.min(F.struct("tier", "relation")).alias("e"))
    edges = edges.select("case_id", "left", "right", "e.tier", "e.relation")
    matched = match_edges(edges).join(edges, ["case_id", "left", "right", "tier"])
    counts = matched.groupBy("case_id", "relation").agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy("case_id")
    tp = counts.agg(
        F.sum(F.when(F.col("relation") == "exact", F.col("n")).otherwise(0)).alias("exact_tp"), F.sum(F.when(F.col("relation") != "exact", F.col("n")).otherwise(0)).alias("related_tp"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "n")))).alias("relations"),
    )
    n_p = predicted.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_p"))
    n_r = reference.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_r"))
    rows = n_r.join(n_p, "case_id", "left").join(tp, "case_id", "left").na.fill(0, ["n_p", "exact_tp", "related_tp"])
    tp_all: Column = F.col("exact_tp") + F.col("related_tp")
    none = F.create_map().cast("map<string,int>")
    rows = rows.select("case_id", "exact_tp", "related_tp", (F.col("n_p") - tp_all).alias("fp"), (F.col("n_r") - tp_all).alias("fn"), F.coalesce("relations", none).alias("relations"))
    return rows.withColumns(precision_recall_f1(tp_all, F.col("fp"), F.col("fn")))


def summarize_layered(cases: DataFrame) -> DataFrame:
    """One row: sums, micro and macro metrics of ``layered_scores``, and all its relation counts."""
    counts = cases.select(F.explode("relations").alias("relation", "n")).groupBy("relation").agg(F.sum("n").alias("n"))
    counts = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "n")))).alias("relation_counts"))
    sums = cases.agg(
        F.count(F.lit(1)).alias("cases"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("exact_tp", "related_tp", "fp", "fn")],
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
    )
    tp = F.col("exact_tp") + F.col("related_tp")
    return sums.crossJoin(counts).withColumns({f"micro_{k}": v for k, v in precision_recall_f1(tp, F.col("fp"), F.col("fn")).items()})


def hierarchy_match(predicted: DataFrame, reference: DataFrame, relations: DataFrame, most: int = 1) -> DataFrame:
    """From (case_id, id) on both sides: (case_id, prediction, reference, relation, distance) matched one
    to one: equal ids first, then ancestors and descendants up to ``most`` steps away, the nearest and
    first of each prediction first. Siblings don't match."""
    p, r = predicted.select("case_id", "id").distinct(), reference.select("case_id", "id").distinct()
    same = p.join(r, ["case_id", "id"])
    exact = same.select("case_id", F.col("id").alias("prediction"), F.col("id").alias("reference"), F.lit("exact").alias("relation"), F.lit(0).alias("distance"))
    near = relations.where(F.col("relation").isin("predicted_ancestor", "predicted_descendant") & (F.col("distance") <= most)).select("prediction", "reference", "relation", F.col("distance").cast("int"))
    left, right = (x.join(same, ["case_id", "id"], "left_anti").withColumnRenamed("id", n) for x, n in ((p, "prediction"), (r, "reference")))
    edges = left.join(near, "prediction").join(right, ["case_id", "reference"])
    # Numbers in the order of the ids, as a matching takes predictions and tries references in order.
    one = F.struct("prediction", "distance", "reference", "relation")
    cases = edges.groupBy("case_id").agg(F.array_sort(F.collect_set(one)).alias("e"))
    names = lambda k: F.array_sort(F.array_distinct(F.transform("e", lambda x: x[k])))
    cases = cases.select("case_id", "e", names("prediction").alias("ps"), names("reference").alias("rs"))
    numbered = F.transform("e", lambda x: F.struct(F.array_position(F.col("ps"), x["prediction"]).cast("int").alias("left"), x["distance"].alias("distance"), F.array_position(F.col("rs"), x["reference"]).cast("int").alias("right")))
    found = cases.select("case_id", "e", "ps", "rs", F.explode(_matched_in_order(numbered)).alias("m"))
    found = found.select("case_id", F.element_at("ps", F.col("m.left")).alias("prediction"), F.element_at("rs", F.col("m.right")).alias("reference"))
    return exact.unionByName(found.join(near, ["prediction", "reference"]).select(*exact.columns))


def run_consistency(runs: DataFrame, at_once: int = 64) -> DataFrame:
    """From (run, case_id, id): one row with the union, the intersection over all runs, recurrence
    and the mean and least Jaccard of two runs over the cases either has. Repeated rows count once.

    Runs are few: which of them have an id is bits of whole numbers. Rows are shuffled once, by case, to
    tasks of about ROWS_OF_A_TASK, and all sums are of plain numbers; ``at_once`` pairs of runs are
    compared in one pass over the cases."""
    sizes = {r.run: r.n for r in runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(x for x in sizes if x is not None)
    words = [names[k : k + BITS] for k in range(0, max(1, len(names)), BITS)]
    bits = [sum((F.when(F.col("run") == x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(word)), F.lit(0)).cast("long") for word in words]
    seen = runs.repartition(1 + sum(sizes.values()) // ROWS_OF_A_TASK, "case_id").groupBy("case_id", "id").agg(*[F.bit_or(b).alias(f"w{k}") for k, b in enumerate(bits)])
    has = lambda k: F.col(f"w{k // BITS}").bitwiseAND(F.lit(1 << k % BITS)) != 0
    pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
    if len(pairs) > at_once:
        seen = stored(seen, "runs")
    all_runs = F.lit(True)
    for k, word in enumerate(words):
        all_runs = all_runs & (F.col(f"w{k}") == F.lit((1 << len(word)) - 1))
    parts = []
    for low in range(0, max(1, len(pairs)), at_once):
        some = list(enumerate(pairs[low : low + at_once]))
        counts = [c for k, (a, b) in some for c in (F.count_if(has(a) & has(b)).alias(f"i{k}"), F.count_if(has(a) | has(b)).alias(f"u{k}"))]
        cases = seen.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(all_runs).alias("stable"), *counts)
        j = [F.when(F.col(f"u{k}") > 0, F.col(f"i{k}") / F.col(f"u{k}")) for k, _ in some] or [F.lit(None).cast("double")]
        number = lambda x: F.coalesce(x, F.lit(0.0))
        parts.append(cases.agg(
            F.sum("n").alias("n"), F.sum("stable").alias("stable"), F.sum(sum(map(number, j), F.lit(0.0))).alias("j"),
            F.sum(sum((x.isNotNull().cast("long") for x in j), F.lit(0))).alias("of"), F.min(F.array_min(F.array(*j))).alias("least"), F.lit(low).alias("part"),
        ))
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    first = lambda c: F.coalesce(F.sum(F.when(F.col("part") == 0, F.col(c))), F.lit(0))
    total = sums.agg(first("n").alias("union_size"), first("stable").alias("stable_size"), F.sum("j").alias("j"), F.sum("of").alias("of"), F.min("least").alias("min_jaccard"))
    recurrence = F.when(F.col("union_size") == 0, 1.0).otherwise(F.col("stable_size") / F.col("union_size"))
    mean = F.when(F.col("of") > 0, F.round(F.col("j") / F.col("of"), 9))
    return total.select("union_size", "stable_size", recurrence.alias("recurrence"), mean.alias("mean_jaccard"), "min_jaccard")


def fbeta(tp: Column, fp: Column, fn: Column, beta: float = 0.5) -> Column:
    return precision_recall_f1(tp, fp, fn, beta)["fbeta"]


__all__ = ["augmenting_matches", "fbeta", "group_scores", "hierarchy_match", "layered_scores", "mark_unscorable", "match_edges", "overlap", "ratio", "run_consistency", "set_scores", "summarize", "summarize_layered"]

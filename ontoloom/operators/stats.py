"""Statistics: corrections, resampling, strata, calibration and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import laplace, precision_recall_f1, ratio, wilson_lower


def holm(tests: DataFrame, family: list[str] | None = None) -> DataFrame:
    """(name, p) with adjusted p: the running maximum of min(1, p * (m - rank)) in order of p. A
    family of tests is a short list; give ``family`` columns for many families."""
    keys = family or []
    w = Window.partitionBy(*keys).orderBy("p", "name")
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    raw = F.least(F.lit(1.0), F.col("p") * (m - F.row_number().over(w) + 1))
    return tests.withColumn("raw", raw).withColumn("adjusted", F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("raw")


def rank_bins(rows: DataFrame, value: str, key: str, bins: int, within: list[str]) -> DataFrame:
    """Bin ``least(bins - 1, rank0 * bins / n)`` in order of (value, key) among ``within``."""
    w = Window.partitionBy(*within).orderBy(value, key)
    n = F.count(F.lit(1)).over(Window.partitionBy(*within))
    bin_ = F.least(F.lit(bins - 1), F.floor((F.row_number().over(w) - 1) * bins / n)).cast("int")
    return rows.withColumn("bin", bin_)


def unit_hash(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the parts, the same everywhere: 52 bits of SHA-256."""
    text = F.concat_ws("/", *[F.lit(str(p)) if isinstance(p, (str, int)) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def bootstrap(cases: DataFrame, iterations: int, seed: int, case: str = "case_id") -> DataFrame:
    """(iteration, tp, fp, fn, precision, recall, f1): cases drawn with replacement, ratios from
    the sums. Every case is weighted by how often it is drawn: the number is Poisson(1) by the
    case's own hash, so nothing is gathered, and the sums are made before the shuffle."""
    u = unit_hash(seed, F.col("iteration"), F.col(case))
    # Cumulative Poisson(1) probabilities up to 7.
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.996340153172656, 0.9994058151824183, 0.9999167588507119]
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    rows = cases.select(case, "tp", "fp", "fn", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration")).withColumn("w", weight)
    sums = rows.groupBy("iteration").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "fp", "fn")])
    return sums.withColumns(precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def interval(draws: DataFrame, column: str) -> DataFrame:
    """(low, median, high): the 2.5, 50 and 97.5 % points by linear interpolation."""
    return draws.agg(*[F.percentile(column, F.lit(q)).alias(n) for q, n in ((0.025, "low"), (0.5, "median"), (0.975, "high"))])


def sign_flip(differences: DataFrame, iterations: int, seed: int, case: str = "case_id") -> DataFrame:
    """Paired permutation test of the mean of ``d``: signs flip by each case's hash. One row:
    observed, p_greater, p_less, p_two_sided, each (count + 1) / (iterations + 1)."""
    observed = differences.agg(F.avg("d").alias("observed"), F.count(F.lit(1)).alias("n"))
    sign = F.when(unit_hash(seed, F.col("iteration"), F.col(case)) < 0.5, -1.0).otherwise(1.0)
    rows = differences.select(case, "d", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration"))
    means = rows.groupBy("iteration").agg(F.avg(F.col("d") * sign).alias("m")).crossJoin(F.broadcast(observed))
    slack = 1e-12
    count = lambda c: (F.count_if(c) + 1) / (iterations + 1)
    return means.agg(
        F.first("observed").alias("observed"),
        count(F.col("m") >= F.col("observed") - slack).alias("p_greater"),
        count(F.col("m") <= F.col("observed") + slack).alias("p_less"),
        count(F.abs("m") >= F.abs("observed") - slack).alias("p_two_sided"),
    )


def strata(rows: DataFrame) -> DataFrame:
    """From (stratum, correct boolean): observations, matches, probability and its lower bound."""
    sums = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("observations"), F.count_if("correct").alias("matches"))
    n, k = F.col("observations"), F.col("matches")
    return sums.withColumns({"probability": laplace(k, n), "lower_95": wilson_lower(k.cast("double"), n.cast("double"))})


def policy_prefixes(rows: DataFrame, total: Column | int) -> DataFrame:
    """Strata taken in order of probability, lower bound and name: precision and recall of each
    prefix. Strata are few, so one ordered window over them is in order."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("probability"), F.desc("lower_95"), "stratum").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"k": F.count(F.lit(1)).over(w), "accepted": F.sum("observations").over(w), "correct": F.sum("matches").over(w)})
    total = total if isinstance(total, Column) else F.lit(total)
    return rows.withColumns({"precision": ratio(F.col("correct"), F.col("accepted")), "recall": ratio(F.col("correct"), total)})


def best_prefix(prefixes: DataFrame, floor: float) -> DataFrame:
    """The prefix of at least ``floor`` precision with the most recall, then precision, then the
    fewest strata."""
    best = F.struct("recall", "precision", -F.col("k"))
    return prefixes.where(F.col("precision") >= floor).agg(F.max_by(F.struct("k", "stratum", "precision", "recall"), best).alias("b")).where("b IS NOT NULL").select("b.*")


def threshold_grid(rows: DataFrame, steps: int = 100) -> DataFrame:
    """From (score in 0..1, correct): tp, fp, fn and metrics at each threshold i / steps. Rows are
    counted by their step first; the grid is summed over at most steps + 1 counts."""
    step = F.least(F.lit(steps), F.greatest(F.lit(0), F.floor(F.col("score") * steps + 1e-9))).cast("int")
    counts = rows.groupBy(step.alias("s")).agg(F.count_if("correct").alias("tp"), F.count_if(~F.col("correct")).alias("fp"))
    total = counts.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("total"))
    grid = counts.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i"))
    kept = grid.join(F.broadcast(counts), F.col("s") >= F.col("i"), "left").groupBy("i").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp")])
    out = kept.crossJoin(F.broadcast(total)).select((F.col("i") / steps).alias("threshold"), "tp", "fp", (F.col("total") - F.col("tp")).alias("fn"))
    return out.withColumns(precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def best_threshold(grid: DataFrame) -> DataFrame:
    """The most f1, then recall, then the lowest threshold."""
    row = F.struct("threshold", "precision", "recall", "f1")
    return grid.agg(F.max_by(row, F.struct(F.round("f1", 12), F.round("recall", 12), -F.col("threshold"))).alias("b")).select("b.*")


def allocate(sizes: dict, k: int) -> dict:
    """``k`` draws over strata of the given sizes: one each where they suffice, then one at a time
    to the stratum that is furthest below its share, the larger capacity, the smaller name."""
    n = sum(sizes.values())
    if k > n:
        raise ValueError("more draws than members")
    names = sorted(sizes)
    out = dict.fromkeys(names, 0)
    if k >= len(names):
        out = dict.fromkeys(names, 1)
    left = k - sum(out.values())
    for _ in range(left):
        best = min((s for s in names if out[s] < sizes[s]), key=lambda s: (-(k * sizes[s] / n - out[s]), -(sizes[s] - out[s]), s))
        out[best] += 1
    return out


def stratified_sample(rows: DataFrame, stratum: str, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows, allocated over the strata, in hash order within each. Strata sizes (a short
    list) go to the driver."""
    sizes = {r[stratum]: r["count"] for r in rows.groupBy(stratum).count().collect()}
    table = rows.sparkSession.createDataFrame(sorted(allocate(sizes, k).items()), f"{stratum} {dict(rows.dtypes)[stratum]}, take int")
    w = Window.partitionBy(stratum).orderBy(unit_hash(seed, F.col(key)), key)
    return rows.withColumn("_place", F.row_number().over(w)).join(F.broadcast(table), stratum).where("_place <= take").drop("_place", "take")

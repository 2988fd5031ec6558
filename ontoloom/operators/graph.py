"""Ontology graph operators: closure, relations and replaced identifiers."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(child, ancestor, depth): every ancestor with its least distance; a node is its own only on
    a cycle. The frontier is joined with the edges level by level, and only pairs not seen before
    go on, so cycles end. ``most`` (1 or more) ends it at that depth."""
    edges = stored(edges.select("child", "parent").distinct(), "edges")
    seen = edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    frontier = seen
    for depth in count(2) if most is None else range(2, most + 1):
        step = frontier.select(F.col("child").alias("c"), F.col("ancestor").alias("child")).join(edges, "child")
        step = step.select(F.col("c").alias("child"), F.col("parent").alias("ancestor")).distinct()
        frontier = stored(step.join(seen, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    return seen


def descendants(edges: DataFrame, root, active: DataFrame | None = None) -> DataFrame:
    """The root and all below it (id); ``active`` (id) restricts both what is returned and what
    is walked through."""
    if active is not None:
        edges = edges.join(active.select(F.col("id").alias("child")), "child", "left_semi").join(active.select(F.col("id").alias("parent")), "parent", "left_semi")
    below = closure(edges).where(F.col("ancestor") == F.lit(root)).select(F.col("child").alias("id"))
    own = edges.sparkSession.range(1).select(F.lit(root).alias("id"))
    own = own if active is None else own.join(active.select("id"), "id", "left_semi")
    return own.unionByName(below).distinct()


def relations(pairs: DataFrame, edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """For (prediction, reference): exact, predicted_descendant, predicted_ancestor (with their
    distance), sibling (a shared parent, distance 2) or unrelated, the first that holds."""
    up = ancestors.select(F.col("child").alias("prediction"), F.col("ancestor").alias("reference"), F.col("depth").alias("up"))
    down = ancestors.select(F.col("ancestor").alias("prediction"), F.col("child").alias("reference"), F.col("depth").alias("down"))
    keys = ["prediction", "reference"]
    # By the parents of the pairs at hand: the siblings of all nodes grow with the square of a family.
    parents = edges.select("child", "parent").distinct()
    above = lambda c, p: parents.select(F.col("child").alias(c), F.col("parent").alias(p))
    shared = pairs.select(*keys).distinct().join(above("prediction", "p"), "prediction").join(above("reference", "q"), "reference")
    shared = shared.where("p = q").select(*keys, F.lit(True).alias("sibling")).distinct()
    rows = pairs.join(up, keys, "left").join(down, keys, "left").join(shared, keys, "left")
    case = lambda exact, a, b, c, d: F.when(F.col("prediction") == F.col("reference"), exact).when(F.col("up").isNotNull(), a).when(F.col("down").isNotNull(), b).when(F.col("sibling"), c).otherwise(d)
    names = case(*map(F.lit, ("exact", "predicted_descendant", "predicted_ancestor", "sibling", "unrelated")))
    distance = case(F.lit(0), F.col("up"), F.col("down"), F.lit(2), F.lit(None).cast("int"))
    return rows.select(*keys, names.alias("relation"), distance.alias("distance"))


def resolve_obsolete(links: DataFrame) -> DataFrame:
    """(id, target): follow (id, replaced_by, consider) to its end; a step back to an id already
    passed ends the walk there. Only ids still on their way go on to the next step."""
    step = stored(links.select(F.col("id").alias("from_id"), F.coalesce("replaced_by", "consider").alias("next")).where("next IS NOT NULL"), "steps")
    walk, ended = links.select("id", F.col("id").alias("target"), F.array("id").alias("passed")), None
    while True:
        moved = walk.join(step, F.col("target") == F.col("from_id"), "left")
        on = F.col("next").isNotNull() & ~F.array_contains("passed", F.col("next"))
        moved = stored(moved.select("id", F.when(on, F.col("next")).otherwise(F.col("target")).alias("target"), F.when(on, F.array_append("passed", F.col("next"))).alias("passed"), on.alias("open")), "walk")
        end = moved.where("NOT open").select("id", "target")
        ended = end if ended is None else ended.unionByName(end)
        walk = moved.where("open").drop("open")
        if walk.isEmpty():
            return ended


def normalise_ids(rows: DataFrame, aliases: DataFrame, column: str = "id") -> DataFrame:
    """``column`` replaced by its target where ``aliases`` (source_id, target_id) has one."""
    joined = rows.join(aliases.withColumnsRenamed({"source_id": "_source", "target_id": "_target"}), F.col(column) == F.col("_source"), "left")
    return joined.withColumn(column, F.coalesce("_target", column)).drop("_source", "_target")

"""Bounded traversals and connected groups over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.plans.session import Rounds, cut


def closure(edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """(src, dst, depth): records reached along edges (src, dst) in at most max_depth steps, each once with the fewest steps.

    Breadth first: each level joins only the newest pairs. A record reached from itself is not among its results.
    """
    step = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    frontier = step.where("src <> dst").withColumn("depth", F.lit(1))
    known = cut(frontier)
    frontier = known
    for depth in range(2, max_depth + 1):
        wider = frontier.select("src", F.col("dst").alias("_at")).join(step.select(F.col("src").alias("_at"), "dst"), "_at").select("src", "dst").where("src <> dst").distinct()
        frontier = cut(wider.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        known = cut(known.unionByName(frontier))
    return known


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected group of edges (a, b), by hooking to the least neighbour and jumping.

    Each round takes the least label among neighbours and then the label of that label, so long chains shrink fast.
    Records without an edge are not in the result. Ids are compared as they sort.
    """
    rounds = Rounds(edges.sparkSession)
    both = rounds.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct())
    labels = rounds.write(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_b")).select("id", F.least("id", "_b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_near"))
        hooked = labels.join(near, "id").select("id", F.least("label", "_near").alias("label"), F.col("label").alias("_old"))
        jumped = hooked.join(labels.select(F.col("id").alias("label"), F.col("label").alias("_far")), "label", "left")
        new = rounds.write(jumped.select("id", F.least("label", F.coalesce("_far", "label")).alias("label"), "_old"))
        labels = new.drop("_old")
        if new.where("label <> _old").isEmpty():
            out = cut(labels.withColumnRenamed("label", "component"))
            rounds.close()
            return out

"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspark.llm.common import discard, materialise, small_keys


def _roots(parent: DataFrame) -> DataFrame:
    """``parent`` (node, up: a smaller node) with ``up`` moved to the root of its tree, by pointer jumping."""
    while True:
        above = small_keys(parent.select(F.col("node").alias("up"), F.col("up").alias("_top")))
        if not parent.join(above, "up", "left_semi").limit(1).count():
            return parent
        jumped = materialise(parent.join(above, "up", "left").select("node", F.coalesce("_top", "up").alias("up")), "jumped")
        discard(parent)
        parent = jumped


def _through(edges: DataFrame, name: str, parent: DataFrame) -> DataFrame:
    """``edges`` with the end ``name`` replaced by its root; nodes without one stay."""
    to = small_keys(parent.select(F.col("node").alias(name), F.col("up").alias("_root")))
    return edges.join(to, name, "left").withColumn(name, F.coalesce("_root", name)).drop("_root")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); a component is named by its smallest node.

    Every node points to its smallest neighbour, if that is smaller than itself; pointers are followed to their roots, the
    trees are contracted, and what edges are left join roots alone.  A star is done in one round; in general each round
    leaves at most half of the nodes that still have an edge.  Rounds are written to the shared folder, and the driver sees
    no more than whether there is a row.  A null end makes no edge, an edge to itself no node; repeated edges count once.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "edges")
    place = None
    while now.limit(1).count():
        up = _roots(materialise(now.groupBy("a").agg(F.min("b").alias("up")).withColumnRenamed("a", "node"), "up"))
        over = _through(_through(now, "a", up), "b", up)
        left = materialise(over.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        discard(now)
        now = left
        if place is None:
            place = up
        else:
            place = materialise(_through(place, "up", up).unionByName(up), "place")
    if place is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    place = place.select("node", F.col("up").alias("component"))
    return place.unionByName(place.select(F.col("component").alias("node"), "component").distinct())

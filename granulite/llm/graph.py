"""Connected components of an edge table by contraction rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulite.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every id with an edge to another; component is the smallest id reachable.

    Each round lets every id point at its smallest neighbour, follows the pointers by doubling until they rest, and
    contracts the edges to the roots; ids that still have edges at least halve. Minima are combined before the shuffle, so
    a hub costs no more than its share. All tables between rounds are stored; nothing comes to the driver but counts.
    Rows with a null end and loops are dropped; no edges give no rows.
    """
    e = stored(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    levels: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")))
        while True:
            to = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
            jumped = stored(up.join(to, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            up = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        levels.append(up)
        left = up.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        right = up.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        e = stored(e.join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct())
    if not levels:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    out = levels[0].select("id", F.col("root").alias("component"))
    for up in levels[1:]:
        to = up.select(F.col("id").alias("component"), F.col("root").alias("next"))
        out = out.join(to, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    return stored(out) if len(levels) > 1 else out

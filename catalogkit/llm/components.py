"""Connected components of an edge table by contraction, in about log(n) rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.llm.common import free, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` (the smallest node it is connected with) for every node of an
    edge. Each round points every node at its smallest neighbour, follows the pointers
    once more and keeps the edges between different targets."""
    rest = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"))
    roots: DataFrame | None = None
    steps: list[DataFrame] = []
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to"))
        step = stored(step.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        before, rest = rest, stored(rest.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        free(before)
        if roots is None:
            roots = step.select("node", F.col("to").alias("root"))
        else:
            roots = roots.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        steps.append(step)
    if roots is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = stored(roots)
    free(rest, *steps)
    return found

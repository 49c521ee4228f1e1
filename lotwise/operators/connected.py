"""Connected components of a graph given as pairs, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.session import discard, written


def _pairs(frame: DataFrame) -> DataFrame:
    return frame.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from every id of ``edges`` (id, root): id, label.

    Alternates large-star and small-star steps, whose number grows with the logarithm
    of the longest chain; each round is written. Ids without an edge to another id
    are not listed. Edges of a round go when those of the next are written.
    """
    start = edges.select(F.greatest("id", "root").alias("u"), F.least("id", "root").alias("v"))
    current = written(_pairs(start), "edges")
    state = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = _pairs(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        previous = current
        current = written(_pairs(small.unionByName(least.select("u", F.col("m").alias("v")))), "edges")
        discard(previous, large)
        before, state = state, _state(current)
        if state == before:
            labels = current.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "id")
            roots = current.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
            found = labels.unionByName(roots.join(labels.select("id"), "id", "left_anti"))
            found._made_of = [current]
            return found

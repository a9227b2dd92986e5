"""Connected components of an edge table by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import delete_path, new_path


#: Edges that a file of a round should hold at least, if there are that many.
FILE_EDGES = 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (large: greater ones; else: smaller ones and itself) to its least neighbour or itself. Minima are pre-aggregated, so a node of any degree costs a task one row per input partition."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (u, v); component is the least node it reaches. Loops and repeated edges add nothing; no edges give no rows. The number of rounds grows with the logarithm of the diameter."""
    spark = edges.sparkSession
    edges = edges.filter(F.col("u") != F.col("v"))
    before, last, size = None, None, edges.count()
    while True:
        path = new_path(spark, "star")
        # the size of the round before tells about that of this one
        _star(_star(edges, True), False).coalesce(1 + size // FILE_EDGES).write.parquet(path)
        edges = spark.read.parquet(path)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last:
            delete_path(spark, last)
        last = path
        if tuple(now) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before, size = tuple(now), now[0]



"""Connected components of edges between nodes of any sortable type, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop_saved, saved


#: Edges that a task writes, about: steps over few edges have few tasks, however many partitions shuffles have.
PART = 250_000


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the least node that it is connected with) for each node of edges (columns a, b).

    Each step points every node's greater (or lesser) neighbours to its least one. Neighbourhoods are never gathered: their least members are taken by an
    aggregation and joined back, which adaptive execution splits for a hub. The number of steps grows with the logarithm of the graph squared.
    Null ends are left out; an empty table gives an empty one.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark, parts = None, now.count() // PART + 1
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = saved(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(parts), "edges")
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v")
        new = saved(small.distinct().coalesce(parts), "edges")
        drop_saved(now)
        drop_saved(large)
        now = new
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

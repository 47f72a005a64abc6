"""Connected components of the cross-reference graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators.tables import discard, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) with the smallest node of each component, by randomised contraction.

    Each round maps every node to the node of least priority among itself and
    its neighbours (priorities are drawn anew by a hash) and links the images, so
    a constant share of the nodes disappears on any graph, long paths and hubs
    included.  Only minima are aggregated by node, which Spark combines before
    the exchange, so a hub costs one row for each task.  Every round is written.
    """
    spark = edges.sparkSession
    nodes = edges.select(F.explode(F.array(src, dst)).alias("node")).where("node is not null").distinct()
    links = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    maps, paths, turn = [], [], 0
    while True:
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        step, path = written(near.select(F.col("a").alias("node"), F.least(rank("a"), F.col("near"))["node"].alias("to")), "contraction")
        paths.append(path)
        if step.isEmpty():
            break
        maps.append(step)
        image = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"new_{c}"))  # noqa: B023, E731
        moved = links.join(image("a"), "a").join(image("b"), "b").where("new_a <> new_b")
        links, path = written(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "links")
        paths.append(path)
    root = nodes.withColumn("to", F.col("node"))
    for step in maps:
        # the image of an image, settled each time so that plans stay short
        moved = root.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
        root, path = written(moved.select("node", F.coalesce("next", "to").alias("to")), "roots")
        paths.append(path)
    least = root.groupBy("to").agg(F.min("node").alias("component"))
    found, _ = written(root.join(least, "to").select("node", "component"), "components")
    discard(spark, *paths)
    return found

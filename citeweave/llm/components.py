"""Connected components by randomised contraction.

Each round maps every node to the node of least priority among itself and its
neighbours, with fresh pseudo-random priorities, and replaces links by links
between images.  A constant share of the nodes disappears per round on any
graph, long paths and huge stars included, so the rounds are logarithmic in
the nodes.  Every round's tables are written to shared storage, and so is each
step of the way back from the last round's roots; only the numbers of rows
written reach the driver.

Cases: no links give no rows; links from a node to itself and repeated links
are allowed; null ends are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import counted, discard


def components(links: DataFrame, a: str = "a", b: str = "b", seed: int = 0) -> tuple[DataFrame, list[str]]:
    """(node, component) for every linked node, with the paths of the tables it reads.

    ``component`` is the smallest node reachable.  The paths may be discarded
    once the result has been used.  Tables are written by as many tasks as their
    rows need, so small graphs cost little whatever the number of partitions.
    """
    spark = links.sparkSession
    edges, edge_path, n_edges = counted(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "links")
    maps: list[tuple[DataFrame, int]] = []
    kept = [edge_path]
    turn = seed
    while n_edges:
        turn += 1
        ranked = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(ranked("b")).alias("near")).select(F.col("a").alias("node"), F.least(ranked("a"), F.col("near"))["node"].alias("to"))
        step, path, n_nodes = counted(best, "contraction", 2 * n_edges)
        kept.append(path)
        maps.append((step, n_nodes))
        from_a, from_b = step.select(F.col("node").alias("a"), F.col("to").alias("new_a")), step.select(F.col("node").alias("b"), F.col("to").alias("new_b"))
        moved = edges.join(from_a, "a").join(from_b, "b").where("new_a <> new_b")
        fewer = moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct()
        edges, path, n_edges = counted(fewer, "links", n_edges)
        kept.append(path)
    if not maps:
        discard(spark, *kept)
        return spark.createDataFrame([], "node long, component long"), []
    # the last maps are the smallest; each composition is written, so no plan holds more than one of them
    root, n_nodes = maps[-1]
    for step, n_nodes in reversed(maps[:-1]):
        later = root.select(F.col("node").alias("to"), F.col("to").alias("later"))
        root, path, _ = counted(step.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("to")), "roots", n_nodes)
        kept.append(path)
    least, path, _ = counted(root.groupBy("to").agg(F.min("node").alias("component")), "least", n_nodes)
    kept.append(path)
    found, found_path, _ = counted(root.join(least, "to").select("node", "component"), "components", n_nodes)
    discard(spark, *kept)
    return found, [found_path]

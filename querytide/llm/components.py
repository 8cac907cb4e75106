"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.session import write_and_read


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Tie the neighbours of every node to the smallest of them.

    With `both_ways` all neighbours count and the larger ones are tied (large star), else only
    the smaller neighbours and the node itself (small star). The minima are written, so that
    Spark can split the join of a node with very many neighbours.
    """
    if both_ways:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = write_and_read(near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), "star")
        tied = near.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = write_and_read(edges.groupBy("a").agg(F.min("b").alias("least")), "star")
        tied = (
            edges.join(least, "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(least.select("a", F.col("least").alias("b")))
        )
    return write_and_read(tied.filter("a <> b").distinct(), "stars")


def components(links: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node it is linked with, for all nodes of links (a, b).

    Every round writes its edges to the shared folder, so a lost executor costs a task. Links may
    repeat, come in either direction and join a node to itself. No links give no rows.
    """
    ends = F.array_sort(F.array("a", "b"))
    oriented = links.filter("a <> b").select(ends[1].alias("a"), ends[0].alias("b")).distinct()
    edges, state = write_and_read(oriented, "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            break
        state, edges = now, _star(_star(edges, True), False)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from orbweave.plans.workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, workspace: Workspace, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges(a, b)`` are undirected; self loops and nulls are ignored. Returns
    ``(node, component)`` without the nodes that are their own component's smallest.
    Every round is written to the shared folder, and the rounds end when one changes
    nothing; its count and checksum come with the write and need no pass of their own.
    Hubs are handled by map-side minima and plain joins, so AQE can split a hub's edges
    over tasks. Raises if the rounds do not converge.
    """

    def saved(table: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        marks = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        out = workspace.save(table.observe(seen, *marks), name)
        return out, (seen.get["n"], seen.get["sum"])

    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, mark = saved(down.where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        if not mark[0]:
            break
        star, after = saved(_small_star(_large_star(now)), "stars")
        workspace.drop(now)
        now, mark, before = star, after, mark
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))

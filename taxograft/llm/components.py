"""Connected components by alternating large-star and small-star rounds over edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.session import Scratch


def _stamp(edges: DataFrame) -> tuple[int, int]:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    row = edges.agg(F.count(F.lit(1)), F.sum(h)).first()
    return row[0], int(row[1] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    hung = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("_a"))
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge list (a, b); the component is its smallest node.

    Self-loops and edges with a null end are dropped, repeated edges count once, an empty list gives an
    empty result; nodes without edges have to be added by the caller. No neighbourhood is ever collected: each star
    needs a minimum per node (combined map-side) and a join back, so a hub with a third of all edges is only a skewed
    join side. Every round is cut through a written table, and the old one deleted.
    """
    scratch = Scratch(edges.sparkSession, "components")
    clean = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = scratch.keep(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _stamp(now)
    for _ in range(max_rounds):
        after = scratch.keep(_small_star(_large_star(now)))
        stamp = _stamp(after)
        scratch.drop(now)
        now = after
        if stamp == seen:
            break
        seen = stamp
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )

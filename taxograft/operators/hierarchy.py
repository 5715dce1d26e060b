"""Parent-child links to full hierarchies by pointer doubling.

Each node starts with a pointer to its parent and its own key as path segment. In every round each unresolved
node takes over the pointer of the node it points at and puts that node's segment in front of its own, so the
reach doubles: a tree of depth d is done after about log2(d) joins. A round that resolves nobody
proves that the rest is caught in cycles (or hangs below one): a node of depth in (2^k, 2^(k+1)] has an ancestor
of every smaller depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.session import Scratch

CYCLE = "cycle"


def hierarchy(nodes: DataFrame, links: DataFrame, sep: str = "/") -> DataFrame:
    """(node, root, depth, path) of every distinct node.

    ``nodes`` has ``node`` (string), ``links`` has ``node`` and ``parent`` (strings). A node without a link, or
    whose parent is not among the nodes, is a root of depth 0. Nodes on or below a cycle (self-links included) get
    root and path ``cycle`` and depth -1. Null nodes and null parents are ignored, repeated rows count once; of
    several parents of one node the smallest counts. An empty input gives an empty result.

    Unresolved rows join the pointer table on the ancestor they point at. The pointer table has one row per node, so a
    hot ancestor only skews the left side, which AQE splits; resolved nodes take no further part.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "hierarchy")
    nodes = nodes.where(F.col("node").isNotNull()).select("node").distinct()
    one = links.where(F.col("node").isNotNull() & F.col("parent").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))
    known = nodes.select(F.col("node").alias("_p"))
    # a parent outside the table makes its child a root
    up = one.join(known, one["parent"] == known["_p"], "left_semi")
    start = nodes.join(up, "node", "left").select(
        "node", F.col("parent").alias("ptr"), F.lit(0).cast("bigint").alias("hops"), F.col("node").alias("seg")
    )
    # hops counts the links already behind the pointer's segment; a root has no pointer
    state = scratch.keep(start.withColumn("hops", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("bigint")).withColumn("root", F.when(F.col("ptr").isNull(), F.col("node"))))
    ended = lambda df: df.where(F.col("root").isNotNull()).select("node", "root", F.col("hops").alias("depth"), F.col("seg").alias("path"))
    open_of = lambda df: df.where(F.col("root").isNull()).select("node", "ptr", "hops", "seg")
    finished, todo = [ended(state)], open_of(state)
    left = todo.count()
    while left:
        # one join: a pointer at a resolved node ends here, at another one it jumps on
        r = resolved_all(finished).select(F.col("node").alias("ptr"), F.col("root").alias("_root"), F.lit(None).cast("string").alias("_ptr"), F.col("depth").alias("_hops"), F.col("path").alias("_seg"))
        t = todo.select(F.col("node").alias("ptr"), F.lit(None).cast("string").alias("_root"), F.col("ptr").alias("_ptr"), F.col("hops").alias("_hops"), F.col("seg").alias("_seg"))
        moved = todo.join(r.unionByName(t), "ptr").select(
            "node", F.col("_ptr").alias("ptr"), (F.col("hops") + F.col("_hops")).alias("hops"), F.concat("_seg", F.lit(sep), "seg").alias("seg"), F.col("_root").alias("root")
        )
        state = scratch.keep(moved)
        after = open_of(state).count()
        if after == left:
            break
        finished.append(ended(state))
        todo, left = open_of(state), after
    out = resolved_all(finished).select("node", "root", "depth", "path")
    if left:
        caught = todo.select("node", F.lit(CYCLE).alias("root"), F.lit(-1).cast("bigint").alias("depth"), F.lit(CYCLE).alias("path"))
        out = out.unionByName(caught)
    return out


def resolved_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def descendants(tree: DataFrame, sep: str = "/") -> DataFrame:
    """(node, descendant, distance) from the result of :func:`hierarchy`: every ancestor on each path.

    One row per pair, made by exploding each path in its own task, without a join. Cyclic nodes give no row.
    """
    parts = F.split("path", sep)
    up = tree.where(F.col("depth") > 0).select(
        F.col("node").alias("descendant"), "depth", F.posexplode(F.slice(parts, F.lit(1), F.col("depth").cast("int"))).alias("at", "node")
    )
    return up.select("node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def taxo_links(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        nodes.select(F.col("id").cast("string").alias("node")),
        edges.select(F.col("src").cast("string").alias("node"), F.col("tgt").cast("string").alias("parent")),
    )


def big7_links(big7: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``site_id_cat_id`` and links to the last id but one of id_breadcrumb at the same site."""
    rows = big7.where(F.col("site_id").isNotNull() & F.col("cat_id").isNotNull())
    key: Column = F.concat_ws("_", "site_id", "cat_id")
    ids = F.expr("filter(transform(split(id_breadcrumb, '>'), x -> trim(x)), x -> x <> '')")
    parent = F.when(F.size(ids) >= 2, F.element_at(ids, -2))
    links = rows.select(key.alias("node"), F.concat(F.col("site_id").cast("string"), F.lit("_"), parent).alias("parent"))
    return rows.select(key.alias("node")), links


def full_hierarchies(nodes: DataFrame, edges: DataFrame, big7: DataFrame) -> DataFrame:
    """(hierarchy, node_key, root_key, depth, node_path) of both hierarchies of this project."""

    def shape(name: str, pair: tuple[DataFrame, DataFrame]) -> DataFrame:
        return hierarchy(*pair).select(
            F.lit(name).alias("hierarchy"), F.col("node").alias("node_key"), F.col("root").alias("root_key"), "depth", F.col("path").alias("node_path")
        )

    return shape("taxo_nodes", taxo_links(nodes, edges)).unionByName(shape("big7_data", big7_links(big7)))

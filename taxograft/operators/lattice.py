"""Lattice operators over a closure: reduction, common ancestors and descendants, similarity, transitive reduction.

A set is a frame (query_id, node); every operator answers all query_ids at once. ``closed`` is the result of
:func:`taxograft.operators.closure.closure`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.operators.closure import leaves, roots, with_self


def reduce_subset(sets: DataFrame, closed: DataFrame, most_general: bool = False) -> DataFrame:
    """The members of each set without a descendant in it (most specific), or without an ancestor in it (most general)."""
    s = sets.select("query_id", "node").distinct()
    low = s.join(closed.select("node", "anc"), "node")
    high = s.select("query_id", F.col("node").alias("anc"))
    inside = low.join(high, ["query_id", "anc"], "left_semi")
    drop = inside.select("query_id", F.col("node" if most_general else "anc").alias("node"))
    return s.join(drop, ["query_id", "node"], "left_anti")


def _common(sets: DataFrame, closed: DataFrame, nodes: DataFrame, up: bool) -> DataFrame:
    s = sets.select("query_id", "node").distinct()
    size = s.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    star = with_self(closed, nodes).select(
        (F.col("node") if up else F.col("anc")).alias("node"), (F.col("anc") if up else F.col("node")).alias("other")
    )
    n = s.join(star, "node").groupBy("query_id", "other").agg(F.count(F.lit(1)).alias("n"))
    return n.join(size, "query_id").where(F.col("n") == F.col("size")).select("query_id", F.col("other").alias("node"))


def lca(sets: DataFrame, closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node): the minimal common ancestors-or-self of each set; several or none are possible. A node that has no row in
    ``nodes`` has no ancestors-or-self but what the closure says. Sets without members give no row: see :func:`lca_of_nothing`."""
    return reduce_subset(_common(sets, closed, nodes, True), closed)


def gcd(sets: DataFrame, closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node): the maximal common descendants-or-self of each set."""
    return reduce_subset(_common(sets, closed, nodes, False), closed, most_general=True)


def lca_of_nothing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The answer for an empty set: all leaves."""
    return leaves(nodes, edges)


def gcd_of_nothing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The answer for an empty set: all roots."""
    return roots(nodes, edges)


def wu_palmer(pairs: DataFrame, closed: DataFrame, nodes: DataFrame, depths: DataFrame) -> DataFrame:
    """(query_id, a, b, similarity): 2 depth(lca) / (depth(a) + depth(b)); of several common ancestors the smallest id counts;
    0 without one; null where both depths are 0. ``pairs`` has query_id, a, b; ``depths`` has id and level."""
    p = pairs.select("query_id", "a", "b").distinct()
    members = p.select("query_id", F.explode(F.array("a", "b")).alias("node"))
    top = lca(members, closed, nodes).groupBy("query_id").agg(F.min("node").alias("lca"))
    d = lambda key, name: depths.select(F.col("id").alias(key), F.col("level").alias(name))
    joined = p.join(top, "query_id", "left").join(d("a", "da"), "a", "left").join(d("b", "db"), "b", "left").join(d("lca", "dl"), "lca", "left")
    sim = F.when(F.col("lca").isNull(), F.lit(0.0)).otherwise(F.try_divide(2.0 * F.col("dl"), F.col("da") + F.col("db")))
    return joined.select("query_id", "a", "b", sim.alias("similarity"))


def transitive_reduction(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """The edges (with all their columns) that no longer path implies."""
    first = edges.select(F.col("src").alias("_s"), F.col("tgt").alias("_w")).distinct()
    implied = first.join(closed.select(F.col("node").alias("_w"), F.col("anc").alias("_t")), "_w").select("_s", "_t").distinct()
    return edges.join(implied, (F.col("src") == F.col("_s")) & (F.col("tgt") == F.col("_t")), "left_anti")


def subsumes(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """``pairs`` (upper, lower) with a boolean ``subsumes``: equal, or upper is an ancestor of lower. Unknown nodes: only if equal."""
    c = closed.select(F.col("node").alias("lower"), F.col("anc").alias("upper"), F.lit(True).alias("_hit"))
    return pairs.join(c, ["upper", "lower"], "left").withColumn("subsumes", F.coalesce("_hit", F.col("upper") == F.col("lower"))).drop("_hit")


def breadcrumbs(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, crumb array<bigint>) of a tree: the ids from the root down to the node. A node's ancestors are its depth in number."""
    up = closed.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("d"), "anc"))).alias("up"))
    all_nodes = nodes.select(F.col("id").alias("node")).join(up, "node", "left")
    return all_nodes.select("node", F.concat(F.coalesce(F.transform("up", lambda x: x["anc"]), F.array().cast("array<bigint>")), F.array("node")).alias("crumb"))

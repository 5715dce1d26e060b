"""Reachability over child-to-parent edges: closure with shortest distances, levels, rings, paths, acyclicity.

Edges are (src child, tgt parent, label). Queries are frames, never single nodes: every operator answers all rows
of its input in one plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.session import Scratch


#: Levels walked one by one before the rest is left to a closure.
SHALLOW = 6
#: Spark's limit on the rows of a recursive CTE.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


class MissingLabel(ValueError):
    """A label restriction met an edge without a label."""


def edges_with(edges: DataFrame, labels: Iterable[str] | None) -> DataFrame:
    """Edges whose label is in ``labels``; all edges for None. A null label under a restriction is an error."""
    if labels is None:
        return edges
    wanted = [labels] if isinstance(labels, str) else list(labels)
    if edges.where(F.col("label").isNull()).limit(1).count():
        raise MissingLabel("an edge has no label, so edges can't be told apart by it")
    return edges.where(F.col("label").isin(wanted))


def closure(edges: DataFrame, labels: Iterable[str] | None = None, max_dist: int | None = None) -> DataFrame:
    """(node, anc, dist): all pairs where anc is reachable upward from node, with the fewest hops; no (n, n, 0) rows.

    Semi-naive doubling: once all pairs up to h hops are known, those of h+1 to 2h hops are the pairs of exactly h
    hops continued by known ones, so a taxonomy of depth d takes about log2(d) joins. Each round is cut through a written
    table. A cyclic input ends as well and holds rows with node = anc. Repeated edges count once, null ends are ignored.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    first = edges_with(edges, labels).where(F.col("src").isNotNull() & F.col("tgt").isNotNull())
    parts = [scratch.keep(first.select(F.col("src").alias("node"), F.col("tgt").alias("anc")).distinct().withColumn("dist", F.lit(1).cast("bigint")))]
    reach = 1
    while max_dist is None or reach < max_dist:
        known = _union(parts)
        front = known.where(F.col("dist") == reach).select("node", F.col("anc").alias("mid"))
        step = known.select(F.col("node").alias("mid"), "anc", F.col("dist").alias("more"))
        longer = front.join(step, "mid").groupBy("node", "anc").agg((F.min("more") + reach).alias("dist"))
        if max_dist is not None:
            longer = longer.where(F.col("dist") <= max_dist)
        new = scratch.keep(longer.join(known.select("node", "anc"), ["node", "anc"], "left_anti"))
        if new.isEmpty():
            scratch.drop(new)
            break
        parts.append(new)
        reach *= 2
    out = _union(parts)
    return out if max_dist is None else out.where(F.col("dist") <= max_dist)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def closure_cte(spark, edges: DataFrame, max_depth: int = 100) -> DataFrame:
    """The closure by a recursive CTE, for trees and other inputs with few paths (it walks every path).

    It runs at once: Spark's limit on the rows of a recursion, an error at a million by default, is read when the plan runs and lifted for
    the time of this call. Repeated edges count once. More levels than ``max_depth`` (or a cycle) are an error.
    """
    scratch = Scratch(spark, "cte")
    view = f"_closure_edges_{uuid.uuid4().hex[:12]}"
    first = scratch.keep(edges.select("src", "tgt").distinct())
    first.createOrReplaceTempView(view)
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return scratch.keep(
            spark.sql(
                f"""WITH RECURSIVE w(node, anc, dist) MAX RECURSION LEVEL {int(max_depth)} AS (
                      SELECT src, tgt, CAST(1 AS BIGINT) FROM {view}
                      UNION ALL SELECT w.node, e.tgt, w.dist + 1 FROM w JOIN {view} e ON w.anc = e.src)
                    SELECT node, anc, min(dist) AS dist FROM w GROUP BY node, anc"""
            )
        )
    finally:
        spark.conf.set(ROW_LIMIT, before)
        spark.catalog.dropTempView(view)
        scratch.drop(first)


def with_self(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The closure with a row (n, n, 0) for each node."""
    own = nodes.select(F.col("id").alias("node"), F.col("id").alias("anc"), F.lit(0).cast("bigint").alias("dist"))
    return closed.unionByName(own)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): nodes without parents."""
    return nodes.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): nodes without children, isolated ones included."""
    return nodes.select("id").join(edges.select(F.col("tgt").alias("id")), "id", "left_anti")


def _hops(nodes: DataFrame, edges: DataFrame, start: DataFrame, down: bool, name: str) -> DataFrame:
    """Fewest hops from a set of start nodes along the edges.

    The first SHALLOW levels are a breadth-first frontier of one row per node. What lies deeper is done by one closure, in log2 of its
    depth, of the edges into nodes not reached yet: every way there leads over the last frontier.
    """
    scratch = Scratch(nodes.sparkSession, "levels")
    step = edges.select((F.col("tgt") if down else F.col("src")).alias("id"), (F.col("src") if down else F.col("tgt")).alias("next")).distinct()
    parts = [scratch.keep(start.select("id").distinct().withColumn(name, F.lit(0).cast("bigint")))]
    level = 0
    while True:
        level += 1
        reached = parts[-1].join(step, "id").select(F.col("next").alias("id")).distinct()
        new = scratch.keep(reached.join(_union(parts).select("id"), "id", "left_anti").withColumn(name, F.lit(level).cast("bigint")))
        if new.isEmpty():
            scratch.drop(new)
            return _union(parts)
        parts.append(new)
        if level == SHALLOW:
            rest = step.join(_union(parts).select(F.col("id").alias("next")), "next", "left_anti")
            deep = closure(scratch.keep(rest.select(F.col("next").alias("src"), F.col("id").alias("tgt"))))
            edge = parts[-1].select(F.col("id").alias("anc"))
            found = deep.join(edge, "anc", "left_semi").groupBy(F.col("node").alias("id")).agg((F.min("dist") + level).alias(name))
            return _union([*parts, scratch.keep(found)])


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): fewest hops to any root, 0 at roots. Nodes that no root reaches (cycles) are left out."""
    return _hops(nodes, edges, roots(nodes, edges), True, "level")


def reverse_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, reverse_level): fewest hops to any leaf below, 0 at leaves."""
    return _hops(nodes, edges, leaves(nodes, edges), False, "reverse_level")


def filter_by_level(nodes: DataFrame, edges: DataFrame, top: int = 0, bottom: int = 0) -> DataFrame:
    """(id) within level bounds. top > 0: level >= top; top < 0: reverse level <= -top; bottom > 0: reverse level >= bottom;
    bottom < 0: level <= -bottom; 0: no bound."""
    out = nodes.select("id").distinct()
    if top > 0 or bottom < 0:
        lv = levels(nodes, edges)
        out = out.join(lv.where((F.col("level") >= top if top > 0 else F.lit(True)) & (F.col("level") <= -bottom if bottom < 0 else F.lit(True))), "id", "left_semi")
    if top < 0 or bottom > 0:
        rl = reverse_levels(nodes, edges)
        ok = (F.col("reverse_level") <= -top if top < 0 else F.lit(True)) & (F.col("reverse_level") >= bottom if bottom > 0 else F.lit(True))
        out = out.join(rl.where(ok), "id", "left_semi")
    return out


def is_acyclic(edges: DataFrame) -> bool:
    """Whether no node reaches itself: peel off nodes without parents until none is left or nothing moves."""
    return cyclic_edges(edges).isEmpty()


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """(src, tgt): the edges on cycles or on a way from one cycle to another.

    Edges of nodes without parents or without children are peeled off for SHALLOW rounds, one pair of semi joins over what is left each.
    What then remains (cycles, and branches deeper than that) is decided by its closure.
    """
    scratch = Scratch(edges.sparkSession, "peel")
    left = scratch.keep(edges.where(F.col("src").isNotNull() & F.col("tgt").isNotNull()).select("src", "tgt").distinct())
    n = left.count()
    for _ in range(SHALLOW):
        if not n:
            return left
        up = left.join(left.select(F.col("src").alias("tgt")).distinct(), "tgt", "left_semi")
        both = up.join(left.select(F.col("tgt").alias("src")).distinct(), "src", "left_semi").select("src", "tgt")
        after = scratch.keep(both)
        m = after.count()
        scratch.drop(left)
        left = after
        if m == n:
            return left
        n = m
    if not n:
        return left
    c = closure(left)
    core = scratch.keep(c.where(F.col("node") == F.col("anc")).select("node").distinct())
    over = c.join(core, "node", "left_semi").select(F.col("anc").alias("src")).distinct()
    under = c.join(core.withColumnRenamed("node", "anc"), "anc", "left_semi").select(F.col("node").alias("tgt")).distinct()
    return scratch.keep(left.join(over, "src", "left_semi").join(under, "tgt", "left_semi").select("src", "tgt"))


def rings(queries: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(query_id, node, dist): nodes within ``depth`` hops along edges in either direction, with their exact distance (the
    ring n holds dist = n); the query node itself has distance 0. ``queries`` has query_id and node."""
    scratch = Scratch(queries.sparkSession, "rings")
    both = edges.select("src", "tgt").unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()
    parts = [scratch.keep(queries.select("query_id", "node").distinct().withColumn("dist", F.lit(0).cast("bigint")))]
    for d in range(1, depth + 1):
        grown = parts[-1].join(both, F.col("node") == F.col("src")).select("query_id", F.col("tgt").alias("node")).distinct()
        fresh = grown.join(_union(parts).select("query_id", "node"), ["query_id", "node"], "left_anti")
        parts.append(scratch.keep(fresh.withColumn("dist", F.lit(d).cast("bigint"))))
    return _union(parts)


def root_paths(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, path array<bigint>): every path from a root down to a node. The number of paths may exceed that of nodes
    by far on graphs with many parents; ``max_depth`` bounds their length in edges. Cycles are never entered."""
    scratch = Scratch(nodes.sparkSession, "paths")
    step = edges.select(F.col("tgt").alias("node"), F.col("src").alias("child")).distinct()
    parts = [scratch.keep(roots(nodes, edges).select(F.col("id").alias("node"), F.array("id").alias("path")))]
    depth = 0
    while max_depth is None or depth < max_depth:
        grown = parts[-1].join(step, "node").where(~F.array_contains("path", F.col("child")))
        new = scratch.keep(grown.select(F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path")))
        if new.isEmpty():
            scratch.drop(new)
            break
        parts.append(new)
        depth += 1
    return _union(parts)


def path_prefixes(paths: DataFrame) -> DataFrame:
    """(node, path_key, prefix_key): each strict prefix of each path, keys being ids joined by a bar."""
    key = lambda c: F.concat_ws("|", F.transform(c, lambda x: x.cast("string")))
    return paths.where(F.size("path") > 1).select(
        "node", key(F.col("path")).alias("path_key"), F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("n"), "path"
    ).select("node", "path_key", key(F.slice("path", F.lit(1), F.col("n"))).alias("prefix_key"))

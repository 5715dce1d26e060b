"""Subgraphs: search spaces for insertion and moves, induced subgraphs, neighbourhoods, listings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxograft.operators.closure import closure, edges_with, filter_by_level, roots, with_self
from taxograft.operators.lattice import lca, reduce_subset
from taxograft.session import Scratch


def induced(nodes_in: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with both ends among ``nodes_in`` (id)."""
    keep = nodes_in.select("id").distinct()
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "tgt"), "tgt", "left_semi")


def insertion_space(
    bases: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    closed: DataFrame,
    crop_top: bool = True,
    force_labels: Iterable[Iterable[str]] | None = None,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The search space of each base set: (query_id, id) and (query_id, src, tgt, label).

    ``bases`` is (query_id, node). The base is reduced to its most specific nodes. The walk starts at the roots, or with ``crop_top``
    at the base's lowest common ancestors (with ``force_labels`` also those over each label set, the most general of all),
    goes down, stops at base nodes and skips everything strictly below the base; ``strict`` keeps only ancestors-or-self of some base
    node. An edge belongs to the space if both ends are walked and its parent is not a base node.
    """
    scratch = Scratch(nodes.sparkSession, "space")
    base = scratch.keep(reduce_subset(bases, closed))
    if crop_top:
        tops = lca(base, closed, nodes)
        for labels in force_labels or ():
            restricted = closure(edges_with(edges, list(labels)))
            tops = tops.unionByName(lca(base, restricted, nodes))
        if force_labels:
            tops = reduce_subset(tops.distinct(), closed, most_general=True)
    else:
        # the walk of each stated query starts at all roots (one, in a rooted taxonomy)
        tops = base.select("query_id").distinct().crossJoin(roots(nodes, edges).select(F.col("id").alias("node")))
    below = base.join(closed.select(F.col("anc").alias("node"), F.col("node").alias("low")), "node").select("query_id", F.col("low").alias("node"))
    star = with_self(closed, nodes)
    step = edges.select(F.col("tgt").alias("node"), F.col("src").alias("child"), "label")
    if strict:
        # what lies above the base and at or below a top: all ways between are above the base as well, and none leads over a base node
        upper = base.join(star.select("node", F.col("anc").alias("up")), "node").select("query_id", F.col("up").alias("node")).distinct()
        over = upper.join(star.select("node", "anc"), "node")
        inside = over.join(tops.select("query_id", F.col("node").alias("anc")).distinct(), ["query_id", "anc"], "left_semi").select("query_id", "node").distinct()
        inside = scratch.keep(inside)
        own = inside.withColumnRenamed("node", "child").join(step, "child").join(inside, ["query_id", "node"], "left_semi")
        return inside.select("query_id", F.col("node").alias("id")), own.select("query_id", F.col("child").alias("src"), F.col("node").alias("tgt"), "label").distinct()
    start = tops.select("query_id", "node").distinct().join(below, ["query_id", "node"], "left_anti")
    seen, parts = [scratch.keep(start)], []
    base_mark = base.select("query_id", "node")
    below = scratch.keep(below.distinct())
    while True:
        open_nodes = seen[-1].join(base_mark, ["query_id", "node"], "left_anti")
        moved = open_nodes.join(step, "node").select("query_id", F.col("child").alias("node"), F.col("node").alias("parent"), "label")
        moved = scratch.keep(moved.join(below, ["query_id", "node"], "left_anti"))
        parts.append(moved)
        new = scratch.keep(moved.select("query_id", "node").distinct().join(_union(seen), ["query_id", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen.append(new)
    walked, used = _union(seen), _union(parts)
    return walked.select("query_id", F.col("node").alias("id")), used.select("query_id", F.col("node").alias("src"), F.col("parent").alias("tgt"), "label").distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def move_space(nodes: DataFrame, edges: DataFrame, top: int = 0, bottom: int = 1) -> tuple[DataFrame, DataFrame]:
    """(id) and edges of the search space of a category move: the nodes within the level bounds, induced."""
    keep = Scratch(nodes.sparkSession, "move").keep(filter_by_level(nodes, edges, top, bottom))
    return keep, induced(keep, edges)


def siblings(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, node, sibling): other children of any parent of the node, each once. ``queries`` has query_id and node."""
    up = queries.select("query_id", "node").join(edges.select(F.col("src").alias("node"), "tgt").distinct(), "node")
    down = edges.select("tgt", F.col("src").alias("sibling")).distinct()
    return up.join(down, "tgt").where(F.col("sibling") != F.col("node")).select("query_id", "node", "sibling").distinct()


def sibling_classes(edges: DataFrame) -> DataFrame:
    """(node, parent, n_siblings): the classes that siblings form, without a pair of them: a node's siblings are the other children of its
    parents, ``n_siblings`` of each."""
    e = edges.select("src", "tgt").distinct()
    size = e.groupBy("tgt").agg(F.count(F.lit(1)).alias("n"))
    return e.join(size, "tgt").select(F.col("src").alias("node"), F.col("tgt").alias("parent"), (F.col("n") - 1).alias("n_siblings"))


#: Members of a family that are joined at once with each asker, and rows of the outcome that a task makes, roughly.
PART, TASK_ROWS = 1000, 2_000_000


def _families(asked: DataFrame, edges: DataFrame, scratch: Scratch, *key: str) -> tuple[DataFrame, DataFrame]:
    """(key, family) and (family, sibling): askers by the set of their parents, and the children of each such set (one under two of them is there
    twice), with what else ``edges`` hold.

    ``asked`` has the key and tgt, a parent; ``edges`` are distinct. Askers with the same parents share one family, so that what depends on the
    children only is done once for all of them.
    """
    sets = scratch.keep(asked.groupBy(*key).agg(F.sort_array(F.collect_set("tgt")).alias("parents")))
    named = scratch.keep(sets.select("parents").distinct().withColumn("family", F.monotonically_increasing_id()))
    grown = named.select("family", F.explode("parents").alias("tgt")).join(edges.withColumnRenamed("src", "sibling"), "tgt")
    return scratch.keep(sets.join(named, "parents").select(*key, "family")), grown.drop("tgt")


def _spread(asked: DataFrame, members: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Each row of ``asked`` (with family) with each row of ``members`` (family, sibling, ...; both written tables), but for the pairs of ``skip``
    (query_id, sibling).

    A few short rows make very many, so neither side's size says how many tasks are needed: families are cut in parts by a hash of the sibling, an
    asker comes once per part, and the number of tasks follows from the number of rows to come. The outcome itself is never shuffled.
    """
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / PART).cast("bigint"))
    part = F.pmod(F.xxhash64("sibling"), F.col("_parts")).alias("_part")
    n = asked.groupBy("family").agg(F.count(F.lit(1)).alias("_a")).join(size, "family").agg(F.sum(F.col("_a") * F.col("_n"))).first()[0] or 0
    tasks = 1 + n // TASK_ROWS
    many = asked.join(size, "family").select(*asked.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part"))
    if skip is not None:
        # as few as the members of a part at most
        own = skip.join(asked, "query_id").join(members.select("family", "sibling"), ["family", "sibling"], "left_semi").join(size, "family")
        many = many.join(own.select("query_id", part, "sibling").groupBy("query_id", "_part").agg(F.collect_set("sibling").alias("_skip")), ["query_id", "_part"], "left")
    cut = members.join(size.select("family", "_parts"), "family").select(*members.columns, part)
    out = many.repartition(tasks, "family", "_part").join(cut.repartition(tasks, "family", "_part"), ["family", "_part"])
    if skip is not None:
        out = out.where(F.col("_skip").isNull() | ~F.array_contains("_skip", F.col("sibling"))).drop("_skip")
    return out.drop("_part")


def listed_siblings(queries: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node, sibling, label, place): the siblings of :func:`siblings` as a listing shows them, numbered by label, then id.

    The children of each set of parents are sorted once; a node's own place in that order is taken out of its listing.
    """
    scratch = Scratch(edges.sparkSession, "listed")
    q = scratch.keep(queries.select("query_id", "node").distinct())
    marked = q.select(F.col("node").alias("src"), F.lit(True).alias("asks")).distinct()
    e = scratch.keep(edges.select("src", "tgt").where(F.col("src").isNotNull()).distinct().join(marked, "src", "left"))
    asked, members = _families(e.where("asks").select(F.col("src").alias("node"), "tgt"), e, scratch, "node")
    named = members.repartition("family").dropDuplicates(["family", "sibling"]).join(nodes.select(F.col("id").alias("sibling"), "label"), "sibling", "left")
    w = Window.partitionBy("family").orderBy("label", "sibling")
    listing = scratch.keep(named.select("family", "sibling", "label", "asks", F.row_number().over(w).cast("bigint").alias("rank")))
    own = listing.where("asks").select("family", F.col("sibling").alias("node"), F.col("rank").alias("own"))
    found = _spread(scratch.keep(q.join(asked, "node").join(own, ["family", "node"])), listing.drop("asks")).where(F.col("sibling") != F.col("node"))
    place = F.when(F.col("rank") > F.col("own"), F.col("rank") - 1).otherwise(F.col("rank"))
    return found.select("query_id", "node", "sibling", "label", place.alias("place"))


def neighbourhood(queries: DataFrame, edges: DataFrame, radius: int = 1) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, role) around each query node, and the induced edges per query.

    Holds the node (``selected``), ancestors and descendants within the radius, and the children of its direct parents. Roles: a direct
    parent is ``ancestor``, a direct child ``child``, a child of a direct parent ``sibling``, the rest ``context``.
    """
    scratch = Scratch(edges.sparkSession, "near")
    near = closure(edges, max_dist=max(1, radius))
    q = scratch.keep(queries.select("query_id", "node").distinct())
    e = near.where(F.col("dist") == 1).select(F.col("node").alias("src"), F.col("anc").alias("tgt"))
    part = lambda df, c, rank: df.select("query_id", F.col(c).alias("id"), F.lit(rank).alias("rank"))
    up = q.join(near, "node").where(F.col("dist") <= radius)
    down = q.join(near.select(F.col("anc").alias("node"), F.col("node").alias("low"), "dist"), "node").where(F.col("dist") <= radius)
    ranked = part(q, "node", 0)
    for df, c in ((up, "anc"), (down, "low")):
        ranked = ranked.unionByName(part(df.where(F.col("dist") == 1), c, 1 if c == "anc" else 2)).unionByName(part(df.where(F.col("dist") > 1), c, 4))
    close = scratch.keep(ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank")))
    # siblings, by far the most, are not gathered by query: those that have another role are skipped, and context that are siblings is left out
    asked, members = _families(q.join(e.withColumnRenamed("src", "node"), "node"), e, scratch, "query_id")
    members = scratch.keep(members.distinct())
    nearest = close.where(F.col("rank") < 3)
    beside = _spread(asked, members, nearest.select("query_id", F.col("id").alias("sibling")))
    rest = close.where(F.col("rank") > 3).join(asked, "query_id", "left").join(members.withColumnRenamed("sibling", "id"), ["family", "id"], "left_anti")
    all_ranked = nearest.unionByName(part(beside, "sibling", 3)).unionByName(rest.select("query_id", "id", "rank"))
    names = F.array(*[F.lit(x) for x in ("selected", "ancestor", "child", "sibling", "context")])
    members = all_ranked.select("query_id", "id", F.element_at(names, F.col("rank") + 1).alias("role"))
    e = edges.select("src", "tgt").distinct()
    m = members.select("query_id", "id")
    inner = m.withColumnRenamed("id", "src").join(e, "src").join(m.withColumnRenamed("id", "tgt"), ["query_id", "tgt"], "left_semi")
    return members, inner.select("query_id", "src", "tgt")


def short_label(label: Column) -> Column:
    """A label as shown: cut to 18 characters and an ellipsis where it has more than 20."""
    return F.when(F.length(label) > 20, F.concat(F.substring(label, 1, 18), F.lit("…"))).otherwise(label)


def highlight(label: Column, text: str) -> Column:
    """The label cut at the places that match the text, whatever its case: array<struct<text, hit>>."""
    quoted = "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    if not text:
        return F.array(F.struct(label.alias("text"), F.lit(False).alias("hit")))
    pieces = F.regexp_extract_all(label, F.lit(f"(?is)({quoted}|(?:(?!{quoted}).)+)"), F.lit(1))
    return F.transform(pieces, lambda p: F.struct(p.alias("text"), (F.lower(p) == text.lower()).alias("hit")))


def search_labels(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(id, label): the first nodes by label (then id) whose label or id holds the text, whatever its case. A top-k report."""
    t = text.lower()
    hit = F.lower("label").contains(t) | F.col("id").cast("string").contains(t)
    return nodes.where(hit).select("id", "label").orderBy("label", "id").limit(limit)


def preview_rows(paths: DataFrame, nodes: DataFrame, once: bool = True) -> DataFrame:
    """(position key, depth, id, label) of a tree listing from :func:`root_paths`: rows sort by their path of labels and ids; with
    ``once`` each node only at its first place."""
    at = paths.select("node", (F.size("path") - 1).alias("depth"), F.posexplode("path").alias("pos", "step"), F.col("path"))
    named = at.join(nodes.select(F.col("id").alias("step"), "label"), "step", "left")
    keyed = named.groupBy("node", "path", "depth").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("label", F.lit("")).alias("label"), F.col("step").cast("string").alias("id")))).alias("k"))
    rows = keyed.select(F.col("node").alias("id"), F.col("depth").cast("bigint").alias("depth"), F.concat_ws("/", F.transform("k", lambda x: F.concat_ws(":", x["label"], x["id"]))).alias("sort_key"))
    if once:
        w = Window.partitionBy("id").orderBy("sort_key")
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
    return rows.join(nodes.select("id", "label"), "id", "left")

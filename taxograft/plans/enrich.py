"""Placing new concepts: traverse search spaces by a subsumption model, resolve equivalences, insert in rounds.

All concepts of a batch are placed against one snapshot; insertion then runs once for the batch, in a fixed order of labels, and the next
batch sees its result. A placement is three row sets per query: superclasses, subclasses and at most one equivalent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.config import InsertionConfig
from taxograft.functions.lexical import lexical_match
from taxograft.functions.models import ScoreCache, Scorer, word_scorer
from taxograft.model import NEW, ROOT_ID, Taxonomy
from taxograft.operators import lattice, space
from taxograft.operators.closure import closure
from taxograft.operators.numbering import dense_numbers
from taxograft.operators.vectors import top_k
from taxograft.session import Scratch


@dataclass
class Placement:
    """``log`` is (query_id, label, node, role, p_sup, p_sub): role superclass, subclass or equivalent. Rejected queries have no row."""

    log: DataFrame
    queries: DataFrame


def traverse(start: DataFrame, step: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, tolerance: int = 0, barred: DataFrame | None = None, stop: DataFrame | None = None, prune: DataFrame | None = None) -> DataFrame:
    """(query_id, node, p) accepted by a level-by-level walk.

    From ``start`` (query_id, node) the walk follows ``step`` (query_id, node, next), or (node, next) where all queries walk the same edges. ``score`` adds p to (query_id, node). A node with p at or
    above the threshold is accepted and expanded; one below is expanded while fewer than ``tolerance`` failures lie directly before it. Nodes in
    ``barred`` are never entered, accepted nodes in ``stop`` not expanded. With ``prune`` (query_id, node, beyond) all nodes beyond a finally
    failing node are barred for later levels. Of several ways to a node in one level the one with the fewest failures counts.
    """
    scratch = Scratch(start.sparkSession, "walk")
    on = lambda df: [c for c in ("query_id", "node") if c in df.columns]
    front = scratch.keep(start.select("query_id", "node").distinct().withColumn("fails", F.lit(0)))
    if barred is not None:
        front = scratch.keep(front.join(barred.select("query_id", "node").distinct(), ["query_id", "node"], "left_anti"))
    visited = scratch.keep(front.select("query_id", "node") if barred is None else front.select("query_id", "node").unionByName(barred.select("query_id", "node")).distinct())
    accepted: list[DataFrame] = []
    while not front.isEmpty():
        seen = scratch.keep(score(front))
        ok = F.col("p") >= threshold
        accepted.append(scratch.keep(seen.where(ok).select("query_id", "node", "p")))
        grow = seen.where(ok | (F.col("fails") < tolerance)).withColumn("fails", F.when(ok, 0).otherwise(F.col("fails") + 1))
        if stop is not None:
            grow = grow.join(stop.select("query_id", "node").distinct().withColumn("_stop", F.lit(True)), ["query_id", "node"], "left").where(~(ok & F.coalesce("_stop", F.lit(False))))
        reached = grow.select("query_id", "node", "fails").join(step, on(step)).groupBy("query_id", F.col("next").alias("node")).agg(F.min("fails").alias("fails"))
        if prune is not None:
            dead = seen.where(~ok & (F.col("fails") >= tolerance)).select("query_id", "node").join(prune, on(prune)).select("query_id", F.col("beyond").alias("node"))
            visited = scratch.keep(visited.unionByName(dead).distinct())
        front = scratch.keep(reached.join(visited, ["query_id", "node"], "left_anti"))
        visited = scratch.keep(visited.unionByName(front.select("query_id", "node")))
    out = accepted[0] if accepted else front.select("query_id", "node", F.lit(0.0).alias("p"))
    for a in accepted[1:]:
        out = out.unionByName(a)
    return out


def _scorer(queries: DataFrame, nodes: DataFrame, scores: ScoreCache, upward: bool, sure: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """Adds p: how surely the node subsumes the query's label, or with ``upward`` the label the node. The root concept subsumes everything; so do
    pairs in ``sure``. Each distinct pair of labels is scored once for as long as the cache lives: over levels, directions and rounds."""
    labels = nodes.select(F.col("id").alias("node"), F.col("label").alias("_nl"))
    asked = queries.select("query_id", F.col("label").alias("_ql"))

    def add(front: DataFrame) -> DataFrame:
        named = front.join(labels, "node", "left").join(asked, "query_id")
        sub, sup = ("_nl", "_ql") if upward else ("_ql", "_nl")
        pairs = scores.of(named.select(F.col(sub).alias("sub"), F.col(sup).alias("sup"))).select(F.col("sub").alias("_a"), F.col("sup").alias("_b"), "p")
        out = named.join(pairs, F.col(sub).eqNullSafe(F.col("_a")) & F.col(sup).eqNullSafe(F.col("_b")))
        p = F.coalesce("p", F.lit(0.0))
        if not upward:
            p = F.when(F.col("node") == ROOT_ID, 1.0).otherwise(p)
        if sure is not None:
            out = out.join(sure.select("query_id", "node").distinct().withColumn("_sure", F.lit(True)), ["query_id", "node"], "left")
            p = F.when(F.coalesce("_sure", F.lit(False)), 1.0).otherwise(p)
        return out.select("query_id", "node", "fails", p.alias("p"))

    return add


def place(taxonomy: Taxonomy, queries: DataFrame, bases: DataFrame | None, config: InsertionConfig | None = None, scorer: Scorer | ScoreCache = word_scorer) -> Placement:
    """Place the labels of ``queries`` (query_id, label) given ``bases`` (query_id, node).

    Superclasses are the most specific nodes accepted on the way down, subclasses the most general ones accepted on the way up from the
    leaves; a node accepted both ways is equivalent. A label that matches a known one by its words is equivalent to it for sure. Of several
    equivalents the best by the score function stays, ties by id; the others become superclasses or subclasses by their larger probability.
    Queries without a base search the whole taxonomy. A ``ScoreCache`` as scorer keeps its scores for later calls.
    """
    cfg = config or InsertionConfig()
    scores = ScoreCache.over(taxonomy.spark, scorer)
    if not 0 <= cfg.threshold <= 1:
        raise ValueError("the threshold must lie in [0, 1]")
    scratch = Scratch(taxonomy.spark, "place")
    nodes, edges, closed = taxonomy.nodes, taxonomy.edges, taxonomy.closure()
    queries = scratch.keep(queries.select("query_id", "label"))
    step = edges.select("src", "tgt").distinct()
    if bases is None:
        # all queries share one space, the whole taxonomy, so its edges and closure carry no query; each query starts at its few roots, and on
        # the way up at all leaves, every one of which has to be scored against it
        used, within = step, closed.select("node", "anc")
        asked = queries.select("query_id")
        tops = asked.crossJoin(taxonomy.roots().withColumnRenamed("id", "node"))
        bottoms = asked.crossJoin(taxonomy.leaves().withColumnRenamed("id", "node"))
        sure = down_stop = None
    else:
        bases = scratch.keep(bases.select("query_id", "node").distinct())
        ids, used = space.insertion_space(bases, nodes, edges, closed, cfg.subgraph_crop, cfg.subgraph_force, cfg.subgraph_strict)
        walked, used = scratch.keep(ids), scratch.keep(used.select("query_id", "src", "tgt"))
        sure = down_stop = None
        if cfg.force_base_subsumptions:
            size = bases.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
            star = lattice.with_self(closed, nodes)
            above = bases.join(star, "node").groupBy("query_id", F.col("anc").alias("node")).agg(F.count(F.lit(1)).alias("n"))
            sure = scratch.keep(above.join(size, "query_id").where(F.col("n") == F.col("size")).select("query_id", "node"))
            down_stop = bases
        has = lambda c: used.select("query_id", F.col(c).alias("id")).distinct()
        tops = walked.join(has("src"), ["query_id", "id"], "left_anti").select("query_id", F.col("id").alias("node"))
        bottoms = walked.join(has("tgt"), ["query_id", "id"], "left_anti").select("query_id", F.col("id").alias("node"))
        # reachability within each query's own space
        within = closed.select("node", "anc").join(walked.select("query_id", F.col("id").alias("node")), "node").join(walked.select("query_id", F.col("id").alias("anc")), ["query_id", "anc"], "left_semi")
        within = scratch.keep(within.select("query_id", "node", "anc"))
    key = [c for c in ("query_id",) if c in within.columns]
    inner = lambda up: used.select(*key, F.col("src" if up else "tgt").alias("node"), F.col("tgt" if up else "src").alias("next"))
    pruned_down = within.select(*key, F.col("anc").alias("node"), F.col("node").alias("beyond")) if cfg.force_prune else None
    pruned_up = within.select(*key, "node", F.col("anc").alias("beyond")) if cfg.force_prune else None
    got = scratch.keep(traverse(tops, inner(False), _scorer(queries, nodes, scores, False, sure), cfg.threshold, cfg.tolerance, None, down_stop, pruned_down))
    # strict ancestors of accepted nodes are not most specific, and never entered on the way up
    over = scratch.keep(got.join(within, [*key, "node"]).select("query_id", F.col("anc").alias("node")).distinct())
    sup = scratch.keep(got.join(over, ["query_id", "node"], "left_anti"))
    live = sup.select("query_id").distinct()
    up = traverse(bottoms.join(live, "query_id", "left_semi"), inner(True), _scorer(queries, nodes, scores, True, bases if sure is not None else None), cfg.threshold, cfg.tolerance, over, sup, pruned_up)
    up = scratch.keep(up.withColumnRenamed("p", "p_sub"))
    eqv = scratch.keep(sup.join(up, ["query_id", "node"]).select("query_id", "node", F.col("p").alias("p_sup"), "p_sub"))
    rest = up.join(eqv, ["query_id", "node"], "left_anti")
    inside = rest.select("query_id", "node").join(within, [*key, "node"]).select("query_id", "node", "anc")
    lower = inside.join(rest.select("query_id", F.col("node").alias("anc")), ["query_id", "anc"], "left_semi").select("query_id", "node").distinct()
    sub = rest.join(lower, ["query_id", "node"], "left_anti").select("query_id", "node", F.lit(None).cast("double").alias("p_sup"), "p_sub")
    sup = sup.join(eqv, ["query_id", "node"], "left_anti").select("query_id", "node", F.col("p").alias("p_sup"), F.lit(None).cast("double").alias("p_sub"))
    if cfg.do_lexical_check:
        known = lexical_match(queries, nodes).where(F.col("match").isNotNull())
        same = known.select("query_id", F.col("match").alias("node"), F.lit(1.0).alias("p_sup"), F.lit(1.0).alias("p_sub"))
        eqv = eqv.join(same.select("query_id", "node"), ["query_id", "node"], "left_anti").unionByName(same)
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(cfg.eqv_score_func(F.col("p_sup"), F.col("p_sub")).desc(), "node")
    ranked = eqv.withColumn("_r", F.row_number().over(order))
    best = scratch.keep(ranked.where(F.col("_r") == 1).drop("_r"))
    as_sup = F.col("p_sup") >= F.col("p_sub")
    demoted = ranked.where(F.col("_r") > 1)
    role = lambda df, r: df.select("query_id", "node", F.lit(r).alias("role"), "p_sup", "p_sub")
    taken = best.select("query_id", "node")
    sups = role(sup, "superclass").unionByName(role(demoted.where(as_sup), "superclass")).join(taken, ["query_id", "node"], "left_anti")
    subs = role(sub, "subclass").unionByName(role(demoted.where(~as_sup), "subclass")).join(taken, ["query_id", "node"], "left_anti")
    log = role(best, "equivalent").unionByName(sups).unionByName(subs)
    placed = log.where(F.col("role") != "subclass").select("query_id").distinct()
    log = log.join(placed, "query_id", "left_semi").join(queries, "query_id").dropDuplicates(["query_id", "node", "role"])
    return Placement(scratch.keep(log.select("query_id", "label", "node", "role", "p_sup", "p_sub")), queries)


def insert(taxonomy: Taxonomy, placement: Placement) -> tuple[Taxonomy, int, int]:
    """The taxonomy with a batch inserted, and the numbers of classes and edges added.

    New concepts get dense ids after the largest, by hash of their labels; equal labels become one concept. Superclasses are reduced to the
    most specific, subclasses to the most general; edges that would close a cycle are left out. Edges are labelled ``new``.
    """
    scratch = Scratch(taxonomy.spark, "insert")
    log, closed = placement.log, taxonomy.closure()
    same = log.where(F.col("role") == "equivalent").groupBy("label").agg(F.min("node").alias("concept"))
    fresh = log.select("label").distinct().join(same, "label", "left_anti")
    first = taxonomy.next_id()
    numbered = dense_numbers(fresh, "label").withColumn("concept", F.lit(first) + F.col("place"))
    named = scratch.keep(same.unionByName(numbered.select("label", "concept")))
    sets = scratch.keep(log.where(F.col("role") != "equivalent").join(named, "label").select(F.col("concept").alias("query_id"), "node", "role").distinct())
    sups = lattice.reduce_subset(sets.where(F.col("role") == "superclass"), closed)
    subs = lattice.reduce_subset(sets.where(F.col("role") == "subclass"), closed, most_general=True)
    edges = sups.select(F.col("query_id").alias("src"), F.col("node").alias("tgt")).unionByName(subs.select(F.col("node").alias("src"), F.col("query_id").alias("tgt")))
    edges = edges.where(F.col("src") != F.col("tgt")).distinct().withColumn("label", F.lit(NEW))
    implied = lattice.with_self(closed, taxonomy.nodes).select(F.col("node").alias("src"), F.col("anc").alias("tgt"))
    edges = scratch.keep(edges.join(implied, ["src", "tgt"], "left_anti"))
    new_nodes = named.join(same, "label", "left_anti").select(F.col("concept").alias("id"), "label")
    grown = taxonomy.add_nodes(new_nodes)[0]
    after, codes = grown.add_edges(edges)
    kept = Scratch(taxonomy.spark, "taxonomy")
    after = Taxonomy(kept.keep(after.nodes), kept.keep(after.edges), taxonomy.version + 1)
    return after, new_nodes.count(), codes.where(F.col("code") == 0).count()


def pair_bases(neighbours: DataFrame, restrict: bool = True) -> DataFrame:
    """(query_id, a, b) from retrieved (seed, id): with ``restrict`` each seed with each of its other neighbours, else all pairs of its k."""
    n = neighbours.select("seed", "id").distinct()
    if restrict:
        pairs = n.where(F.col("id") != F.col("seed")).select("seed", F.col("seed").alias("a"), F.col("id").alias("b"))
    else:
        own = n.select("seed", F.col("seed").alias("id")).unionByName(n).distinct()
        pairs = own.select("seed", F.col("id").alias("a")).join(own.select("seed", F.col("id").alias("b")), "seed").where(F.col("a") < F.col("b"))
    return pairs.select(F.xxhash64("seed", "a", "b").alias("query_id"), "a", "b")


def generate(taxonomy: Taxonomy, bases: DataFrame, generator: Callable[[Column], Column], ignore: Iterable[str] = (), skip_covered: bool = True) -> DataFrame:
    """(query_id, label) generated for each base (query_id, node) from its labels by id. A base one of whose nodes covers the others (its lowest
    common ancestors lie within it, or there are none) is skipped; so are null, empty and ignored labels."""
    b = bases.select("query_id", "node").distinct()
    if skip_covered:
        top = taxonomy.lca(b)
        outside = top.join(b, ["query_id", "node"], "left_anti").select("query_id").distinct()
        b = b.join(outside, "query_id", "left_semi")
    labels = b.join(taxonomy.nodes.select(F.col("id").alias("node"), "label"), "node").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("s"))
    made = labels.select("query_id", generator(F.transform("s", lambda x: x["label"])).alias("label"))
    return made.where(F.col("label").isNotNull() & (F.col("label") != "") & ~F.col("label").isin(*list(ignore) or [""]))


def enrich_manual(taxonomy: Taxonomy, labels: DataFrame, bases: DataFrame | None = None, config: InsertionConfig | None = None, scorer: Scorer | ScoreCache = word_scorer, update: bool = False):
    """Given labels (query_id, label), with or without bases: the placement, and with ``update`` also the grown taxonomy."""
    placement = place(taxonomy, labels, bases, config, scorer)
    reduced = (config or InsertionConfig()).transitive_reduction
    return finish(taxonomy, *insert(taxonomy, placement), reduced) if update else placement


def neighbours_of(seeds: DataFrame, vectors: DataFrame, config: InsertionConfig) -> DataFrame:
    """(seed, id): the nearest of ``vectors`` (id, embedding) to each seed (id), the seed itself among them."""
    q = vectors.join(seeds.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")
    return top_k(q, vectors, config.retrieve_size).select(F.col("query_id").alias("seed"), "id")


def place_between(taxonomy: Taxonomy, near: DataFrame, generator, config: InsertionConfig, scorer: Scorer | ScoreCache = word_scorer) -> Placement:
    """Concepts generated between seeds and what was retrieved for them (seed, id), placed over each pair."""
    scratch = Scratch(taxonomy.spark, "seeds")
    pairs = scratch.keep(pair_bases(near, config.restrict_combinations))
    bases = pairs.select("query_id", F.explode(F.array("a", "b")).alias("node"))
    labels = scratch.keep(generate(taxonomy, bases, generator, config.ignore_label, config.filter_subset))
    return place(taxonomy, labels, bases.join(labels.select("query_id"), "query_id", "left_semi"), config, scorer)


def enrich_seeds(taxonomy: Taxonomy, seeds: DataFrame, vectors: DataFrame, generator, config: InsertionConfig | None = None, scorer: Scorer | ScoreCache = word_scorer, update: bool = False):
    """Concepts between each seed (id) and its nearest neighbours in ``vectors`` (id, embedding)."""
    cfg = config or InsertionConfig()
    near = Scratch(taxonomy.spark, "near").keep(neighbours_of(seeds, vectors, cfg))
    placement = place_between(taxonomy, near, generator, cfg, scorer)
    return finish(taxonomy, *insert(taxonomy, placement), cfg.transitive_reduction) if update else placement


def enrich_auto(taxonomy: Taxonomy, vectors: DataFrame, generator, config: InsertionConfig | None = None, scorer: Scorer | ScoreCache = word_scorer) -> tuple[Taxonomy, int, int]:
    """Rounds of seeds over the leaves, in an order by a seeded hash, until every leaf was a seed or retrieved by one, or ``max_outer_loop`` seeds
    were used. A round takes a batch of seeds; the next round sees its insertions, while the vectors stay those of the start."""
    cfg = config or InsertionConfig()
    scratch = Scratch(taxonomy.spark, "auto")
    scores = ScoreCache.over(taxonomy.spark, scorer)
    pool = scratch.keep(taxonomy.leaves().withColumn("_o", F.md5(F.concat_ws("|", "id", F.lit(str(cfg.rand_seed))))))
    left = cfg.max_outer_loop
    now, classes, links = taxonomy, 0, 0
    while not pool.isEmpty() and (left is None or left > 0):
        n = cfg.batch_size if left is None else min(cfg.batch_size, left)
        seeds = scratch.keep(pool.orderBy("_o", "id").limit(n))
        near = scratch.keep(neighbours_of(seeds, vectors, cfg))
        now, a, b = insert(now, place_between(now, near, generator, cfg, scores))
        classes, links = classes + a, links + b
        used = seeds.select("id").unionByName(near.select("id")).distinct()
        before, pool = pool, scratch.keep(pool.join(used, "id", "left_anti"))
        scratch.drop(before)
        left = None if left is None else left - n
    return finish(taxonomy, now, classes, links, cfg.transitive_reduction)


def finish(before: Taxonomy, after: Taxonomy, classes: int, links: int, reduce: bool = True) -> tuple[Taxonomy, int, int]:
    """The grown taxonomy without implied edges (unless told not to reduce), but with all edges it had before."""
    kept = lattice.transitive_reduction(after.edges, closure(after.edges)) if reduce else after.edges
    lost = before.edges.join(kept.select("src", "tgt"), ["src", "tgt"], "left_anti")
    return Taxonomy(after.nodes, kept.unionByName(lost), after.version), classes, links

"""Re-homing categories: candidate parents by search or retrieval, selection by weighted features, the move itself.

Every target is judged against the original taxonomy without its own parent edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxograft.config import MoveConfig
from taxograft.functions.models import ScoreCache, Scorer, word_scorer
from taxograft.model import MOVED, ROOT_ID, Taxonomy
from taxograft.operators import space
from taxograft.operators.closure import leaves
from taxograft.operators.vectors import cosine, top_k
from taxograft.plans.enrich import _scorer, traverse
from taxograft.session import Scratch


def ignored(nodes: DataFrame, pattern: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """``nodes`` without those whose label matches the pattern from its start, and without ``ids``."""
    out = nodes if pattern is None else nodes.where(~F.coalesce(F.col("label").rlike(f"^(?:{pattern})"), F.lit(False)))
    return out if ids is None else out.join(ids.select("id"), "id", "left_anti")


def unignored(nodes: DataFrame, spec: str | tuple[int, ...]) -> DataFrame:
    """``nodes`` without those that the setting names: ids, or a pattern that labels match from their start."""
    if isinstance(spec, str):
        return ignored(nodes, spec or None)
    return nodes.where(~F.col("id").isin([int(x) for x in spec])) if spec else nodes


def auto_targets(taxonomy: Taxonomy, config: MoveConfig, pattern: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(id): the leaves but ignored ones, by a seeded hash order where ``max_outer_loop`` bounds their number."""
    found = unignored(ignored(taxonomy.nodes, pattern, ids), config.ignore).join(taxonomy.leaves(), "id", "left_semi").select("id")
    if config.max_outer_loop is None:
        return found
    return found.orderBy(F.md5(F.concat_ws("|", "id", F.lit(str(config.rand_seed)))), "id").limit(config.max_outer_loop)


def search_parents(taxonomy: Taxonomy, targets: DataFrame, config: MoveConfig, scorer: Scorer | ScoreCache = word_scorer) -> DataFrame:
    """(target, node): the most specific nodes of the level-bounded search space accepted on the way down; with ``always_search_to_bottom`` only
    leaves of the space. Nothing accepted gives no row. The target itself, what lies below it and nodes that ``sub_ignore`` names are no
    candidates; with ``force_prune`` nothing below a finally failing node is looked at."""
    if not 0 <= config.threshold <= 1:
        raise ValueError("the threshold must lie in [0, 1]")
    scratch = Scratch(taxonomy.spark, "search")
    scores = ScoreCache.over(taxonomy.spark, scorer)
    keep, inner = space.move_space(taxonomy.nodes, taxonomy.edges, config.scope_top_level, config.scope_bottom_level)
    if config.sub_ignore:
        keep = scratch.keep(keep.join(unignored(taxonomy.nodes, config.sub_ignore), "id", "left_semi").select("id"))
        inner = space.induced(keep, inner)
    inner = scratch.keep(inner.select("src", "tgt").distinct())
    t = scratch.keep(targets.select(F.col("id").alias("query_id")).join(taxonomy.nodes.select(F.col("id").alias("query_id"), "label"), "query_id"))
    tops = keep.join(inner.select(F.col("src").alias("id")), "id", "left_anti").select(F.col("id").alias("node"))
    start = t.select("query_id").crossJoin(tops)  # each stated target starts at the few tops of the space
    below = taxonomy.closure().select(F.col("anc").alias("query_id"), "node").join(t.select("query_id"), "query_id", "left_semi")
    barred = below.unionByName(t.select("query_id", F.col("query_id").alias("node")))
    # all targets walk the same edges, so these are joined on the node alone
    step = inner.select(F.col("tgt").alias("node"), F.col("src").alias("next"))
    c = taxonomy.closure()
    prune = c.select(F.col("anc").alias("node"), F.col("node").alias("beyond")) if config.force_prune else None
    got = scratch.keep(traverse(start, step, _scorer(t, taxonomy.nodes, scores, False), config.threshold, config.tolerance, barred, None, prune))
    over = got.join(c.select("node", "anc"), "node").select("query_id", F.col("anc").alias("node")).distinct()
    best = got.join(over, ["query_id", "node"], "left_anti")
    if config.always_search_to_bottom:
        best = best.join(leaves(keep, inner).withColumnRenamed("id", "node"), "node", "left_semi")
    return best.select(F.col("query_id").alias("target"), "node")


def retrieve_parents(
    taxonomy: Taxonomy, targets: DataFrame, vectors: DataFrame, config: MoveConfig, candidates: DataFrame | None = None,
    generator: Callable[[Column], Column] | None = None, embedder: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(target, node): the nearest nodes to any old parent of the target within the candidate levels (and ``candidates``, if given), those that
    ``ret_ignore`` names left out. With ``do_generate`` the parent asked for is instead the label that ``generator`` makes of the target's, as a
    list of one, embedded by ``embedder``; a null label asks for nothing. Without generating, a target without old parents gets no row."""
    scratch = Scratch(taxonomy.spark, "rag")
    scope = taxonomy.filter_by_level(config.candidate_top_level, config.candidate_bottom_level)
    scope = scope if candidates is None else scope.join(candidates.select("id"), "id", "left_semi")
    if config.ret_ignore:
        scope = scope.join(unignored(taxonomy.nodes, config.ret_ignore), "id", "left_semi")
    scope = scratch.keep(scope.select("id"))
    if config.do_generate:
        if generator is None or embedder is None:
            raise ValueError("do_generate needs a generator and an embedder")
        named = targets.select(F.col("id").alias("target")).join(taxonomy.nodes.select(F.col("id").alias("target"), "label"), "target")
        guess = scratch.keep(named.select("target", generator(F.array("label")).alias("guess")).where(F.col("guess").isNotNull()))
        # equal guesses are searched for once
        q = guess.select("guess").distinct().select(F.col("guess").alias("query_id"), embedder(F.col("guess")).alias("embedding"))
        near = scratch.keep(top_k(q, vectors, config.retrieve_size, subset=scope))
        return guess.join(near.select(F.col("query_id").alias("guess"), "id"), "guess").select("target", F.col("id").alias("node")).distinct()
    old = targets.select(F.col("id").alias("src")).join(taxonomy.edges.select("src", "tgt"), "src").distinct()
    q = vectors.join(old.select(F.col("tgt").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")
    near = scratch.keep(top_k(q, vectors, config.retrieve_size, subset=scope))
    return old.join(near.select(F.col("query_id").alias("tgt"), "id"), "tgt").select(F.col("src").alias("target"), F.col("id").alias("node")).distinct()


def select_parents(taxonomy: Taxonomy, candidates: DataFrame, vectors: DataFrame | None, config: MoveConfig, scorer: Scorer | ScoreCache = word_scorer, winners: int = 1) -> DataFrame:
    """(target, node, score, rank): candidates by weighted features. ``parent``: the model's probability that the candidate subsumes the
    target (1 for the root concept). ``siblings``: mean cosine between the target and the candidate's children other than itself, 0 without."""
    if not config.selection_features or len(config.selection_features) != len(config.weights):
        raise ValueError("as many weights as features are needed, and at least one")
    if set(config.selection_features) - {"parent", "siblings"}:
        raise ValueError("features are parent and siblings")
    names = taxonomy.nodes.select("id", "label")
    c = candidates.select("target", "node").distinct()
    c = c.join(names.select(F.col("id").alias("target"), F.col("label").alias("_t")), "target").join(names.select(F.col("id").alias("node"), F.col("label").alias("_n")), "node")
    total = F.lit(0.0)
    for feature, weight in zip(config.selection_features, config.weights):
        if feature == "parent":
            scores = ScoreCache.over(taxonomy.spark, scorer).of(c.select(F.col("_t").alias("sub"), F.col("_n").alias("sup")))
            c = c.join(scores, F.col("_t").eqNullSafe(F.col("sub")) & F.col("_n").eqNullSafe(F.col("sup"))).drop("sub", "sup")
            c = c.withColumn("parent", F.when(F.col("node") == ROOT_ID, 1.0).otherwise(F.coalesce("p", F.lit(0.0)))).drop("p")
        else:
            if vectors is None:
                raise ValueError("the siblings feature needs vectors")
            v = vectors.select(F.col("id").alias("_v"), "embedding")
            kids = taxonomy.edges.select(F.col("tgt").alias("node"), F.col("src").alias("kid")).distinct()
            pairs = c.select("target", "node").join(kids, "node").where(F.col("kid") != F.col("target"))
            pairs = pairs.join(v.withColumnRenamed("embedding", "_a"), F.col("target") == F.col("_v")).drop("_v")
            pairs = pairs.join(v.withColumnRenamed("embedding", "_b"), F.col("kid") == F.col("_v")).drop("_v")
            mean = pairs.groupBy("target", "node").agg(F.avg(cosine(F.col("_a"), F.col("_b"))).alias("siblings"))
            c = c.join(mean, ["target", "node"], "left").fillna(0.0, ["siblings"])
        total = total + F.col(feature) * float(weight)
    w = Window.partitionBy("target").orderBy(F.col("score").desc(), "node")
    return c.withColumn("score", total).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= winners).select("target", "node", "score", "rank")


def predict_moves(
    taxonomy: Taxonomy, targets: DataFrame, vectors: DataFrame | None = None, config: MoveConfig | None = None, scorer: Scorer | ScoreCache = word_scorer,
    generator: Callable[[Column], Column] | None = None, embedder: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(target, new_parents, old_parents, moved): the proposal for every known target but the root concept; without candidates it stays."""
    cfg = config or MoveConfig()
    scratch = Scratch(taxonomy.spark, "predict")
    t = scratch.keep(targets.select("id").distinct().where(F.col("id") != ROOT_ID).join(taxonomy.nodes.select("id"), "id", "left_semi"))
    scorer = ScoreCache.over(taxonomy.spark, scorer)
    found = search_parents(taxonomy, t, cfg, scorer) if cfg.method == "search" else retrieve_parents(taxonomy, t, vectors, cfg, None, generator, embedder)
    old = taxonomy.edges.join(t.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("target"), F.col("tgt").alias("node")).distinct()
    found = scratch.keep(found.unionByName(old).distinct() if cfg.always_include_old else found)
    won = select_parents(taxonomy, found, vectors, cfg, scorer) if cfg.do_select else found
    lists = lambda df, name: df.groupBy("target").agg(F.sort_array(F.collect_set("node")).alias(name))
    out = t.withColumnRenamed("id", "target").join(lists(won, "new_parents"), "target", "left").join(lists(old, "old_parents"), "target", "left")
    none = F.array().cast("array<bigint>")
    olds = F.coalesce("old_parents", none)
    news = F.coalesce("new_parents", olds)
    return out.select("target", news.alias("new_parents"), olds.alias("old_parents"), (news != olds).alias("moved"))


def apply_moves(taxonomy: Taxonomy, moves: DataFrame) -> tuple[Taxonomy, int, int]:
    """The taxonomy with the proposals carried out by edges labelled ``moved``, and the numbers kept and moved. A target whose proposed parents
    would all close a cycle keeps its old ones."""
    scratch = Scratch(taxonomy.spark, "moves")
    m = scratch.keep(moves)
    changed = m.where(F.col("moved"))
    bare = taxonomy.edges.join(changed.select(F.col("target").alias("src")), "src", "left_anti")
    detached = Taxonomy(taxonomy.nodes, scratch.keep(bare), taxonomy.version)
    wanted = changed.select(F.col("target").alias("src"), F.explode("new_parents").alias("tgt")).withColumn("label", F.lit(MOVED))
    after, codes = detached.add_edges(wanted)
    placed = codes.where(F.col("code") >= 0).select("src").distinct()
    stay = changed.select(F.col("target").alias("src")).join(placed, "src", "left_anti")
    back = taxonomy.edges.join(stay, "src", "left_semi")
    kept = Scratch(taxonomy.spark, "taxonomy")
    final = Taxonomy(kept.keep(after.nodes), kept.keep(after.edges.unionByName(back)), taxonomy.version + 1)
    n_moved = placed.count()
    return final, m.count() - n_moved, n_moved

"""Whole runs of the two pipelines: models checked, mode dispatched, results post-processed, a log kept.

``run_insertion`` and ``run_moves`` take a taxonomy, a config and the models, and give a :class:`Run`: the new taxonomy with
``do_update``, the predictions without. Vectors are a frame (id, embedding); where only an embedder is given they are made of the labels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.config import InsertionConfig, MoveConfig, update
from taxograft.functions.models import ScoreCache, Scorer
from taxograft.model import Taxonomy
from taxograft.operators.vectors import VectorStore, top_k
from taxograft.plans import enrich, move
from taxograft.session import Scratch


@dataclass(frozen=True)
class Models:
    """What a run may ask: embeddings of labels, a label for a list of labels, the probability that one label subsumes another."""

    embedder: Callable[[Column], Column] | None = None
    generator: Callable[[Column], Column] | None = None
    scorer: Scorer | ScoreCache | None = None
    vectors: DataFrame | None = None


@dataclass
class Run:
    """``taxonomy`` is null without ``do_update``; ``log`` holds the placements or proposed moves, ``counts`` what was added, or kept and moved."""

    taxonomy: Taxonomy | None
    log: DataFrame | None
    counts: dict[str, int]
    messages: list[tuple[int, str, str]] = field(default_factory=list)


class MissingModel(ValueError):
    """A run lacks a model that its mode needs."""


def shown(setting: bool | int | tuple[str, ...], level: int, kind: str) -> bool:
    """Whether a message is shown: at a level up to a number, always or never for a boolean, or if its kind is listed."""
    if isinstance(setting, bool):
        return setting
    return setting >= level if isinstance(setting, int) else kind in setting


def print_log(run: Run, setting: bool | int | tuple[str, ...] = 1) -> None:
    """Print the messages that the setting shows, indented by their level."""
    for level, kind, text in run.messages:
        if shown(setting, level, kind):
            print("\t" * max(level - 1, 0) + text)


def _need(mode: str, **models: Any) -> None:
    for name, model in models.items():
        if model is None:
            raise MissingModel(f"{name} is required to run {mode}")


def _vectors(taxonomy: Taxonomy, models: Models) -> DataFrame | None:
    """The given vectors, else those of all labels, written once."""
    if models.vectors is not None or models.embedder is None:
        return models.vectors
    made = taxonomy.nodes.where(F.col("label").isNotNull()).select("id", models.embedder(F.col("label")).alias("embedding"))
    return Scratch(taxonomy.spark, "embedded").keep(made)


class IndexCache:
    """Vector stores of taxonomies: one is built at the first call and used again for every taxonomy of the same concepts, whatever its version."""

    def __init__(self, embedder: Callable[[Column], Column]):
        self.embedder = embedder
        self._stores: dict[int, VectorStore] = {}

    def store(self, taxonomy: Taxonomy) -> VectorStore:
        found = self._stores.get(taxonomy.version)
        if found is None or not found.covers(taxonomy.nodes):
            found = next((s for s in self._stores.values() if s.covers(taxonomy.nodes)), None)
            found = found or VectorStore(_vectors(taxonomy, Models(embedder=self.embedder)))
            self._stores[taxonomy.version] = found
        return found

    def clear(self, taxonomy: Taxonomy | None = None) -> None:
        """Forget all stores, or that of one version."""
        if taxonomy is None:
            self._stores.clear()
        else:
            self._stores.pop(taxonomy.version, None)


def _ids(taxonomy: Taxonomy, names: tuple[Any, ...]) -> DataFrame:
    """(place, id) of concepts named by id or by label; of several with one label the smallest. The list is a setting, so it is small."""
    rows = [(i, int(x) if not isinstance(x, str) else None, x if isinstance(x, str) else None) for i, x in enumerate(names)]
    asked = taxonomy.spark.createDataFrame(rows, "place int, id bigint, label string")
    known = taxonomy.nodes.groupBy("label").agg(F.min("id").alias("_id")).withColumnRenamed("label", "_label")
    by_label = asked.where(F.col("label").isNotNull()).join(known, F.col("label") == F.col("_label")).select("place", F.col("_id").alias("id"))
    return asked.where(F.col("id").isNotNull()).select("place", "id").join(taxonomy.nodes.select("id"), "id", "left_semi").select("place", "id").unionByName(by_label)


def _manual(taxonomy: Taxonomy, cfg: InsertionConfig, models: Models) -> tuple[DataFrame, DataFrame | None]:
    """The input concepts (query_id, label) and their bases (query_id, node), null where the whole taxonomy is searched."""
    if not cfg.input_concepts:
        raise ValueError("manual mode needs input_concepts")
    queries = taxonomy.spark.createDataFrame(list(enumerate(cfg.input_concepts)), "query_id bigint, label string")
    if cfg.auto_bases:
        _need("manual mode with auto_bases", embedder=models.embedder)
        vectors = _vectors(taxonomy, models)
        asked = queries.select("query_id", models.embedder(F.col("label")).alias("embedding"))
        near = top_k(asked, vectors, cfg.retrieve_size)
        return queries, Scratch(taxonomy.spark, "bases").keep(near.select("query_id", F.col("id").alias("node")))
    if not cfg.manual_concept_bases:
        return queries, None
    if len(cfg.manual_concept_bases) != len(cfg.input_concepts):
        raise ValueError("as many manual_concept_bases as input_concepts are needed")
    flat = [(q, x) for q, own in enumerate(cfg.manual_concept_bases) for x in own]
    found = _ids(taxonomy, tuple(x for _, x in flat))
    owner = taxonomy.spark.createDataFrame([(i, q) for i, (q, _) in enumerate(flat)] or [(-1, -1)], "place int, query_id bigint")
    return queries, found.join(owner, "place").select("query_id", F.col("id").alias("node"))


def _merge(a: enrich.Placement, b: enrich.Placement) -> enrich.Placement:
    return enrich.Placement(a.log.unionByName(b.log), a.queries.unionByName(b.queries))


def run_insertion(taxonomy: Taxonomy, models: Models, config: InsertionConfig | None = None, **changes: Any) -> Run:
    """Enrich the taxonomy: ``auto`` from its leaves, ``semiauto`` from ``semiauto_seeds``, ``manual`` with ``input_concepts``. The edges it had
    before are all there again at the end. ``changes`` are settings on top of the config."""
    cfg = update(config or InsertionConfig(), **changes)
    run = Run(None, None, {})
    say = lambda level, kind, text: run.messages.append((level, kind, text))
    say(1, "system", f"Enrichment in {cfg.mode} mode")
    if cfg.mode not in ("auto", "semiauto", "manual"):
        raise ValueError(f"unknown mode {cfg.mode}")
    classes = links = 0
    if cfg.mode == "manual":
        _need("manual mode", scorer=models.scorer)
        queries, bases = _manual(taxonomy, cfg, models)
        if bases is None:
            placement = enrich.place(taxonomy, queries, None, cfg, models.scorer)
        else:
            based = queries.join(bases.select("query_id"), "query_id", "left_semi")
            placement = enrich.place(taxonomy, based, bases, cfg, models.scorer)
            free = queries.join(bases.select("query_id"), "query_id", "left_anti")
            if not free.isEmpty():
                placement = _merge(placement, enrich.place(taxonomy, free, None, cfg, models.scorer))
    else:
        vectors = _vectors(taxonomy, models)
        _need(f"{cfg.mode} mode", embedder=models.embedder or vectors, generator=models.generator, scorer=models.scorer)
        if cfg.mode == "auto" and cfg.do_update:
            after, classes, links = enrich.enrich_auto(taxonomy, vectors, models.generator, cfg, models.scorer)
            placement = None
        else:
            if cfg.mode == "semiauto":
                if not cfg.semiauto_seeds:
                    raise ValueError("semiauto mode needs semiauto_seeds")
                seeds = _ids(taxonomy, cfg.semiauto_seeds).select("id").distinct()
            else:
                seeds = taxonomy.leaves()
                if cfg.max_outer_loop:
                    seeds = seeds.orderBy(F.md5(F.concat_ws("|", "id", F.lit(str(cfg.rand_seed)))), "id").limit(cfg.max_outer_loop)
            placement = enrich.enrich_seeds(taxonomy, seeds, vectors, models.generator, cfg, models.scorer)
    if placement is not None:
        run.log = placement.log
        if cfg.do_update:
            after, classes, links = enrich.finish(taxonomy, *enrich.insert(taxonomy, placement), cfg.transitive_reduction)
    if cfg.do_update:
        run.taxonomy, run.counts = after, {"classes": classes, "subsumptions": links}
        say(1, "system", f"Added {classes} new classes and {links} new direct subsumptions")
    if run.log is not None and not cfg.do_update:
        say(1, "system", "Predictions only")
    if shown(cfg.logging, 3, "inner_loop") and not isinstance(cfg.logging, bool) and run.log is not None:
        for r in run.log.groupBy("role").count().orderBy("role").collect():
            say(3, "inner_loop", f"{r['role']}: {r['count']}")
    print_log(run, cfg.logging)
    return run


def run_moves(taxonomy: Taxonomy, models: Models, config: MoveConfig | None = None, **changes: Any) -> Run:
    """Re-home categories: the leaves in ``auto`` mode, ``input_concepts`` in ``manual`` mode, by ``search`` or by retrieval (``rag``). Unknown targets
    and the root concept are left where they are."""
    cfg = update(config or MoveConfig(), **changes)
    run = Run(None, None, {})
    say = lambda level, kind, text: run.messages.append((level, kind, text))
    say(1, "system", f"Category move in {cfg.mode} mode by {cfg.method}")
    if cfg.method not in ("search", "rag"):
        raise ValueError(f"unknown method {cfg.method}")
    _need(f"the {cfg.method} method", scorer=models.scorer)
    wants = cfg.method == "rag" or "siblings" in cfg.selection_features
    vectors = _vectors(taxonomy, models) if wants else None
    if wants:
        _need(f"the {cfg.method} method" if cfg.method == "rag" else "the siblings feature", embedder=models.embedder or vectors)
    if cfg.method == "rag" and cfg.do_generate:
        _need("do_generate", generator=models.generator, embedder=models.embedder)
    if cfg.mode == "auto":
        targets = move.auto_targets(taxonomy, cfg)
    elif cfg.mode == "manual":
        if not cfg.input_concepts:
            raise ValueError("manual mode needs input_concepts")
        targets = _ids(taxonomy, cfg.input_concepts).select("id").distinct()
    else:
        raise ValueError(f"unknown mode {cfg.mode}")
    found = move.predict_moves(taxonomy, targets, vectors, cfg, models.scorer, models.generator, models.embedder)
    run.log = Scratch(taxonomy.spark, "moves").keep(found)
    if cfg.do_update:
        run.taxonomy, kept, moved = move.apply_moves(taxonomy, run.log)
        run.counts = {"kept": kept, "moved": moved}
        say(1, "system", f"Moved {moved} concepts and kept {kept}")
    else:
        say(1, "system", "Predictions only")
    print_log(run, cfg.logging)
    return run


def with_vectors(models: Models, vectors: DataFrame) -> Models:
    """The models with ready vectors, which spares embedding the taxonomy again."""
    return replace(models, vectors=vectors)

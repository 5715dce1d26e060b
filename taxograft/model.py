"""The taxonomy: immutable node and edge frames with lookups, edits and validation.

nodes (id bigint, label string, attrs map<string,string>); edges (src bigint child, tgt bigint parent, label string, attrs). Every edit
returns a new taxonomy, so an undo stack is a list of taxonomies.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograft.operators import closure as cl
from taxograft.operators import lattice, space

ATTRS = "map<string,string>"
NODE_SCHEMA = f"id bigint, label string, attrs {ATTRS}"
EDGE_SCHEMA = f"src bigint, tgt bigint, label string, attrs {ATTRS}"
ROOT_ID, ROOT_LABEL = 0, "Root Concept"
ORIGINAL, AUTO, NEW, MOVED = "original", "auto", "new", "moved"


class CycleError(ValueError):
    """An edit or input would make a node its own ancestor."""


def _shape(df: DataFrame, schema: str) -> DataFrame:
    out = []
    for field in schema.split(", "):
        name, kind = field.split(" ", 1)
        out.append(F.col(name).cast(kind).alias(name) if name in df.columns else F.lit(None).cast(kind).alias(name))
    return df.select(*out)


def _merged(a: str, b: str) -> F.Column:
    """The newer attributes over the older ones."""
    old, new = F.coalesce(a, F.create_map().cast(ATTRS)), F.coalesce(b, F.create_map().cast(ATTRS))
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return F.map_concat(kept, new)


class Taxonomy:
    def __init__(self, nodes: DataFrame, edges: DataFrame, version: int = 0):
        self.nodes, self.edges, self.version = _shape(nodes, NODE_SCHEMA), _shape(edges, EDGE_SCHEMA), version
        self.spark: SparkSession = self.nodes.sparkSession
        self._closures: dict = {}

    # -- derived relations, computed once per version

    def closure(self, labels: Iterable[str] | None = None) -> DataFrame:
        key = None if labels is None else tuple(sorted([labels] if isinstance(labels, str) else labels))
        if key not in self._closures:
            self._closures[key] = cl.closure(self.edges, key)
        return self._closures[key]

    @cached_property
    def levels(self) -> DataFrame:
        return cl.levels(self.nodes, self.edges)

    @cached_property
    def reverse_levels(self) -> DataFrame:
        return cl.reverse_levels(self.nodes, self.edges)

    def roots(self) -> DataFrame:
        return cl.roots(self.nodes, self.edges)

    def leaves(self) -> DataFrame:
        return cl.leaves(self.nodes, self.edges)

    # -- lookups: queries are (query_id, node)

    def parents(self, queries: DataFrame, labels: Iterable[str] | None = None) -> DataFrame:
        e = cl.edges_with(self.edges, labels).select(F.col("src").alias("node"), F.col("tgt").alias("parent"))
        return queries.select("query_id", "node").join(e, "node").select("query_id", "node", "parent").distinct()

    def children(self, queries: DataFrame, labels: Iterable[str] | None = None) -> DataFrame:
        e = cl.edges_with(self.edges, labels).select(F.col("tgt").alias("node"), F.col("src").alias("child"))
        return queries.select("query_id", "node").join(e, "node").select("query_id", "node", "child").distinct()

    def ancestors(self, queries: DataFrame, labels: Iterable[str] | None = None, max_depth: int | None = None) -> DataFrame:
        c = self.closure(labels)
        c = c if max_depth is None else c.where(F.col("dist") <= max_depth)
        return queries.select("query_id", "node").join(c, "node").select("query_id", "node", "anc", "dist")

    def descendants(self, queries: DataFrame, labels: Iterable[str] | None = None, max_depth: int | None = None) -> DataFrame:
        c = self.closure(labels).select(F.col("anc").alias("node"), F.col("node").alias("desc"), "dist")
        c = c if max_depth is None else c.where(F.col("dist") <= max_depth)
        return queries.select("query_id", "node").join(c, "node").select("query_id", "node", "desc", "dist")

    def siblings(self, queries: DataFrame) -> DataFrame:
        return space.siblings(queries, self.edges)

    def labels_of(self, queries: DataFrame) -> DataFrame:
        """``queries`` with the label; unknown nodes have a null ``known``."""
        n = self.nodes.select(F.col("id").alias("node"), "label", F.lit(True).alias("known"))
        return queries.join(n, "node", "left")

    def edge_labels_of(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.edges.select("src", "tgt", F.col("label")), ["src", "tgt"], "left")

    def lca(self, sets: DataFrame, labels: Iterable[str] | None = None) -> DataFrame:
        return lattice.lca(sets, self.closure(labels), self.nodes)

    def gcd(self, sets: DataFrame, labels: Iterable[str] | None = None) -> DataFrame:
        return lattice.gcd(sets, self.closure(labels), self.nodes)

    def reduce_subset(self, sets: DataFrame, most_general: bool = False) -> DataFrame:
        return lattice.reduce_subset(sets, self.closure(), most_general)

    def wu_palmer(self, pairs: DataFrame) -> DataFrame:
        return lattice.wu_palmer(pairs, self.closure(), self.nodes, self.levels)

    def subsumes(self, pairs: DataFrame) -> DataFrame:
        return lattice.subsumes(pairs, self.closure())

    def breadcrumbs(self) -> DataFrame:
        return lattice.breadcrumbs(self.closure(), self.nodes)

    def filter_by_level(self, top: int = 0, bottom: int = 0) -> DataFrame:
        return cl.filter_by_level(self.nodes, self.edges, top, bottom)

    def subgraph(self, ids: DataFrame) -> Taxonomy:
        """The induced subgraph on ``ids`` (id)."""
        return self._next(self.nodes.join(ids.select("id").distinct(), "id", "left_semi"), space.induced(ids, self.edges))

    def transitive_reduction(self) -> Taxonomy:
        return self._next(self.nodes, lattice.transitive_reduction(self.edges, self.closure()))

    # -- edits

    def _next(self, nodes: DataFrame, edges: DataFrame) -> Taxonomy:
        return type(self)(nodes, edges, self.version + 1)

    def add_nodes(self, new: DataFrame) -> tuple[Taxonomy, DataFrame]:
        """The taxonomy with the nodes inserted or their attributes merged, and (id, code): 0 inserted, 1 nothing changed, 2 merged.

        A null id is an error. Of repeated ids the row with the smallest label counts."""
        new = _shape(new, NODE_SCHEMA)
        if new.where(F.col("id").isNull()).limit(1).count():
            raise ValueError("a node needs an id")
        new = new.groupBy("id").agg(F.min(F.struct(F.col("label"), F.to_json("attrs").alias("a"))).alias("s")).select(
            "id", F.col("s.label").alias("new_label"), F.from_json("s.a", ATTRS).alias("new_attrs")
        )
        both = self.nodes.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), "id", "full")
        label = F.coalesce("new_label", "label")
        attrs = _merged("attrs", "new_attrs")
        same = F.col("label").eqNullSafe(label) & (F.to_json(F.array_sort(F.map_entries(attrs))) == F.to_json(F.array_sort(F.map_entries(_merged("attrs", "attrs")))))
        code = F.when(F.col("_old").isNull(), 0).when(same, 1).otherwise(2)
        codes = both.where(F.col("_new")).select("id", code.cast("int").alias("code"))
        return self._next(both.select("id", label.alias("label"), attrs.alias("attrs")), self.edges), codes

    def add_edges(self, new: DataFrame) -> tuple[Taxonomy, DataFrame]:
        """The taxonomy with the edges added and missing ends created, and (src, tgt, code): 0 added, 1 it stood already (attributes
        merged), -1 rejected because it would close a cycle with the existing edges.

        New edges that only close a cycle among themselves are found by a check of the result: then all that lie on such a
        cycle are rejected, so the answer depends on no order."""
        new = _shape(new, EDGE_SCHEMA)
        new = new.groupBy("src", "tgt").agg(F.min(F.struct(F.col("label"), F.to_json("attrs").alias("a"))).alias("s")).select(
            "src", "tgt", F.col("s.label").alias("new_label"), F.from_json("s.a", ATTRS).alias("new_attrs")
        )
        above = lattice.with_self(self.closure(), self.nodes).select(F.col("node").alias("tgt"), F.col("anc").alias("src"))
        closing = new.select("src", "tgt").join(above, ["src", "tgt"], "left_semi").unionByName(new.where(F.col("src") == F.col("tgt")).select("src", "tgt")).distinct()
        fine = new.join(closing, ["src", "tgt"], "left_anti")
        union = self.edges.select("src", "tgt").unionByName(fine.select("src", "tgt"))
        caught = cl.cyclic_edges(union)
        inner = cl.closure(caught) if not caught.isEmpty() else None
        if inner is not None:
            loop = inner.where(F.col("node") == F.col("anc")).select(F.col("node").alias("src"))
            back = inner.select(F.col("node").alias("tgt"), F.col("anc").alias("src"))
            among = caught.join(back, ["src", "tgt"], "left_semi").join(loop, "src", "left_semi")
            closing = closing.unionByName(fine.select("src", "tgt").join(among, ["src", "tgt"], "left_semi")).distinct()
            fine = new.join(closing, ["src", "tgt"], "left_anti")
        both = self.edges.withColumn("_old", F.lit(True)).join(fine.withColumn("_new", F.lit(True)), ["src", "tgt"], "full")
        edges = both.select("src", "tgt", F.coalesce("new_label", "label").alias("label"), _merged("attrs", "new_attrs").alias("attrs"))
        codes = both.where(F.col("_new")).select("src", "tgt", F.when(F.col("_old").isNull(), 0).otherwise(1).cast("int").alias("code"))
        codes = codes.unionByName(closing.withColumn("code", F.lit(-1)))
        ends = fine.select(F.explode(F.array("src", "tgt")).alias("id")).distinct().join(self.nodes.select("id"), "id", "left_anti")
        return self._next(self.nodes.unionByName(_shape(ends, NODE_SCHEMA)), edges), codes

    def remove_nodes(self, ids: DataFrame) -> Taxonomy:
        """Without the nodes and their edges; children are not attached elsewhere."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "tgt"), "tgt", "left_anti")
        return self._next(self.nodes.join(gone, "id", "left_anti"), edges)

    def remove_edges(self, pairs: DataFrame) -> Taxonomy:
        """Without the edges; one that does not exist is an error."""
        p = pairs.select("src", "tgt").distinct()
        if not p.join(self.edges, ["src", "tgt"], "left_anti").isEmpty():
            raise KeyError("an edge to remove does not exist")
        return self._next(self.nodes, self.edges.join(p, ["src", "tgt"], "left_anti"))

    def set_labels(self, labels: DataFrame) -> Taxonomy:
        """With the labels of (id, label) put in place of the old ones."""
        return self.add_nodes(labels.select("id", "label"))[0]

    def set_edge_labels(self, labels: DataFrame) -> Taxonomy:
        new = labels.groupBy("src", "tgt").agg(F.min("label").alias("_l"))
        e = self.edges.join(new, ["src", "tgt"], "left").withColumn("label", F.coalesce("_l", "label")).drop("_l")
        return self._next(self.nodes, e)

    def next_id(self) -> int:
        """The id after the largest."""
        return (self.nodes.agg(F.max("id")).first()[0] or 0) + 1

    def attach_root(self) -> Taxonomy:
        """With every node without a parent under the root concept (id 0), by edges labelled ``auto``."""
        tops = self.roots().where(F.col("id") != ROOT_ID)
        own = self.nodes.where(F.col("id") == ROOT_ID)
        root = self.spark.createDataFrame([(ROOT_ID, ROOT_LABEL, None)], NODE_SCHEMA).join(own.select("id"), "id", "left_anti")
        new = tops.select(F.col("id").alias("src"), F.lit(ROOT_ID).alias("tgt"), F.lit(AUTO).alias("label"))
        # an edge out of the root concept would make it no root
        edges = self.edges.where(F.col("src") != ROOT_ID)
        return self._next(self.nodes.unionByName(root), edges.unionByName(_shape(new, EDGE_SCHEMA)))

    # -- validation and statistics

    def stats(self) -> DataFrame:
        """One row: nodes, edges, roots, leaves."""
        one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        rows = one(self.nodes, "nodes").unionByName(one(self.edges, "edges")).unionByName(one(self.roots(), "roots")).unionByName(one(self.leaves(), "leaves"))
        pick = lambda w: F.max(F.when(F.col("what") == w, F.col("n"))).alias(f"n_{w}")
        return rows.agg(pick("nodes"), pick("edges"), pick("roots"), pick("leaves"))

    def validate(self) -> DataFrame:
        """(finding, severity, id): nodes on or between cycles, nodes without a label, orphans (no edge at all, the root concept aside)."""
        row = lambda df, f, s: df.select(F.lit(f).alias("finding"), F.lit(s).alias("severity"), F.col("id"))
        caught = cl.cyclic_edges(self.edges)
        cyc = caught.select(F.explode(F.array("src", "tgt")).alias("id")).distinct()
        blank = self.nodes.where(F.coalesce("label", F.lit("")) == "").select("id")
        touched = self.edges.select(F.explode(F.array("src", "tgt")).alias("id")).distinct()
        lone = self.nodes.where(F.col("id") != ROOT_ID).select("id").join(touched, "id", "left_anti")
        return row(cyc, "cycle", "error").unionByName(row(blank, "missing_label", "warning")).unionByName(row(lone, "orphan", "warning"))

    def require_acyclic(self) -> Taxonomy:
        if not cl.is_acyclic(self.edges):
            raise CycleError("the edges hold a cycle")
        return self


class TreeTaxonomy(Taxonomy):
    """A taxonomy with at most one parent per node."""

    def require_tree(self) -> TreeTaxonomy:
        many = self.edges.select("src", "tgt").distinct().groupBy("src").count().where(F.col("count") > 1)
        if not many.isEmpty():
            raise ValueError("a node of a tree has two parents")
        self.require_acyclic()
        return self

    def add_edges(self, new: DataFrame, overwrite: bool = False) -> tuple[Taxonomy, DataFrame]:
        """As in a taxonomy; a second parent is an error, or with ``overwrite`` takes the place of the first."""
        old = self.edges.select("src", F.col("tgt").alias("_t"))
        second = new.select("src", "tgt").distinct().join(old, "src").where(F.col("tgt") != F.col("_t"))
        if new.select("src", "tgt").distinct().groupBy("src").count().where(F.col("count") > 1).limit(1).count():
            raise ValueError("two parents for one node of a tree")
        if second.limit(1).count():
            if not overwrite:
                raise ValueError("a node of a tree has a parent already")
            return self.remove_edges(second.select("src", F.col("_t").alias("tgt"))).add_edges(new)
        return super().add_edges(new)

    def remove_nodes(self, ids: DataFrame) -> Taxonomy:
        if not ids.join(self.roots(), "id", "left_semi").isEmpty():
            raise ValueError("the root of a tree can't be removed")
        return super().remove_nodes(ids)

    def depth(self) -> DataFrame:
        """(id, depth): the number of ancestors."""
        n = self.closure().groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("depth"))
        return self.nodes.select("id").join(n, "id", "left").fillna(0, ["depth"])


class EditSession:
    """A taxonomy under edit with an undo stack of earlier versions."""

    def __init__(self, taxonomy: Taxonomy, keep: int = 20):
        self.current, self.keep, self.dirty = taxonomy, keep, False
        self._undo: list[Taxonomy] = []

    def apply(self, after: Taxonomy) -> Taxonomy:
        self._undo = [*self._undo, self.current][-self.keep :]
        self.current, self.dirty = after, True
        return after

    def undo(self) -> bool:
        """Back to the version before; false when there is none."""
        if not self._undo:
            return False
        self.current, self.dirty = self._undo.pop(), True
        return True

    def save(self, path: str) -> None:
        """Write the current version, as JSON to a path ending in ``.json``, else as tables into a folder; the session is then no longer dirty."""
        from taxograft.sources import taxonomies

        (taxonomies.to_json if path.endswith(".json") else taxonomies.save_tables)(self.current, path)
        self.dirty = False

    def _frame(self, rows: list, schema: str) -> DataFrame:
        return self.current.spark.createDataFrame(rows, schema)

    def rename(self, node: int, label: str) -> Taxonomy:
        return self.apply(self.current.set_labels(self._frame([(node, label)], "id bigint, label string")))

    def add_node(self, label: str, parent: int | None = None) -> int:
        new = self.current.next_id()
        after = self.current.add_nodes(self._frame([(new, label)], "id bigint, label string"))[0]
        if parent is not None:
            after = after.add_edges(self._frame([(new, parent, ORIGINAL)], "src bigint, tgt bigint, label string"))[0]
        self.apply(after)
        return new

    def add_edge(self, src: int, tgt: int) -> Taxonomy:
        after, codes = self.current.add_edges(self._frame([(src, tgt, ORIGINAL)], "src bigint, tgt bigint, label string"))
        if codes.where(F.col("code") == -1).limit(1).count():
            raise CycleError(f"{src} already subsumes {tgt}")
        return self.apply(after)

    def remove_node(self, node: int) -> Taxonomy:
        return self.apply(self.current.remove_nodes(self._frame([(node,)], "id bigint")))

    def remove_edge(self, src: int, tgt: int) -> Taxonomy:
        return self.apply(self.current.remove_edges(self._frame([(src, tgt)], "src bigint, tgt bigint")))

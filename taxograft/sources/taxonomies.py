"""Sources and sinks of taxonomies: JSON, OWL/RDF, level and breadcrumb tables, merged tables, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograft.model import ATTRS, ORIGINAL, Taxonomy, TreeTaxonomy
from taxograft.operators.lattice import transitive_reduction
from taxograft.operators.numbering import latest_before
from taxograft.sources import rdf
from taxograft.session import Scratch

_VARIANT_MAP = "map<string,variant>"


def _split_attrs(raw: DataFrame, required: list[str], extra_label: bool) -> DataFrame:
    """Fixed fields out of a column ``o`` of JSON objects (map of variants), the rest as JSON fragments in attrs."""
    fixed = [*required, *(["label"] if extra_label and "label" not in required else [])]
    ids = [c for c in required if c != "label"]
    get = lambda c: F.element_at("o", c)
    cols = [F.try_variant_get(get(c), "$", "bigint").alias(c) for c in ids]
    label = F.try_variant_get(get("label"), "$", "string").alias("label")
    rest = F.map_filter("o", lambda k, _: ~k.isin(*fixed))
    attrs = F.transform_values(rest, lambda _, v: F.to_json(v)).alias("attrs")
    return raw.select(*cols, label, attrs)


def from_json(spark: SparkSession, path: str, as_tree: bool = False) -> Taxonomy:
    """``{"nodes": [{id, label, ...}], "edges": [{src, tgt, label?, ...}]}``; src is the child.

    A missing or non-integer id, label, src or tgt, an edge end without a node's id given twice, or a cycle is an error. Nodes without a
    parent are attached to the root concept. Further fields round-trip through ``attrs``.
    """
    text = spark.read.option("wholetext", True).text(path)
    whole = text.select(F.from_json("value", f"nodes array<{_VARIANT_MAP}>, edges array<{_VARIANT_MAP}>", {"mode": "FAILFAST"}).alias("t"))
    nodes = _split_attrs(whole.select(F.explode("t.nodes").alias("o")), ["id", "label"], True)
    edges = _split_attrs(whole.select(F.explode("t.edges").alias("o")), ["src", "tgt"], True)
    if not nodes.where(F.col("id").isNull() | F.col("label").isNull()).isEmpty():
        raise ValueError("every node needs an integer id and a label")
    if not edges.where(F.col("src").isNull() | F.col("tgt").isNull()).isEmpty():
        raise ValueError("every edge needs integer src and tgt")
    scratch = Scratch(spark, "json")
    nodes, edges = scratch.keep(nodes), scratch.keep(edges)
    nodes = nodes.groupBy("id").agg(F.max_by("label", F.struct("label")).alias("label"), F.max_by("attrs", F.struct("label")).alias("attrs"))
    edges = edges.groupBy("src", "tgt").agg(F.max("label").alias("label"), F.max_by("attrs", F.struct(F.coalesce("label", F.lit("")))).alias("attrs"))
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    nodes = nodes.unionByName(ends.select("id", F.lit(None).cast("string").alias("label"), F.lit(None).cast(ATTRS).alias("attrs")))
    made = (TreeTaxonomy if as_tree else Taxonomy)(nodes, edges).require_acyclic().attach_root()
    return made.require_tree() if as_tree else made


def to_json_rows(taxonomy: Taxonomy) -> DataFrame:
    """(value): one JSON object per node and edge, ``{"kind": "node" | "edge", ...}``. Scales where one document would not."""

    def one(df: DataFrame, fixed: list[str], kind: str) -> DataFrame:
        # attrs hold JSON fragments already
        pairs = F.transform(F.array_sort(F.map_entries(F.coalesce("attrs", F.create_map().cast(ATTRS)))), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), e["value"]))
        tail = F.array_join(F.transform(pairs, lambda p: F.regexp_replace(p, r"^\[(.*?)\]:", "$1:")), ",")
        head = F.regexp_replace(F.to_json(F.struct(*fixed)), r"\}$", "")
        return df.select(F.lit(kind).alias("kind"), F.concat(head, F.when(tail != "", F.concat(F.lit(","), tail)).otherwise(""), F.lit("}")).alias("value"))

    return one(taxonomy.nodes, ["id", "label"], "node").unionByName(one(taxonomy.edges, ["src", "tgt", "label"], "edge"))


def to_json_string(taxonomy: Taxonomy) -> str:
    """The whole taxonomy as one JSON document, on the driver: for downloads of taxonomies that fit there."""
    nodes, edges = [], []
    for row in to_json_rows(taxonomy).orderBy("kind", "value").toLocalIterator():
        (nodes if row["kind"] == "node" else edges).append(row["value"])
    return '{"nodes": [' + ",\n".join(nodes) + '],\n"edges": [' + ",\n".join(edges) + "]}"


def to_json(taxonomy: Taxonomy, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(to_json_string(taxonomy))


def save_tables(taxonomy: Taxonomy, folder: str) -> None:
    """Nodes and edges as Parquet, for taxonomies of any size."""
    taxonomy.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    taxonomy.edges.write.mode("overwrite").parquet(f"{folder}/edges")


def load_tables(spark: SparkSession, folder: str) -> Taxonomy:
    return Taxonomy(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


def iri_id(iri: Column) -> Column:
    """The integer after the # of an IRI, else null."""
    return F.try_to_number(F.regexp_extract(iri, "#([0-9]+)$", 1), F.lit("9" * 18)).cast("bigint")


def link_iri(iris: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """``iris`` (iri) with the node id of each known IRI; unknown ones have a null id."""
    known = taxonomy.nodes.select("id")
    coded = iris.withColumn("_id", iri_id(F.col("iri")))
    return coded.join(known, coded["_id"] == known["id"], "left").drop("_id")


def from_owl(spark: SparkSession, path: str) -> Taxonomy:
    """The classes of an RDF/XML, Turtle or N-Triples file, by their labels and ``rdfs:subClassOf`` links.

    Keeps the classes reachable from owl:Thing, which becomes node 0; ids are the integers after #, a class without one is an error; the
    smallest label counts, the fragment where there is none. Implied edges are removed, the others are ``original``.
    """
    scratch = Scratch(spark, "owl")
    t = scratch.keep(rdf.triples(spark, path).where(F.col("p").endswith("subClassOf") | F.col("p").endswith("#label")).distinct())
    thing = "http://www.w3.org/2002/07/owl#Thing"
    ident = lambda c: F.when(F.col(c).isin(thing, "owl:Thing"), F.lit(0).cast("bigint")).otherwise(iri_id(F.col(c)))
    # superclasses without a name (restrictions and the like) are no nodes
    sub = t.where(F.col("p").endswith("subClassOf") & ~F.col("o").startswith("_:") & ~F.col("s").startswith("_:")).select("s", "o")
    named = t.where(F.col("p").endswith("label") & F.col("literal")).groupBy("s").agg(F.min("o").alias("label"))
    linked = scratch.keep(sub.select(F.col("s"), ident("s").alias("src"), ident("o").alias("tgt")))
    edges = linked.where(F.col("src").isNotNull() & F.col("tgt").isNotNull()).select("src", "tgt", F.lit(ORIGINAL).alias("label")).distinct()
    from taxograft.operators.closure import closure

    closed = closure(edges)
    inside = closed.where(F.col("anc") == 0).select(F.col("node").alias("id")).distinct()
    zero = spark.createDataFrame([(0,)], "id bigint")
    keep = inside.unionByName(zero).distinct()
    if not linked.where(F.col("src").isNull() & F.col("s").isNotNull() & F.col("tgt").isNotNull()).isEmpty():
        raise ValueError("a class has no integer after # in its IRI")
    labels = named.select(ident("s").alias("id"), "label").where(F.col("id").isNotNull()).groupBy("id").agg(F.min("label").alias("label"))
    nodes = keep.join(labels, "id", "left").select("id", F.coalesce("label", F.when(F.col("id") == 0, F.lit("Thing")).otherwise(F.col("id").cast("string"))).alias("label"))
    from taxograft.operators.space import induced

    return Taxonomy(nodes, transitive_reduction(induced(keep, edges), closed))


def to_owl(taxonomy: Taxonomy, path: str, base: str = "http://taxograft.example/taxonomy") -> None:
    """RDF/XML as text files in a folder: a header, one class per line, a footer. The root concept is owl:Thing."""
    esc = F.col("label")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    iri = lambda c: F.when(c == 0, F.lit("http://www.w3.org/2002/07/owl#Thing")).otherwise(F.concat(F.lit(base + "#"), c.cast("string")))
    ups = taxonomy.edges.groupBy(F.col("src").alias("id")).agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit('<rdfs:subClassOf rdf:resource="'), iri(F.col("tgt")), F.lit('"/>')))), "").alias("ups"))
    body = taxonomy.nodes.where(F.col("id") != 0).join(ups, "id", "left").select(
        F.concat(F.lit('<owl:Class rdf:about="'), iri(F.col("id")), F.lit('"><rdfs:label>'), F.coalesce(esc, F.lit("")), F.lit("</rdfs:label>"), F.coalesce("ups", F.lit("")), F.lit("</owl:Class>")).alias("value"), F.lit(1).alias("o")
    )
    head = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
    frame = taxonomy.spark.createDataFrame([(head, 0), ("</rdf:RDF>", 2)], "value string, o int")
    body.unionByName(frame).repartition(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, as_tree: bool = False) -> Taxonomy:
    """By suffix: .owl, .rdf, .ttl, .n3, .nt or .json; another suffix is an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("owl", "rdf", "ttl", "n3", "nt"):
        return from_owl(spark, path)
    if suffix == "json":
        return from_json(spark, path, as_tree)
    raise ValueError(f"no source for .{suffix} files")


def level_table(rows: DataFrame, levels: list[str], order: str, key: str = "CategoryID", part: str | None = None) -> DataFrame:
    """(key, name, level, parent) of a table whose first non-empty column among ``levels`` holds a row's name, its place the level.

    Rows are read in the numeric ``order``, per ``part`` (a file or site), stretch by stretch, so that no file is sorted in one task. The running breadcrumb is cut to level - 1
    before each row, so a row that skips a level hangs under the last id above it; 0 at the top.
    """
    filled = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    level = F.coalesce(*[F.when(filled(c), F.lit(i)) for i, c in enumerate(levels, 1)])
    name = F.coalesce(*[F.when(filled(c), F.col(c)) for c in levels])
    base = rows.select(F.col(key).cast("bigint").alias("key"), name.alias("name"), level.alias("level"), F.col(order).alias("_o"), (F.col(part) if part else F.lit("")).cast("string").alias("_p"))

    # the parent is the latest earlier row of a smaller level; one running maximum per level, whatever the number of rows
    seen = {f"_l{i}": F.when(F.col("level") == i, F.struct("_o", F.col("key"))) for i in range(1, len(levels))}
    out = latest_before(base.where(F.col("level").isNotNull()), "_o", seen, "_p")
    best = F.lit(None).cast("struct<_o:bigint,key:bigint>")
    for i in range(1, len(levels)):
        cand = F.when(F.col("level") > i, F.col(f"_l{i}"))
        cand = F.when(cand.isNotNull(), F.struct(cand["_o"].cast("bigint").alias("_o"), cand["key"].alias("key")))
        best = F.greatest(best, cand)
    return out.select("key", "name", "level", F.coalesce(best["key"], F.lit(0)).alias("parent"))


def breadcrumb_table(rows: DataFrame) -> DataFrame:
    """(key, label, level, parent, leaf, meta, test, other) from breadcrumb rows (site_id, cat_id, cat_name, cfn, id_breadcrumb, ...).

    The label is cfn, else cat_name; the level the number of ids; the parent ``site_id_id`` of the last id but one, else ``site_id``.
    """
    ids = F.expr("filter(transform(split(id_breadcrumb, '>'), x -> trim(x)), x -> x <> '')")
    site = F.col("site_id").cast("string")
    return rows.select(
        F.concat_ws("_", "site_id", "cat_id").alias("key"),
        F.coalesce("cfn", "cat_name").alias("label"),
        F.coalesce(F.size(ids), F.lit(0)).cast("bigint").alias("level"),
        F.when(F.size(ids) >= 2, F.concat(site, F.lit("_"), F.try_element_at(ids, F.lit(-2)))).otherwise(site).alias("parent"),
        (F.lower("parent_leaf") == "leaf").alias("leaf"),
        "meta",
        (F.col("test_cat") == "Y").alias("test"),
        (F.col("other") == "Y").alias("other"),
    )


def merge_tables(main: DataFrame, extra: list[DataFrame], on: str = "Key", take: str = "Other Category") -> DataFrame:
    """``main`` left-joined with the rows of the further tables whose ``take`` is not null."""
    rows = None
    for df in extra:
        one = df.select(on, take).where(F.col(take).isNotNull())
        rows = one if rows is None else rows.unionByName(one)
    return main if rows is None else main.join(rows, on, "left")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def write_training_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; array columns as JSON."""
    cols = [F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, escape='"')


def human_size(n: Column) -> Column:
    """Bytes as text: base 1024, at most two decimals, no blank before the unit; ``0B`` for none."""
    units = [F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "PB")]
    i = F.least(F.lit(len(units) - 1), F.floor(F.log(2.0, F.greatest(n, F.lit(1))) / 10 + 1e-12)).cast("int")
    value = F.round(n / F.pow(F.lit(1024.0), i), 2)
    return F.when(n == 0, F.lit("0B")).otherwise(F.concat(value.cast("string"), F.element_at(F.array(*units), i + 1)))

"""A taxonomy kept up to date by a stream of edits.

Edits are (seq bigint, op string, id bigint, src bigint, tgt bigint, label string); op is one of add_node, set_label, remove_node,
add_edge, remove_edge. Each micro-batch applies as if its edits came one by one in the order of ``seq``, and writes
a new version of the tables; then the file ``current`` beside them is pointed at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograft.model import EDGE_SCHEMA, NODE_SCHEMA, Taxonomy
from taxograft.session import Scratch
from taxograft.sources.taxonomies import load_tables, save_tables

EDIT_SCHEMA = "seq bigint, op string, id bigint, src bigint, tgt bigint, label string"


def apply_batch(taxonomy: Taxonomy, edits: DataFrame) -> Taxonomy:
    """The taxonomy after a batch. Of several edits of one node or edge the one with the largest seq counts; a removed node takes the edges set
    before its removal with it, those set later stay; edges that would close a cycle are skipped; removals of what does not exist do nothing;
    null keys are ignored."""
    is_node = F.col("op").isin("add_node", "set_label", "remove_node")
    last = lambda df, *keys: df.groupBy(*keys).agg(F.max_by(F.struct("op", "label", "seq"), "seq").alias("e")).select(*keys, "e.op", "e.label", "e.seq")
    node_edits = edits.where(is_node & F.col("id").isNotNull())
    nodes = last(node_edits, "id")
    links = last(edits.where(~is_node & F.col("src").isNotNull() & F.col("tgt").isNotNull()), "src", "tgt")
    removed = node_edits.where(F.col("op") == "remove_node").groupBy("id").agg(F.max("seq").alias("_gone"))
    for end in ("src", "tgt"):
        links = links.join(removed.withColumnRenamed("id", end), end, "left").where(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))).drop("_gone")
    scratch = Scratch(taxonomy.spark, "edits")
    nodes, links = scratch.keep(nodes), scratch.keep(links.select("src", "tgt", "op", "label"))
    out = taxonomy.remove_nodes(removed.select("id"))
    out = out.add_nodes(nodes.where(F.col("op") != "remove_node").select("id", "label"))[0]
    gone = links.where(F.col("op") == "remove_edge").select("src", "tgt").join(out.edges, ["src", "tgt"], "left_semi")
    out = out.remove_edges(gone)
    return out.add_edges(links.where(F.col("op") == "add_edge").select("src", "tgt", "label"))[0]


def _fs(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def follow(spark: SparkSession, edits: DataFrame, folder: str, checkpoint: str):
    """A streaming query that applies ``edits`` (a stream) to the tables under ``folder``: version n of batch n, so a repeated batch after a failure
    writes the same version again."""

    def one(batch: DataFrame, epoch: int) -> None:
        before = current(spark, folder, epoch)
        save_tables(apply_batch(before, batch), f"{folder}/v{epoch + 1}")
        fs, path = _fs(spark, f"{folder}/current")
        out = fs.create(path, True)
        out.write(bytearray(str(epoch + 1).encode()))
        out.close()

    return edits.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, version: int | None = None) -> Taxonomy:
    """Version ``version`` of the tables, or the one that ``current`` points at; the empty taxonomy where nothing was saved."""
    if version is None:
        fs, path = _fs(spark, f"{folder}/current")
        version = int(spark.read.text(f"{folder}/current").first()[0]) if fs.exists(path) else 0
    fs, path = _fs(spark, f"{folder}/v{version}/nodes")
    if fs.exists(path):
        return load_tables(spark, f"{folder}/v{version}")
    return Taxonomy(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))

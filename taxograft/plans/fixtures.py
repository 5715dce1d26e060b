"""Taxonomies over the relational test tables. Ids are k * 10^9 + key, so no two kinds of node share one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxograft.model import Taxonomy
from taxograft.session import table

BILLION = 1_000_000_000


def _id(kind: int, key: str) -> F.Column:
    return (F.lit(kind * BILLION) + F.col(key)).cast("bigint")


def _e(df: DataFrame, src: F.Column, tgt: F.Column, label: str = "original") -> DataFrame:
    return df.select(src.cast("bigint").alias("src"), tgt.cast("bigint").alias("tgt"), F.lit(label).alias("label"))


def _n(df: DataFrame, node: F.Column, label: str) -> DataFrame:
    return df.select(node.alias("id"), F.col(label).alias("label"))


def _root(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "Root Concept")], "id bigint, label string")


def geo(spark: SparkSession, sf: str, orders: bool = False) -> Taxonomy:
    """region, nation, customer and supplier as a tree; with ``orders`` also orders below customers."""
    r, n, c, s = (table(spark, sf, t) for t in ("region", "nation", "customer", "supplier"))
    edges = _e(r, _id(1, "r_regionkey"), F.lit(0)).unionByName(_e(n, _id(2, "n_nationkey"), _id(1, "n_regionkey")))
    edges = edges.unionByName(_e(c, _id(3, "c_custkey"), _id(2, "c_nationkey"))).unionByName(_e(s, _id(4, "s_suppkey"), _id(2, "s_nationkey")))
    nodes = _root(spark).unionByName(_n(r, _id(1, "r_regionkey"), "r_name")).unionByName(_n(n, _id(2, "n_nationkey"), "n_name"))
    nodes = nodes.unionByName(_n(c, _id(3, "c_custkey"), "c_name")).unionByName(_n(s, _id(4, "s_suppkey"), "s_name"))
    if orders:
        o = table(spark, sf, "orders").withColumn("name", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")))
        edges = edges.unionByName(_e(o, _id(8, "o_orderkey"), _id(3, "o_custkey")))
        nodes = nodes.unionByName(_n(o, _id(8, "o_orderkey"), "name"))
    return Taxonomy(nodes, edges)


def part(spark: SparkSession, sf: str, redundant: bool = False) -> Taxonomy:
    """Parts under their brand and their type; with ``redundant`` also straight under the root by edges labelled ``auto``."""
    p = table(spark, sf, "part")

    def kind(column: str, k: int) -> DataFrame:
        # brands and types are the catalogue's few distinct names
        return p.select(F.col(column).alias("name")).distinct().withColumn("id", (F.lit(k * BILLION) + F.row_number().over(Window.orderBy("name"))).cast("bigint"))

    brand, typ = kind("p_brand", 6), kind("p_type", 7)
    edges = _e(p.join(brand, p["p_brand"] == brand["name"]), _id(5, "p_partkey"), F.col("id")).unionByName(_e(p.join(typ, p["p_type"] == typ["name"]), _id(5, "p_partkey"), F.col("id")))
    edges = edges.unionByName(_e(brand, F.col("id"), F.lit(0))).unionByName(_e(typ, F.col("id"), F.lit(0)))
    if redundant:
        edges = edges.unionByName(_e(p, _id(5, "p_partkey"), F.lit(0), "auto"))
    nodes = _root(spark).unionByName(_n(p, _id(5, "p_partkey"), "p_name")).unionByName(brand.select("id", F.col("name").alias("label"))).unionByName(typ.select("id", F.col("name").alias("label")))
    return Taxonomy(nodes, edges)


#: The same taxonomies as SQL: common table expressions e(src, tgt, label) and n(id, label).
GEO_SQL = """e(src, tgt, label) AS (
  SELECT CAST(1000000000 + r_regionkey AS BIGINT), CAST(0 AS BIGINT), 'original' FROM region
  UNION ALL SELECT CAST(2000000000 + n_nationkey AS BIGINT), CAST(1000000000 + n_regionkey AS BIGINT), 'original' FROM nation
  UNION ALL SELECT 3000000000 + c_custkey, CAST(2000000000 + c_nationkey AS BIGINT), 'original' FROM customer
  UNION ALL SELECT 4000000000 + s_suppkey, CAST(2000000000 + s_nationkey AS BIGINT), 'original' FROM supplier),
 n(id, label) AS (SELECT CAST(0 AS BIGINT), 'Root Concept'
  UNION ALL SELECT CAST(1000000000 + r_regionkey AS BIGINT), r_name FROM region
  UNION ALL SELECT CAST(2000000000 + n_nationkey AS BIGINT), n_name FROM nation
  UNION ALL SELECT 3000000000 + c_custkey, c_name FROM customer
  UNION ALL SELECT 4000000000 + s_suppkey, s_name FROM supplier)"""

PART_SQL = """b(name, id) AS (SELECT p_brand, 6000000000 + row_number() OVER (ORDER BY p_brand) FROM (SELECT DISTINCT p_brand FROM part)),
 t(name, id) AS (SELECT p_type, 7000000000 + row_number() OVER (ORDER BY p_type) FROM (SELECT DISTINCT p_type FROM part)),
 e(src, tgt, label) AS (
  SELECT 5000000000 + p_partkey, b.id, 'original' FROM part JOIN b ON b.name = p_brand
  UNION ALL SELECT 5000000000 + p_partkey, t.id, 'original' FROM part JOIN t ON t.name = p_type
  UNION ALL SELECT id, CAST(0 AS BIGINT), 'original' FROM b UNION ALL SELECT id, CAST(0 AS BIGINT), 'original' FROM t{extra}),
 n(id, label) AS (SELECT CAST(0 AS BIGINT), 'Root Concept' UNION ALL SELECT 5000000000 + p_partkey, p_name FROM part
  UNION ALL SELECT id, name FROM b UNION ALL SELECT id, name FROM t)"""
PART_REDUNDANT_SQL = PART_SQL.format(extra=" UNION ALL SELECT 5000000000 + p_partkey, CAST(0 AS BIGINT), 'auto' FROM part")
PART_SQL = PART_SQL.format(extra="")

#: Closure c(node, anc, dist) and closure with self cs over e and n.
CLOSURE_SQL = """, w(node, anc, dist) AS (SELECT src, tgt, CAST(1 AS BIGINT) FROM e UNION ALL SELECT w.node, e.tgt, w.dist + 1 FROM w JOIN e ON w.anc = e.src),
 c AS (SELECT node, anc, CAST(MIN(dist) AS BIGINT) AS dist FROM w GROUP BY node, anc),
 cs AS (SELECT node, anc, dist FROM c UNION ALL SELECT id, id, CAST(0 AS BIGINT) FROM n)"""

"""Queries of the general problems (p1, p4, p5) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograft.operators.hierarchy import big7_links, descendants, full_hierarchies, hierarchy, taxo_links
from taxograft.operators.orphan_refs import big7_orphans, orphan_report
from taxograft.operators.packed_fields import packed_names
from taxograft.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed_names(table(spark, sf, "big7_data"), table(spark, sf, "emb_triples"), table(spark, sf, "gen_prompts"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return big7_orphans(table(spark, sf, "big7_data"), table(spark, sf, "sites"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(p4_found(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return full_hierarchies(table(spark, sf, "taxo_nodes"), table(spark, sf, "taxo_edges"), table(spark, sf, "big7_data"))


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    tree = hierarchy(*taxo_links(table(spark, sf, "taxo_nodes"), table(spark, sf, "taxo_edges")))
    return descendants(tree).select("node", "descendant", F.col("distance").cast("bigint").alias("distance"))


def p5_descendants_all(spark: SparkSession, sf: str) -> DataFrame:
    """The descendants in both hierarchies."""

    def shape(name: str, pair: tuple[DataFrame, DataFrame]) -> DataFrame:
        return descendants(hierarchy(*pair)).select(F.lit(name).alias("hierarchy"), "node", "descendant", F.col("distance").cast("bigint").alias("distance"))

    taxo = shape("taxo_nodes", taxo_links(table(spark, sf, "taxo_nodes"), table(spark, sf, "taxo_edges")))
    return taxo.unionByName(shape("big7_data", big7_links(table(spark, sf, "big7_data"))))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_descendants": p5_descendants, "p5_descendants_all": p5_descendants_all}

_ORPHANS = """
WITH rec AS (SELECT *, CAST(site_id AS VARCHAR) || '_' || CAST(cat_id AS VARCHAR) AS k FROM big7_data),
 refs AS (SELECT DISTINCT k, site_id, cat_id, loaded_at, CAST(TRIM(r.x) AS BIGINT) AS ref
          FROM rec, UNNEST(string_split(id_breadcrumb, '>')) AS r(x) WHERE TRIM(r.x) <> ''),
 miss AS (SELECT DISTINCT 'big7_data' AS target_table, k AS record_key,
            CAST(site_id AS VARCHAR) || '_' || CAST(ref AS VARCHAR) AS missing_key, strftime(loaded_at, '%Y-%m') AS period
          FROM refs r WHERE ref <> cat_id AND NOT EXISTS (SELECT 1 FROM rec p WHERE p.site_id = r.site_id AND p.cat_id = r.ref
            AND p.loaded_at <= r.loaded_at AND (p.deleted_at IS NULL OR p.deleted_at > r.loaded_at))),
 nosite AS (SELECT DISTINCT 'sites', k, CAST(site_id AS VARCHAR), strftime(loaded_at, '%Y-%m') FROM rec r
          WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.site_id = r.site_id AND s.opened_at <= r.loaded_at
            AND (s.closed_at IS NULL OR s.closed_at > r.loaded_at))),
 found AS (SELECT * FROM miss UNION ALL SELECT * FROM nosite)
"""

#: The taxonomy's and big7's nodes with their parent inside the table, walked from the roots.
_TREES = """
WITH RECURSIVE n AS (
  SELECT 'taxo_nodes' AS h, CAST(id AS VARCHAR) AS k FROM taxo_nodes
  UNION SELECT 'big7_data', CAST(site_id AS VARCHAR) || '_' || CAST(cat_id AS VARCHAR) FROM big7_data),
 l AS (SELECT h, k, MIN(p) AS p FROM (
   SELECT 'taxo_nodes' AS h, CAST(src AS VARCHAR) AS k, CAST(tgt AS VARCHAR) AS p FROM taxo_edges
   UNION SELECT 'big7_data', CAST(site_id AS VARCHAR) || '_' || CAST(cat_id AS VARCHAR),
     CASE WHEN len(string_split(id_breadcrumb, '>')) >= 2
       THEN CAST(site_id AS VARCHAR) || '_' || TRIM(string_split(id_breadcrumb, '>')[-2]) END FROM big7_data)
   WHERE p IS NOT NULL GROUP BY h, k),
 u AS (SELECT l.h, l.k, l.p FROM l JOIN n ON n.h = l.h AND n.k = l.p),
 w AS (SELECT n.h, n.k, n.k AS root, CAST(0 AS BIGINT) AS depth, n.k AS path
       FROM n WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.h = n.h AND u.k = n.k)
   UNION ALL SELECT u.h, u.k, w.root, w.depth + 1, w.path || '/' || u.k FROM w JOIN u ON u.h = w.h AND u.p = w.k)
"""

SQL = {
    "p4_found": _ORPHANS + "SELECT target_table, record_key, missing_key, period FROM found",
    "p4_report": _ORPHANS
    + """SELECT target_table, period, COUNT(*) AS n_orphans, COUNT(DISTINCT record_key) AS n_records,
      COUNT(DISTINCT missing_key) AS n_missing_keys FROM found GROUP BY target_table, period""",
    "p5_found": _TREES
    + """SELECT h AS hierarchy, k AS node_key, root AS root_key, depth, path AS node_path FROM w
      UNION ALL SELECT h, k, 'cycle', -1, 'cycle' FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.h = n.h AND w.k = n.k)""",
    "p5_descendants": _TREES
    + """, t AS (SELECT * FROM w WHERE h = 'taxo_nodes'),
     s AS (SELECT k, depth, string_split(path, '/') AS parts FROM t),
     x AS (SELECT k, depth, parts, UNNEST(range(1, depth + 1)) AS i FROM s WHERE depth > 0)
     SELECT parts[i] AS node, k AS descendant, CAST(depth - i + 1 AS BIGINT) AS distance FROM x""",
    "p5_descendants_all": _TREES
    + """, s AS (SELECT h, k, depth, string_split(path, '/') AS parts FROM w),
     x AS (SELECT h, k, depth, parts, UNNEST(range(1, depth + 1)) AS i FROM s WHERE depth > 0)
     SELECT h AS hierarchy, parts[i] AS node, k AS descendant, CAST(depth - i + 1 AS BIGINT) AS distance FROM x""",
}

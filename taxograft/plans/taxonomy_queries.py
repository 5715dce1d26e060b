"""Queries of the taxonomy operators over the relational tables and the project's own, each with an equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxograft.config import InsertionConfig, MoveConfig
from taxograft.functions import lexical, models
from taxograft.model import Taxonomy, TreeTaxonomy
from taxograft.operators import closure as cl
from taxograft.operators import space, vectors
from taxograft.plans import enrich, move, traindata
from taxograft.plans.fixtures import CLOSURE_SQL, GEO_SQL, PART_REDUNDANT_SQL, PART_SQL, geo, part
from taxograft.session import Scratch, table
from taxograft.sources import taxonomies as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GEO_C = f"WITH RECURSIVE {GEO_SQL}{CLOSURE_SQL} "
PART_C = f"WITH RECURSIVE {PART_SQL}{CLOSURE_SQL} "
RED_C = f"WITH RECURSIVE {PART_REDUNDANT_SQL}{CLOSURE_SQL} "


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _all(t: Taxonomy) -> DataFrame:
    return t.nodes.select(F.col("id").alias("query_id"), F.col("id").alias("node"))


# -- lookups, closure family


@query(GEO_C + "SELECT src AS node, tgt AS parent FROM e")
def parents(spark: SparkSession, sf: str) -> DataFrame:
    t = geo(spark, sf)
    return t.parents(_all(t)).select("node", "parent")


@query(f"WITH {PART_REDUNDANT_SQL} SELECT tgt AS node, src AS child FROM e WHERE label = 'original'")
def children(spark: SparkSession, sf: str) -> DataFrame:
    t = part(spark, sf, redundant=True)
    return t.children(_all(t), ["original"]).select("node", "child")


@query(GEO_C + "SELECT node, anc, dist FROM c WHERE node NOT IN (SELECT tgt FROM e)")
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    t = geo(spark, sf)
    return t.ancestors(t.leaves().select(F.col("id").alias("query_id"), F.col("id").alias("node"))).select("node", "anc", "dist")


@query(PART_C + "SELECT anc AS node, node AS \"desc\", dist FROM c")
def descendants(spark: SparkSession, sf: str) -> DataFrame:
    t = part(spark, sf)
    return t.descendants(_all(t)).select("node", "desc", "dist")


@query(GEO_C + "SELECT node, anc, dist FROM c WHERE dist <= 2")
def ancestors_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    t = geo(spark, sf)
    return t.ancestors(_all(t), max_depth=2).select("node", "anc", "dist")


@query(PART_C + "SELECT anc AS node, node AS \"desc\", dist FROM c WHERE dist <= 1")
def descendants_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    t = part(spark, sf)
    return t.descendants(_all(t), max_depth=1).select("node", "desc", "dist")


@query(
    f"WITH RECURSIVE {GEO_SQL}, o AS (SELECT * FROM e UNION ALL SELECT 8000000000 + o_orderkey, 3000000000 + o_custkey, 'original' FROM orders),"
    " w(node, anc, dist) AS (SELECT src, tgt, CAST(1 AS BIGINT) FROM o UNION ALL SELECT w.node, o.tgt, w.dist + 1 FROM w JOIN o ON w.anc = o.src)"
    " SELECT node, anc, CAST(MIN(dist) AS BIGINT) AS dist FROM w GROUP BY node, anc"
)
def closure_orders(spark: SparkSession, sf: str) -> DataFrame:
    return geo(spark, sf, orders=True).closure()


@query(PART_C + "SELECT node, anc, dist FROM c")
def closure_cte(spark: SparkSession, sf: str) -> DataFrame:
    return cl.closure_cte(spark, part(spark, sf).edges)


@query(RED_C.replace("FROM e UNION ALL SELECT w.node", "FROM e WHERE label = 'original' UNION ALL SELECT w.node").replace("JOIN e ON w.anc = e.src", "JOIN e ON w.anc = e.src AND e.label = 'original'") + "SELECT node, anc, dist FROM c")
def closure_restricted(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf, redundant=True).closure(["original"])


@query(
    PART_C
    + """, q AS (SELECT DISTINCT 5000000000 + l_partkey AS lower, b.id AS upper FROM lineitem JOIN part ON p_partkey = l_suppkey JOIN b ON b.name = p_brand)
    SELECT upper, lower, (upper = lower OR EXISTS (SELECT 1 FROM c WHERE c.node = lower AND c.anc = upper)) AS subsumes FROM q"""
)
def subsumes(spark: SparkSession, sf: str) -> DataFrame:
    t = part(spark, sf)
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    brand = t.nodes.where((F.col("id") > 6_000_000_000) & (F.col("id") < 7_000_000_000)).select(F.col("id").alias("upper"), F.col("label").alias("p_brand"))
    q = li.select("l_partkey", "l_suppkey").distinct().join(p.select(F.col("p_partkey").alias("l_suppkey"), "p_brand"), "l_suppkey").join(brand, "p_brand")
    return t.subsumes(q.select((F.col("l_partkey") + 5_000_000_000).alias("lower"), "upper").distinct()).select("upper", "lower", "subsumes")


@query(f"WITH {GEO_SQL}, k AS (SELECT tgt, COUNT(*) - 1 AS n FROM e GROUP BY tgt) SELECT e.src AS node, e.tgt AS parent, CAST(k.n AS BIGINT) AS n_siblings FROM e JOIN k ON k.tgt = e.tgt")
def siblings(spark: SparkSession, sf: str) -> DataFrame:
    """Every node with its parent, whose children are its siblings, and their number: pairs of siblings would grow with the square of a nation's customers."""
    return space.sibling_classes(geo(spark, sf).edges)


@query(
    f"""WITH {PART_SQL}, s AS (SELECT DISTINCT a.src AS node, b.src AS sibling FROM e a JOIN e b ON b.tgt = a.tgt AND b.src <> a.src WHERE a.src % 50 = 0)
    SELECT node, sibling, n.label, row_number() OVER (PARTITION BY node ORDER BY n.label, sibling) AS place FROM s JOIN n ON n.id = sibling"""
)
def dag_siblings(spark: SparkSession, sf: str) -> DataFrame:
    """The siblings over all parents of every node whose id is divisible by 50, in the order of their labels."""
    t = part(spark, sf)
    return space.listed_siblings(_all(t).where(F.col("node") % 50 == 0), t.edges, t.nodes).select("node", "sibling", "label", "place")


@query(GEO_C + "SELECT node, array_to_string(list(anc ORDER BY dist DESC), '/') AS crumb FROM cs GROUP BY node")
def breadcrumb(spark: SparkSession, sf: str) -> DataFrame:
    return geo(spark, sf).breadcrumbs().select("node", F.concat_ws("/", F.transform("crumb", lambda x: x.cast("string"))).alias("crumb"))


@query(f"WITH {GEO_SQL} SELECT id FROM n WHERE id NOT IN (SELECT tgt FROM e)")
def leaves(spark: SparkSession, sf: str) -> DataFrame:
    return geo(spark, sf).leaves()


@query("SELECT DISTINCT id FROM taxo_nodes WHERE id NOT IN (SELECT src FROM taxo_edges)")
def roots(spark: SparkSession, sf: str) -> DataFrame:
    return _own(spark, sf).roots()


@query(
    f"""WITH {PART_SQL} SELECT (SELECT COUNT(*) FROM n) AS n_nodes, (SELECT COUNT(*) FROM e) AS n_edges,
    (SELECT COUNT(*) FROM n WHERE id NOT IN (SELECT src FROM e)) AS n_roots, (SELECT COUNT(*) FROM n WHERE id NOT IN (SELECT tgt FROM e)) AS n_leaves"""
)
def stats(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).stats()


def _own(spark: SparkSession, sf: str) -> Taxonomy:
    """The project's own taxonomy, cycles included, with the name of cat_data where a label is missing."""
    n = table(spark, sf, "taxo_nodes").groupBy("id").agg(F.min("label").alias("label"))
    c = table(spark, sf, "cat_data").groupBy(F.col("cat_id").alias("id")).agg(F.min("label").alias("_l"))
    e = table(spark, sf, "taxo_edges").groupBy("src", "tgt").agg(F.min("label").alias("label"))
    return Taxonomy(n.join(c, "id", "left").select("id", F.coalesce("label", "_l").alias("label")), e)


_PEEL = """
 up(id, k) AS (SELECT src, tgt FROM e UNION SELECT up.id, e.tgt FROM up JOIN e ON up.k = e.src),
 core AS (SELECT DISTINCT id FROM up WHERE id = k),
 cyc AS (SELECT id FROM core UNION SELECT a.id FROM up a JOIN core ON core.id = a.k WHERE EXISTS (SELECT 1 FROM up b JOIN core c2 ON c2.id = b.id WHERE b.k = a.id))
"""


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, tgt FROM taxo_edges), {_PEEL},
    lab AS (SELECT n.id, COALESCE(MIN(n.label), MIN(c.label)) AS label FROM taxo_nodes n LEFT JOIN cat_data c ON c.cat_id = n.id GROUP BY n.id)
    SELECT 'cycle' AS finding, 'error' AS severity, id FROM cyc
    UNION ALL SELECT 'missing_label', 'warning', id FROM lab WHERE label IS NULL OR label = ''
    UNION ALL SELECT 'orphan', 'warning', id FROM lab WHERE id <> 0 AND id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT tgt FROM e)"""
)
def validate(spark: SparkSession, sf: str) -> DataFrame:
    return _own(spark, sf).validate()


@query(PART_C + "SELECT node AS id, MIN(dist) AS level FROM cs JOIN (SELECT id FROM n WHERE id NOT IN (SELECT src FROM e)) r ON cs.anc = r.id GROUP BY node")
def levels(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).levels


@query(PART_C + "SELECT anc AS id, MIN(dist) AS reverse_level FROM cs JOIN (SELECT id FROM n WHERE id NOT IN (SELECT tgt FROM e)) l ON cs.node = l.id GROUP BY anc")
def reverse_levels(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).reverse_levels


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT src, tgt FROM taxo_edges), n AS (SELECT DISTINCT id FROM taxo_nodes),
    w(id, d) AS (SELECT id, CAST(0 AS BIGINT) FROM n WHERE id NOT IN (SELECT src FROM e) UNION SELECT e.src, w.d + 1 FROM w JOIN e ON e.tgt = w.id)
    SELECT id, MIN(d) AS level FROM w GROUP BY id"""
)
def depth(spark: SparkSession, sf: str) -> DataFrame:
    """Depths in the project's own taxonomy, branches of some eighty levels included."""
    return _own(spark, sf).levels


_LEVEL_CASES = ((1, 1), (2, 0), (-1, 0), (0, 2), (0, -1), (-2, -3), (1, -2))


def _level_where(top: int, bottom: int) -> str:
    rules = [f"d >= {top}" if top > 0 else f"r <= {-top}" if top else "", f"r >= {bottom}" if bottom > 0 else f"d <= {-bottom}" if bottom else ""]
    return " AND ".join(x for x in rules if x)


@query(
    GEO_C
    + """, lv AS (SELECT node AS id, MIN(dist) AS d FROM cs WHERE anc = 0 GROUP BY node),
    rl AS (SELECT anc AS id, MIN(dist) AS r FROM cs WHERE node NOT IN (SELECT tgt FROM e) GROUP BY anc), b AS (SELECT lv.id, d, r FROM lv JOIN rl ON rl.id = lv.id) """
    + " UNION ALL ".join(f"SELECT '{t},{b}' AS bounds, id FROM b WHERE {_level_where(t, b)}" for t, b in _LEVEL_CASES)
)
def filter_by_level(spark: SparkSession, sf: str) -> DataFrame:
    """All signs of the two bounds."""
    t, out = geo(spark, sf), None
    for top, bottom in _LEVEL_CASES:
        one = t.filter_by_level(top, bottom).select(F.lit(f"{top},{bottom}").alias("bounds"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {GEO_SQL}, u AS (SELECT src AS x, tgt AS y FROM e UNION SELECT tgt, src FROM e), q AS (SELECT id FROM n WHERE id % 50 = 0),
    one AS (SELECT DISTINCT q.id AS node, u.y AS other FROM q JOIN u ON u.x = q.id),
    two AS (SELECT DISTINCT one.node, u.y AS other FROM one JOIN u ON u.x = one.other WHERE u.y <> one.node)
    SELECT node, other, CAST(1 AS BIGINT) AS dist FROM one UNION ALL SELECT node, other, 2 FROM two ANTI JOIN one USING (node, other)"""
)
def n_hop_ring(spark: SparkSession, sf: str) -> DataFrame:
    """Rings 1 and 2 around every node whose id is divisible by 50."""
    t = geo(spark, sf)
    q = _all(t).where(F.col("node") % 50 == 0)
    return cl.rings(q, t.edges, 2).where(F.col("dist") > 0).select(F.col("query_id").alias("node"), F.col("node").alias("other"), "dist")


@query(
    f"""WITH RECURSIVE {PART_SQL}, p(node, path, depth) AS (SELECT CAST(0 AS BIGINT), '0', CAST(0 AS BIGINT) UNION ALL SELECT e.src, p.path || '|' || e.src, p.depth + 1 FROM p JOIN e ON e.tgt = p.node)
    SELECT node, path, depth FROM p"""
)
def root_paths(spark: SparkSession, sf: str) -> DataFrame:
    t = part(spark, sf)
    p = cl.root_paths(t.nodes, t.edges)
    return p.select("node", F.concat_ws("|", F.transform("path", lambda x: x.cast("string"))).alias("path"), (F.size("path") - 1).cast("bigint").alias("depth"))


@query(
    f"""WITH RECURSIVE {PART_SQL}, p(node, path, depth) AS (SELECT CAST(0 AS BIGINT), ['0'], CAST(0 AS BIGINT) UNION ALL SELECT e.src, list_append(p.path, CAST(e.src AS VARCHAR)), p.depth + 1 FROM p JOIN e ON e.tgt = p.node),
    x AS (SELECT node, path, unnest(range(1, len(path))) AS k FROM p)
    SELECT node, array_to_string(path, '|') AS path_key, array_to_string(path[1:k], '|') AS prefix_key FROM x"""
)
def path_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    t = part(spark, sf)
    return cl.path_prefixes(cl.root_paths(t.nodes, t.edges))


@query(
    f"""WITH RECURSIVE {PART_SQL}, p(node, k, depth) AS (SELECT CAST(0 AS BIGINT), 'Root Concept:0', CAST(0 AS BIGINT) UNION ALL SELECT e.src, p.k || '/' || n.label || ':' || e.src, p.depth + 1 FROM p JOIN e ON e.tgt = p.node JOIN n ON n.id = e.src WHERE p.depth < 3),
    f AS (SELECT node, depth, k, row_number() OVER (PARTITION BY node ORDER BY k) AS r FROM p)
    SELECT f.node AS id, depth, k AS sort_key, n.label FROM f JOIN n ON n.id = f.node WHERE r = 1"""
)
def tree_preview(spark: SparkSession, sf: str) -> DataFrame:
    t = part(spark, sf)
    return space.preview_rows(cl.root_paths(t.nodes, t.edges, 3), t.nodes)


@query("SELECT id, label FROM (SELECT n.id, COALESCE(MIN(n.label), MIN(c.label)) AS label FROM taxo_nodes n LEFT JOIN cat_data c ON c.cat_id = n.id GROUP BY n.id) WHERE lower(label) LIKE '%radio%' OR CAST(id AS VARCHAR) LIKE '%radio%' ORDER BY label, id LIMIT 20")
def label_search(spark: SparkSession, sf: str) -> DataFrame:
    return space.search_labels(_own(spark, sf).nodes, "Radio")


# -- lattice

_QM = """, pr AS (SELECT DISTINCT 5000000000 + l_partkey AS a, 5000000000 + lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem),
 qp AS (SELECT DISTINCT a, b FROM pr WHERE b IS NOT NULL AND a <> b),
 qm AS (SELECT a, b, a AS m FROM qp UNION ALL SELECT a, b, b FROM qp)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that follow each other in an order: (query_id, a, b)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    p = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b"))
    p = p.where(F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    p = p.select((F.col("a") + 5_000_000_000).alias("a"), (F.col("b") + 5_000_000_000).alias("b"))
    return p.withColumn("query_id", F.concat_ws("_", "a", "b"))


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select("query_id", F.explode(F.array("a", "b")).alias("node"))


_LCA = """, ca AS MATERIALIZED (SELECT a, b, cs.anc FROM qm JOIN cs ON cs.node = qm.m GROUP BY a, b, cs.anc HAVING COUNT(*) = 2),
 hid AS MATERIALIZED (SELECT DISTINCT a, b, c.anc FROM ca JOIN c ON c.node = ca.anc),
 lc AS (SELECT a, b, anc FROM ca ANTI JOIN hid USING (a, b, anc))"""


@query(PART_C + _QM + _LCA + " SELECT a || '_' || b AS query_id, anc AS node FROM lc")
def lca_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).lca(_members(_pairs(spark, sf)))


@query(RED_C.replace("FROM e UNION ALL SELECT w.node", "FROM e WHERE label = 'auto' UNION ALL SELECT w.node").replace("JOIN e ON w.anc = e.src", "JOIN e ON w.anc = e.src AND e.label = 'auto'") + _QM + _LCA + " SELECT a || '_' || b AS query_id, anc AS node FROM lc")
def lca_label_restricted(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf, redundant=True).lca(_members(_pairs(spark, sf)), ["auto"])


@query(
    PART_C
    + """, q AS (SELECT b.id AS x, t.id AS y FROM b JOIN part ON p_brand = b.name JOIN t ON t.name = p_type GROUP BY 1, 2),
    cd AS (SELECT x, y, node FROM q JOIN c ON c.anc = x WHERE EXISTS (SELECT 1 FROM c c2 WHERE c2.node = c.node AND c2.anc = y)),
    g AS (SELECT x, y, node FROM cd WHERE NOT EXISTS (SELECT 1 FROM cd d2 JOIN c ON c.anc = d2.node WHERE d2.x = cd.x AND d2.y = cd.y AND c.node = cd.node))
    SELECT x || '_' || y AS query_id, node FROM g"""
)
def gcd_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of both a brand and a type, for every brand and type that share one."""
    t = part(spark, sf)
    up = t.edges.where(F.col("tgt") != 0)
    q = up.select("src", F.col("tgt").alias("x")).where(F.col("x") < 7_000_000_000).join(up.select("src", F.col("tgt").alias("y")).where(F.col("y") > 7_000_000_000), "src")
    q = q.select("x", "y").distinct().withColumn("query_id", F.concat_ws("_", "x", "y"))
    return t.gcd(q.select("query_id", F.explode(F.array("x", "y")).alias("node")))


_SETS = """, s AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS q, 5000000000 + l_partkey AS node FROM lineitem
   UNION SELECT CAST(l_orderkey AS VARCHAR), b.id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN b ON b.name = p_brand WHERE l_linenumber = 1)"""


def _order_sets(spark: SparkSession, sf: str, t: Taxonomy) -> DataFrame:
    """The parts of each order and the brand of its first line."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("query_id"), (F.col("l_partkey") + 5_000_000_000).alias("node"), "l_linenumber")
    brand = t.edges.where((F.col("tgt") > 6_000_000_000) & (F.col("tgt") < 7_000_000_000)).select(F.col("src").alias("node"), "tgt")
    first = li.where(F.col("l_linenumber") == 1).join(brand, "node").select("query_id", F.col("tgt").alias("node"))
    return li.select("query_id", "node").unionByName(first).distinct()


@query(PART_C + _SETS + " SELECT q AS query_id, node FROM s WHERE NOT EXISTS (SELECT 1 FROM s s2 JOIN c ON c.node = s2.node WHERE s2.q = s.q AND c.anc = s.node)")
def reduce_bottom(spark: SparkSession, sf: str) -> DataFrame:
    t = part(spark, sf)
    return t.reduce_subset(_order_sets(spark, sf, t))


@query(PART_C + _SETS + " SELECT q AS query_id, node FROM s WHERE NOT EXISTS (SELECT 1 FROM s s2 JOIN c ON c.anc = s2.node WHERE s2.q = s.q AND c.node = s.node)")
def reduce_top(spark: SparkSession, sf: str) -> DataFrame:
    t = part(spark, sf)
    return t.reduce_subset(_order_sets(spark, sf, t), most_general=True)


@query(
    PART_C
    + _QM
    + _LCA
    + """, d AS (SELECT node AS id, MIN(dist) AS d FROM cs WHERE anc = 0 GROUP BY node), one AS (SELECT a, b, MIN(anc) AS anc FROM lc GROUP BY a, b)
    SELECT qp.a, qp.b, round(CASE WHEN one.anc IS NULL THEN 0.0 WHEN da.d + db.d = 0 THEN NULL ELSE 2.0 * dl.d / (da.d + db.d) END, 6) AS similarity
    FROM qp LEFT JOIN one ON one.a = qp.a AND one.b = qp.b LEFT JOIN d da ON da.id = qp.a LEFT JOIN d db ON db.id = qp.b LEFT JOIN d dl ON dl.id = one.anc"""
)
def wu_palmer(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).wu_palmer(_pairs(spark, sf)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(RED_C + "SELECT src, tgt, label FROM e WHERE NOT EXISTS (SELECT 1 FROM e e2 JOIN c ON c.node = e2.tgt WHERE e2.src = e.src AND c.anc = e.tgt)")
def transitive_reduction(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf, redundant=True).transitive_reduction().edges.select("src", "tgt", "label")


# -- search spaces

_BASE = """, q AS (SELECT 'q' || l_orderkey AS q, 5000000000 + l_partkey AS node FROM lineitem GROUP BY 1, 2),
 base AS (SELECT q, node FROM q WHERE NOT EXISTS (SELECT 1 FROM q q2 JOIN c ON c.node = q2.node WHERE q2.q = q.q AND c.anc = q.node)),
 nb AS (SELECT q, COUNT(*) AS k FROM base GROUP BY q),
 ca AS (SELECT base.q, cs.anc FROM base JOIN cs ON cs.node = base.node GROUP BY base.q, cs.anc HAVING COUNT(*) = (SELECT k FROM nb WHERE nb.q = base.q)),
 top AS (SELECT q, anc AS node FROM ca WHERE NOT EXISTS (SELECT 1 FROM ca c2 JOIN c ON c.node = c2.anc WHERE c2.q = ca.q AND c.anc = ca.anc)),
 sp(q, id) AS (SELECT q, node FROM top UNION SELECT sp.q, e.src FROM sp JOIN e ON e.tgt = sp.id
   WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.q = sp.q AND base.node = sp.id)
     AND EXISTS (SELECT 1 FROM base JOIN cs ON cs.node = base.node WHERE base.q = sp.q AND cs.anc = e.src))"""


def _bases(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of each order."""
    li = table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("query_id"), (F.col("l_partkey") + 5_000_000_000).alias("node")).distinct()


@query(PART_C + _BASE + " SELECT q AS query_id, id FROM sp")
def insertion_space_strict(spark: SparkSession, sf: str) -> DataFrame:
    t = part(spark, sf)
    return space.insertion_space(_bases(spark, sf), t.nodes, t.edges, t.closure(), strict=True)[0]


_GEO_BASE = """, base AS (SELECT DISTINCT 'r' || n_regionkey AS q, CAST(2000000000 + n_nationkey AS BIGINT) AS node FROM nation),
 nb AS (SELECT q, COUNT(*) AS k FROM base GROUP BY q),
 ca AS (SELECT base.q, cs.anc FROM base JOIN cs ON cs.node = base.node GROUP BY base.q, cs.anc HAVING COUNT(*) = (SELECT k FROM nb WHERE nb.q = base.q)),
 top AS (SELECT q, anc AS node FROM ca WHERE NOT EXISTS (SELECT 1 FROM ca c2 JOIN c ON c.node = c2.anc WHERE c2.q = ca.q AND c.anc = ca.anc)),
 sp(q, id, par) AS (SELECT q, node, CAST(NULL AS BIGINT) FROM top UNION SELECT sp.q, e.src, sp.id FROM sp JOIN e ON e.tgt = sp.id
   WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.q = sp.q AND base.node = sp.id)
     AND NOT EXISTS (SELECT 1 FROM base JOIN c ON c.anc = base.node WHERE base.q = sp.q AND c.node = e.src))"""


def _nation_bases(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("query_id"), (F.lit(2_000_000_000) + F.col("n_nationkey")).cast("bigint").alias("node"))


@query(GEO_C + _GEO_BASE + " SELECT DISTINCT q AS query_id, id AS src, par AS tgt FROM sp WHERE par IS NOT NULL")
def insertion_space(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of the search space of each region's nations."""
    t = geo(spark, sf)
    return space.insertion_space(_nation_bases(spark, sf), t.nodes, t.edges, t.closure())[1].select("query_id", "src", "tgt")


@query(
    GEO_C
    + _GEO_BASE.replace("sp(q, id, par) AS (SELECT q, node, CAST(NULL AS BIGINT) FROM top", "sp(q, id, par) AS (SELECT DISTINCT q, CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM base")
    + " SELECT DISTINCT q AS query_id, id FROM sp"
)
def insertion_space_uncropped(spark: SparkSession, sf: str) -> DataFrame:
    t = geo(spark, sf)
    return space.insertion_space(_nation_bases(spark, sf), t.nodes, t.edges, t.closure(), crop_top=False)[0]


@query(GEO_C + _GEO_BASE + " SELECT DISTINCT q AS query_id, id FROM sp")
def insertion_space_forced(spark: SparkSession, sf: str) -> DataFrame:
    t = geo(spark, sf)
    return space.insertion_space(_nation_bases(spark, sf), t.nodes, t.edges, t.closure(), force_labels=[["auto", "original"]])[0]


@query(f"WITH {GEO_SQL} SELECT src, tgt FROM e WHERE src < 3000000000")
def move_space(spark: SparkSession, sf: str) -> DataFrame:
    t = geo(spark, sf)
    return space.move_space(t.nodes, t.edges)[1].select("src", "tgt")


@query(
    GEO_C
    + """, q AS (SELECT id FROM n WHERE id % 50 = 0),
    m AS (SELECT id AS q, id, 0 AS r FROM q UNION ALL SELECT q.id, c.anc, CASE WHEN dist = 1 THEN 1 ELSE 4 END FROM q JOIN c ON c.node = q.id AND dist <= 2
      UNION ALL SELECT q.id, c.node, CASE WHEN dist = 1 THEN 2 ELSE 4 END FROM q JOIN c ON c.anc = q.id AND dist <= 2
      UNION ALL SELECT q.id, b.src, 3 FROM q JOIN e a ON a.src = q.id JOIN e b ON b.tgt = a.tgt AND b.src <> a.src)
    SELECT q AS query_id, id, ['selected', 'ancestor', 'child', 'sibling', 'context'][MIN(r) + 1] AS role FROM m GROUP BY q, id"""
)
def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """Two hops around every node whose id is divisible by 50."""
    t = geo(spark, sf)
    q = _all(t).where(F.col("node") % 50 == 0)
    return space.neighbourhood(q, t.edges, 2)[0]


@query(f"WITH {PART_REDUNDANT_SQL}, k AS (SELECT id FROM n WHERE id >= 6000000000 OR id = 0) SELECT src, tgt, label FROM e WHERE src IN (SELECT id FROM k) AND tgt IN (SELECT id FROM k)")
def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    t = part(spark, sf, redundant=True)
    return t.subgraph(t.nodes.where((F.col("id") >= 6_000_000_000) | (F.col("id") == 0)).select("id")).edges.select("src", "tgt", "label")


# -- edits


@query(
    f"""WITH RECURSIVE {GEO_SQL}{CLOSURE_SQL},
    new AS (SELECT CAST(2000000000 + n_nationkey AS BIGINT) AS src, CAST(1000000000 + n_regionkey AS BIGINT) AS tgt FROM nation
      UNION SELECT CAST(1000000000 + n_regionkey AS BIGINT), CAST(2000000000 + n_nationkey AS BIGINT) FROM nation
      UNION SELECT 4000000000 + s_suppkey, CAST(1000000000 + (s_suppkey % 5) AS BIGINT) FROM supplier)
    SELECT src, tgt, CAST(CASE WHEN EXISTS (SELECT 1 FROM cs WHERE cs.node = new.tgt AND cs.anc = new.src) THEN -1
      WHEN EXISTS (SELECT 1 FROM e WHERE e.src = new.src AND e.tgt = new.tgt) THEN 1 ELSE 0 END AS INTEGER) AS code FROM new"""
)
def add_edges_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that stand already, that would close a cycle, and new ones."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    up = n.select((F.lit(2_000_000_000) + F.col("n_nationkey")).alias("src"), (F.lit(1_000_000_000) + F.col("n_regionkey")).alias("tgt"))
    new = up.unionByName(up.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).unionByName(s.select((F.lit(4_000_000_000) + F.col("s_suppkey")).alias("src"), (F.lit(1_000_000_000) + F.col("s_suppkey") % 5).alias("tgt")))
    return geo(spark, sf).add_edges(new.select(F.col("src").cast("bigint").alias("src"), F.col("tgt").cast("bigint").alias("tgt")).distinct())[1]


@query(f"WITH {GEO_SQL} SELECT src, tgt FROM e WHERE NOT (src BETWEEN 2000000000 AND 2999999999) AND NOT (tgt BETWEEN 2000000000 AND 2999999999)")
def remove_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """What remains of the edges when all nations go."""
    t = geo(spark, sf)
    gone = t.nodes.where((F.col("id") >= 2_000_000_000) & (F.col("id") < 3_000_000_000)).select("id")
    return t.remove_nodes(gone).edges.select("src", "tgt")


# -- vectors

_SCORES = """q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
 a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, a.vec_id AS id, {score} AS score FROM q CROSS JOIN a{where}),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank FROM s)"""
_IP = _SCORES.format(score="list_inner_product(q.v, a.v)", order="DESC", where="{where}")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(v: DataFrame) -> DataFrame:
    return v.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "embedding")


def _top(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("WITH " + _IP.format(where="") + " SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return _top(vectors.top_k(_asked(v), v, 10))


@query("WITH " + _IP.format(where=" WHERE a.vec_id IN (SELECT vec_id FROM embeddings WHERE label < 5)") + " SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def knn_subset(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return _top(vectors.VectorStore(v).search(_asked(v), 10, subset=v.where(F.col("label") < 5)))


@query("WITH " + _SCORES.format(score="list_distance(q.v, a.v) * list_distance(q.v, a.v)", order="ASC", where="") + " SELECT query_id, id, round(score, 6) + 0.0 AS score, rank FROM r WHERE rank <= 10")
def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return _top(vectors.top_k(_asked(v), v, 10, "l2")).withColumn("score", F.abs("score"))


@query(
    """WITH f AS (SELECT label, MIN(vec_id) AS id FROM embeddings GROUP BY label)
    SELECT e.vec_id AS a, x.vec_id AS b, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings e JOIN f ON f.label = e.label JOIN embeddings x ON x.vec_id = f.id"""
)
def cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with the first of its label."""
    v = _vectors(spark, sf)
    first = v.groupBy("label").agg(F.min_by(F.struct(F.col("id").alias("b"), F.col("embedding").alias("y")), "id").alias("f")).select("label", "f.*")
    return v.join(first, "label").select(F.col("id").alias("a"), "b", F.round(vectors.cosine(F.col("embedding"), F.col("y")), 6).alias("similarity"))


@query(
    """WITH s AS (SELECT vec_id AS id, embedding FROM embeddings WHERE label <> 7 UNION ALL SELECT vec_id + 1000000000, embedding FROM embeddings WHERE label < 5)
    SELECT id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, len(embedding) AS dim FROM s WHERE id % 50 = 0"""
)
def vector_store_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a store after adding copies of some labels under new ids and deleting one label, for every id divisible by 50."""
    v = _vectors(spark, sf)
    more = v.where(F.col("label") < 5).select((F.col("id") + 1_000_000_000).alias("id"), "embedding")
    store = vectors.VectorStore(v).add(more).delete(v.where(F.col("label") == 7).select("id"))
    got = store.reconstruct(store.concepts().where(F.col("id") % 50 == 0))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return got.select("id", F.round(total, 4).alias("total"), F.size("embedding").cast("bigint").alias("dim"))


@query(
    """WITH p AS (SELECT label, MIN(vec_id) AS id FROM embeddings GROUP BY label), n AS (SELECT label, COUNT(*) AS n FROM embeddings GROUP BY label),
    s AS (SELECT p.label, e.label AS l2, row_number() OVER (PARTITION BY p.label ORDER BY list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank
      FROM p JOIN embeddings q ON q.vec_id = p.id CROSS JOIN embeddings e),
    g AS (SELECT n.label, n.n, k FROM n CROSS JOIN (SELECT unnest(range(1, 21)) AS k)),
    h AS (SELECT g.label, g.k, g.n, (SELECT COUNT(*) FROM s WHERE s.label = g.label AND s.l2 = g.label AND s.rank <= (g.k * g.n + 9) // 10) AS hits FROM g)
    SELECT k / 10.0 AS ratio, round(AVG(hits * 1.0 / n), 6) AS recall, round(1.96 * stddev_pop(hits * 1.0 / n) / sqrt(COUNT(*)), 6) AS spread FROM h GROUP BY k"""
)
def hit_at_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval recall with labels as clusters and each cluster's first vector as probe."""
    v = Scratch(spark, "hits").keep(_vectors(spark, sf))
    probes = v.groupBy("label").agg(F.min("id").alias("id")).select(F.col("label").alias("probe_id"), "id")
    deepest = v.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    knn = vectors.top_k(probes.join(v, "id").select(F.col("id").alias("query_id"), "embedding"), v, 2 * deepest)
    out = vectors.hit_at_ratio(knn, v.select(F.col("label").alias("cluster_id"), "id"), probes)
    return out.select("ratio", F.round("recall", 6).alias("recall"), F.round("spread", 6).alias("spread"))


@query()
def knn_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cell-pruned search; approximate, so held against brute force in the tests."""
    v = _vectors(spark, sf)
    store = vectors.VectorStore(v).train_cells()
    return _top(store.search(_asked(v), 10, nprobe=store.probes_for(0.95)))


# -- lexical


@query("""WITH b AS (SELECT site_id, cat_id, loaded_at, breadcrumb, [regexp_replace(x, ' \\(\\d+\\).*$', '', 's') FOR x IN string_split(breadcrumb, ' > ')] AS n,
    regexp_extract_all(breadcrumb || ' > ', ' \\((\\d+)\\)\\s?> ', 1) AS i FROM big7_data)
   SELECT site_id, cat_id, loaded_at, array_to_string(n, ' > ') AS symbol, string_split(breadcrumb, ' > ')[1] AS first,
    n[1] || CASE WHEN len(n) > 1 THEN ' contains ' || array_to_string(n[2:], ', which contains ') ELSE '' END || '.' AS word,
    CASE WHEN len(i) > 0 THEN array_to_string(i, ' ') END AS id, breadcrumb AS raw FROM b""")
def breadcrumb_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """All link modes over all breadcrumbs."""
    b = F.col("breadcrumb")
    modes = [lexical.normalise_breadcrumb(b, m).alias(m) for m in ("symbol", "word", "id", "raw")]
    return table(spark, sf, "big7_data").select("site_id", "cat_id", "loaded_at", *modes, F.get(lexical.segment(b), F.lit(0)).alias("first"))


@query(
    """WITH x AS (SELECT site_id, cat_id, loaded_at, string_split(breadcrumb, ' > ') AS a, string_split(id_breadcrumb, '>') AS b FROM big7_data WHERE breadcrumb IS NOT NULL AND id_breadcrumb IS NOT NULL),
    u AS (SELECT *, list_concat(a, b) AS l FROM x)
    SELECT site_id, cat_id, loaded_at, array_to_string(list_filter(l, lambda y, i: list_position(l, y) = i), '|') AS both,
      array_to_string(list_filter(a, lambda y: NOT list_contains(b, y)), '|') AS only_first,
      array_to_string(CASE WHEN list_contains(a, 'Root') THEN a ELSE list_append(a, 'Root') END, '|') AS with_root FROM u"""
)
def list_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Union, difference and adding, over the parts of both breadcrumbs."""
    x = table(spark, sf, "big7_data").where(F.col("breadcrumb").isNotNull() & F.col("id_breadcrumb").isNotNull())
    a, b = F.split("breadcrumb", " > "), F.split("id_breadcrumb", ">")
    text = lambda c, name: F.array_join(c, "|").alias(name)
    return x.select("site_id", "cat_id", "loaded_at", text(lexical.list_union(a, b), "both"), text(lexical.list_diff(a, b), "only_first"), text(lexical.list_add(a, F.lit("Root")), "with_root"))


# words of which a region's name is the more general one, and the customers' and suppliers' words below
_WORDS_SQL = """w AS (SELECT n_name AS node, r_name AS anc FROM nation JOIN region ON r_regionkey = n_regionkey
   UNION SELECT lower(c_mktsegment), n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey < 26 UNION SELECT lower(c_mktsegment), r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey < 26)"""


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """A closure of words: nations below regions, and the first customers' segments below both."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    up = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("node"), F.col("r_name").alias("anc"))
    c = table(spark, sf, "customer").where(F.col("c_custkey") < 26).join(up, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower("c_mktsegment").alias("s"), "node", "anc")
    return up.select("node", "anc").unionByName(c.select(F.col("s").alias("node"), F.col("node").alias("anc"))).unionByName(c.select(F.col("s").alias("node"), "anc")).distinct()


@query(
    f"""WITH {_WORDS_SQL}, t AS (SELECT node AS x FROM w UNION SELECT anc FROM w UNION SELECT NULL), p AS (SELECT a.x AS word1, b.x AS word2 FROM t a, t b),
    h AS (SELECT word1, word2, CASE WHEN word2 IS NULL THEN TRUE WHEN word1 IS NULL THEN FALSE ELSE word1 = word2 OR EXISTS (SELECT 1 FROM w WHERE node = word2 AND anc = word1) END AS up,
      CASE WHEN word1 IS NULL THEN TRUE WHEN word2 IS NULL THEN FALSE ELSE word1 = word2 OR EXISTS (SELECT 1 FROM w WHERE node = word1 AND anc = word2) END AS down FROM p)
    SELECT word1, word2, up AS hypernym, CASE WHEN word1 IS NULL OR word2 IS NULL THEN COALESCE(word1, word2) WHEN up THEN word1 WHEN down THEN word2 END AS hyper,
      CASE WHEN word1 IS NULL OR word2 IS NULL THEN NULL WHEN up THEN word2 WHEN down THEN word1 END AS hypo FROM h"""
)
def hypernym_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of the few words, null among them: which is the more general, if either is."""
    w = Scratch(spark, "words").keep(_words(spark, sf))
    one = w.select(F.col("node").alias("x")).union(w.select("anc")).distinct().unionByName(spark.createDataFrame([(None,)], "x string"))
    p = one.select(F.col("x").alias("word1")).crossJoin(F.broadcast(one.select(F.col("x").alias("word2"))))  # some forty words
    up = lexical.hypernym(p, w).select(F.col("word1").alias("_a"), F.col("word2").alias("_b"), "hypernym")
    both = lexical.hyper_hypo(p, w)
    return both.join(up, both["word1"].eqNullSafe(up["_a"]) & both["word2"].eqNullSafe(up["_b"])).select("word1", "word2", "hypernym", "hyper", "hypo")


_TOKENS_SQL = """t AS (SELECT c_custkey AS row_id, 1 AS pos, r_name AS token FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
   UNION ALL SELECT c_custkey, 2, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 3, lower(c_mktsegment) FROM customer)"""


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, pos, token): each customer's region, nation and segment."""
    n, r, c = table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "customer")
    named = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(F.col("c_custkey").alias("row_id"), F.posexplode(F.array("r_name", "n_name", F.lower("c_mktsegment"))).alias("pos", "token")).withColumn("pos", F.col("pos") + 1)


@query(
    f"""WITH {_WORDS_SQL}, {_TOKENS_SQL}, k AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t o JOIN w ON w.node = o.token WHERE o.row_id = t.row_id AND w.anc = t.token))
    SELECT row_id, array_to_string(list(token ORDER BY pos), ', ') AS keywords FROM k GROUP BY row_id"""
)
def keyword_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's words without those more general than another of them."""
    return lexical.keyword_strings(_tokens(spark, sf), _words(spark, sf))


@query(
    f"""WITH {_WORDS_SQL}, {_TOKENS_SQL}, p AS (SELECT c_custkey AS pair_id, c_custkey AS l, c_custkey + 1 AS r FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer)),
    o AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t x JOIN w ON w.node = x.token WHERE x.row_id = t.row_id AND w.anc = t.token)),
    s AS (SELECT DISTINCT pair_id, 'l' AS side, token FROM p JOIN o ON o.row_id = p.l UNION SELECT pair_id, 'r', token FROM p JOIN o ON o.row_id = p.r),
    u AS (SELECT DISTINCT pair_id, token FROM s), ur AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u x JOIN w ON w.node = x.token WHERE x.pair_id = u.pair_id AND w.anc = u.token)),
    m AS (SELECT pair_id, COUNT(*) FILTER (NOT EXISTS (SELECT 1 FROM s WHERE s.pair_id = ur.pair_id AND s.side = 'l' AND s.token = ur.token)) AS ml,
      COUNT(*) FILTER (NOT EXISTS (SELECT 1 FROM s WHERE s.pair_id = ur.pair_id AND s.side = 'r' AND s.token = ur.token)) AS mr FROM ur GROUP BY pair_id)
    SELECT pair_id, ml <= 1 AS left_ok, mr <= 1 AS right_ok FROM m"""
)
def breadcrumb_screening(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer held against the next by their words, one missing word allowed."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("left"))
    p = c.join(c.select((F.col("left") - 1).alias("pair_id"), F.col("left").alias("right")), F.col("left") == F.col("pair_id")).select("pair_id", "left", "right")
    return lexical.breadcrumb_screening(p, _tokens(spark, sf), _words(spark, sf), 1)


@query(
    """WITH w AS (SELECT DISTINCT label FROM cat_data WHERE label IS NOT NULL), t AS (SELECT label, [x FOR x IN regexp_extract_all(lower(label), '[\\p{L}\\p{N}]+') IF x NOT IN
     ('a', 'an', 'and', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'other', 'the', 'to', 'with')] AS ws FROM w),
    l AS (SELECT label, [CASE WHEN length(x) > 4 AND x LIKE '%ies' THEN x[:-4] || 'y' WHEN length(x) > 4 AND regexp_matches(x, '(?:ss|sh|ch|x|z)es$') THEN x[:-3]
      WHEN length(x) > 3 AND x LIKE '%s' AND NOT regexp_matches(x, '(?:ss|us|is)$') THEN x[:-2] ELSE x END FOR x IN ws] AS ls FROM t)
    SELECT label, array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), ' ') AS tokens FROM l"""
)
def token_set(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "cat_data").where(F.col("label").isNotNull()).select("label").distinct()
    return labels.select("label", F.array_join(lexical.token_set(F.col("label")), " ").alias("tokens"))


def _token_key(source: str) -> str:
    """SQL of (label, id, k) with the token set of each label of ``source``, as in token_set."""
    return f"""(SELECT label, id, array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), ' ') AS k FROM
     (SELECT label, id, [CASE WHEN length(x) > 4 AND x LIKE '%ies' THEN x[:-4] || 'y' WHEN length(x) > 4 AND regexp_matches(x, '(?:ss|sh|ch|x|z)es$') THEN x[:-3]
      WHEN length(x) > 3 AND x LIKE '%s' AND NOT regexp_matches(x, '(?:ss|us|is)$') THEN x[:-2] ELSE x END FOR x IN ws] AS ls FROM
     (SELECT label, id, [x FOR x IN regexp_extract_all(lower(label), '[\\p{{L}}\\p{{N}}]+') IF x NOT IN
     ('a', 'an', 'and', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'other', 'the', 'to', 'with')] AS ws FROM {source})))"""


@query(
    f"""WITH c AS {_token_key("(SELECT DISTINCT label, 0 AS id FROM cat_data WHERE label IS NOT NULL)")},
    n AS {_token_key("(SELECT label, id FROM taxo_nodes WHERE label IS NOT NULL)")},
    m AS (SELECT k, MAX(id) AS id FROM n WHERE k <> '' GROUP BY k)
    SELECT c.label, m.id AS match FROM c LEFT JOIN m ON m.k = c.k"""
)
def lexical_match(spark: SparkSession, sf: str) -> DataFrame:
    """Every label with the node of its token set, or null."""
    c = table(spark, sf, "cat_data").where(F.col("label").isNotNull()).select("label").distinct()
    return lexical.lexical_match(c, table(spark, sf, "taxo_nodes").select("id", "label")).select("label", "match")


# -- training data


@query(f"WITH {GEO_SQL} SELECT tgt AS cluster_id, CAST(COUNT(*) AS BIGINT) AS n, MIN(src) AS first, MAX(src) AS last FROM e GROUP BY tgt HAVING COUNT(*) > 1")
def emb_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return traindata.cluster_sizes(traindata.child_clusters(geo(spark, sf).edges))


@query(
    f"""WITH {GEO_SQL}, o AS (SELECT tgt, src, row_number() OVER (PARTITION BY tgt ORDER BY src) - 1 AS i, COUNT(*) OVER (PARTITION BY tgt) AS n FROM e)
    SELECT a.tgt AS cluster_id, a.src AS a, b.src AS b FROM o a JOIN o b ON a.tgt = b.tgt AND a.i < b.i
    CROSS JOIN (SELECT unnest(range(1, 3)) AS k) WHERE a.n > 1 AND k <= 2 // (a.n - 1)
    UNION ALL SELECT a.tgt, a.src, b.src FROM o a JOIN o b ON a.tgt = b.tgt AND a.i < b.i WHERE a.n > 1 AND least(b.i - a.i, a.n - (b.i - a.i)) <= (2 % (a.n - 1)) // 2
    UNION ALL SELECT a.tgt, a.src, b.src FROM o a JOIN o b ON a.tgt = b.tgt AND a.i < b.i WHERE a.n > 1 AND (2 % (a.n - 1)) % 2 <> 0 AND a.n % 2 = 0 AND b.i - a.i = a.n // 2"""
)
def cluster_sample(spark: SparkSession, sf: str) -> DataFrame:
    return traindata.cluster_pairs(geo(spark, sf).edges, 2).select("cluster_id", "a", "b")


@query(
    f"""WITH {GEO_SQL}, s AS (SELECT tgt, COUNT(*) AS n FROM e GROUP BY tgt HAVING COUNT(*) > 1)
    SELECT tgt AS cluster_id, CAST((3 // (n - 1)) * n * (n - 1) // 2 + n * ((3 % (n - 1)) // 2) + CASE WHEN (3 % (n - 1)) % 2 <> 0 AND n % 2 = 0 THEN n // 2 ELSE 0 END AS BIGINT) AS pairs FROM s"""
)
def num_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = geo(spark, sf).edges.groupBy(F.col("tgt").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return c.select("cluster_id", traindata.num_pairs(F.col("n"), 3).alias("pairs"))


@query(GEO_C + "SELECT node AS sub, anc AS sup FROM c WHERE dist <= 2")
def sub_positives(spark: SparkSession, sf: str) -> DataFrame:
    return traindata.subsumption_positives(geo(spark, sf))


@query(
    PART_C
    + _QM
    + _LCA
    + """, one AS (SELECT a, b, MIN(anc) AS anc FROM lc GROUP BY a, b)
    SELECT qp.a || '_' || qp.b AS cluster_key, 'summarize: ' || x.label || '[SEP]' || y.label AS text, z.label AS summary
    FROM qp JOIN n x ON x.id = qp.a JOIN n y ON y.id = qp.b LEFT JOIN one ON one.a = qp.a AND one.b = qp.b LEFT JOIN n z ON z.id = one.anc"""
)
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    c = _pairs(spark, sf).select(F.col("query_id").alias("cluster_key"), F.array("a", "b").alias("members"))
    return traindata.prompts(part(spark, sf), c)


_SHARED = """, top AS (SELECT node, anc FROM c WHERE anc <> 0), q AS (SELECT DISTINCT node FROM c WHERE anc = 0 AND node % 50 = 0),
 av AS (SELECT q.node, (SELECT COUNT(DISTINCT node) FROM c WHERE anc = 0) - COUNT(DISTINCT x.node) - CASE WHEN COUNT(DISTINCT x.node) = 0 THEN 1 ELSE 0 END AS n
   FROM q LEFT JOIN top t ON t.node = q.node LEFT JOIN top x ON x.anc = t.anc GROUP BY q.node)"""


@query(GEO_C + _SHARED + " SELECT node AS query, CAST(least(7, n) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_related FROM av WHERE n > 0")
def unrelated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """How many of seven unrelated nodes were drawn for every id divisible by 50 (all seven, wherever there are as many), and how many of them share an ancestor."""
    t = geo(spark, sf)
    drawn = Scratch(spark, "drawn").keep(traindata.negatives(t, t.nodes.where(F.col("id") % 50 == 0).select("id"), 7))
    up = t.closure().where(F.col("anc") != 0).select("node", "anc")
    shared = drawn.join(up.withColumnRenamed("node", "query"), "query").join(up.select(F.col("node").alias("negative"), "anc"), ["negative", "anc"], "left_semi").select("query", "negative").distinct()
    marked = drawn.join(shared.withColumn("_s", F.lit(1)), ["query", "negative"], "left")
    return marked.groupBy("query").agg(F.countDistinct("negative").alias("n"), F.count("_s").alias("n_related"))


_POSITIVE_COUNT = "SELECT node AS sub, COUNT(*) AS n FROM c WHERE dist <= 2 GROUP BY node"


@query(GEO_C + f" SELECT sub, CAST(2 * n AS BIGINT) AS n_easy, CAST(n AS BIGINT) AS n_hard, CAST(0 AS BIGINT) AS n_wrong FROM ({_POSITIVE_COUNT})")
def negative_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Easy negatives at a rate of two and hard ones at a rate of one, by subclass, and how many of them are ancestors after all."""
    t = geo(spark, sf)
    scratch = Scratch(spark, "drawn")
    pos = scratch.keep(traindata.subsumption_positives(t))
    easy = traindata.easy_negatives(t, pos, 2).select("sub", "sup", F.lit(1).alias("easy"), F.lit(0).alias("hard"))
    hard = traindata.hard_negatives(t, pos, 1).select("sub", "sup", F.lit(0).alias("easy"), F.lit(1).alias("hard"))
    wrong = t.closure().select(F.col("node").alias("sub"), F.col("anc").alias("sup"), F.lit(1).alias("wrong"))
    rows = scratch.keep(easy.unionByName(hard)).join(wrong, ["sub", "sup"], "left")
    return rows.groupBy("sub").agg(F.sum("easy").alias("n_easy"), F.sum("hard").alias("n_hard"), F.count("wrong").alias("n_wrong"))


@query("WITH n AS (SELECT DISTINCT l_orderkey AS seed, l_partkey AS id FROM lineitem WHERE l_partkey <> l_orderkey) SELECT seed, seed AS a, id AS b FROM n")
def seed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of each seed with what was retrieved for it, orders standing for seeds and their parts for what they retrieve."""
    n = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("seed"), F.col("l_partkey").alias("id"))
    return enrich.pair_bases(n).select(F.col("a").alias("seed"), "a", "b")


@query(
    f"""WITH {GEO_SQL}, x AS (SELECT CAST(2000000000 + n_nationkey AS BIGINT) AS id, lower(n_name) AS label FROM nation UNION ALL SELECT 3000000000 + c_custkey, c_name FROM customer
      UNION ALL SELECT 9000000000 + s_suppkey, s_name FROM supplier)
    SELECT x.id, CAST(CASE WHEN n.id IS NULL THEN 0 WHEN n.label = x.label THEN 1 ELSE 2 END AS INTEGER) AS code FROM x LEFT JOIN n ON n.id = x.id"""
)
def add_nodes_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with a new label, ones that stand already, and new ones."""
    n, c, s = table(spark, sf, "nation"), table(spark, sf, "customer"), table(spark, sf, "supplier")
    new = n.select((F.lit(2_000_000_000) + F.col("n_nationkey")).cast("bigint").alias("id"), F.lower("n_name").alias("label"))
    new = new.unionByName(c.select((F.lit(3_000_000_000) + F.col("c_custkey")).cast("bigint").alias("id"), F.col("c_name").alias("label")))
    new = new.unionByName(s.select((F.lit(9_000_000_000) + F.col("s_suppkey")).cast("bigint").alias("id"), F.col("s_name").alias("label")))
    return geo(spark, sf).add_nodes(new)[1]


@query(f"WITH {GEO_SQL} SELECT src, tgt FROM e WHERE NOT (tgt BETWEEN 2000000000 AND 2999999999 AND src >= 4000000000)")
def remove_edges(spark: SparkSession, sf: str) -> DataFrame:
    """What remains when no supplier is in a nation any more."""
    t = geo(spark, sf)
    return t.remove_edges(t.edges.where((F.col("src") >= 4_000_000_000) & (F.col("tgt") >= 2_000_000_000)).select("src", "tgt")).edges.select("src", "tgt")


@query(
    f"""WITH {GEO_SQL} SELECT e.src, e.tgt, CASE WHEN e.tgt = 0 THEN 'top' ELSE e.label END AS edge_label, CASE WHEN n.id % 50 = 0 THEN 'Node ' || n.id ELSE n.label END AS src_label
    FROM e JOIN n ON n.id = e.src"""
)
def relabel(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of nodes and edges, read back after some were set anew."""
    t = geo(spark, sf)
    named = t.set_labels(t.nodes.where(F.col("id") % 50 == 0).select("id", F.concat(F.lit("Node "), F.col("id").cast("string")).alias("label")))
    named = named.set_edge_labels(t.edges.where(F.col("tgt") == 0).select("src", "tgt", F.lit("top").alias("label")))
    pairs = named.edge_labels_of(t.edges.select("src", "tgt")).select("src", "tgt", F.col("label").alias("edge_label"))
    who = named.labels_of(t.edges.select(F.col("src").alias("node")).distinct()).select(F.col("node").alias("src"), F.col("label").alias("src_label"))
    return pairs.join(who, "src").select("src", "tgt", "edge_label", "src_label")


@query(GEO_C + " SELECT n.id, CAST(COUNT(c.anc) AS BIGINT) AS depth FROM n LEFT JOIN c ON c.node = n.id GROUP BY n.id")
def tree_depth(spark: SparkSession, sf: str) -> DataFrame:
    t = geo(spark, sf)
    return TreeTaxonomy(t.nodes, t.edges).depth()


@query()
def contrastive_triples(spark: SparkSession, sf: str) -> DataFrame:
    return traindata.contrastive_triples(geo(spark, sf), n_negatives=3)


@query()
def generation_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return traindata.generation_prompts(geo(spark, sf))


@query()
def subsumption_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return traindata.subsumption_pairs(geo(spark, sf))



@query(
    """WITH s AS (SELECT labels, CASE WHEN superclass = 'All Products' THEN 1 ELSE 0 END AS p FROM sub_pairs WHERE superclass IS NOT NULL),
    c AS (SELECT SUM(labels * p) * 1.0 AS tp, SUM((1 - labels) * p) AS fp, SUM(labels * (1 - p)) AS fn, SUM((1 - labels) * (1 - p)) AS tn FROM s)
    SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"""
)
def classifier_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the rule "everything is a product" on the labelled pairs."""
    s = table(spark, sf, "sub_pairs").where(F.col("superclass").isNotNull())
    return models.classifier_metrics(s.select(F.col("labels").alias("label"), (F.col("superclass") == "All Products").cast("int").alias("predicted")))


@query()
def text_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """n-gram overlap of each prompt's summary with its source text."""
    g = table(spark, sf, "gen_prompts").where(F.col("summary").isNotNull() & F.col("text").isNotNull())
    return g.select("row_id", F.round(models.ngram_overlap(F.lower("text"), F.lower("summary")), 6).alias("overlap"))


# -- tables to taxonomies


@query(
    """WITH i AS (SELECT *, [trim(x) FOR x IN string_split(id_breadcrumb, '>') IF trim(x) <> ''] AS ids FROM big7_data)
    SELECT site_id || '_' || cat_id AS key, COALESCE(cfn, cat_name) AS label, CAST(COALESCE(len(ids), 0) AS BIGINT) AS level,
      CASE WHEN len(ids) >= 2 THEN site_id || '_' || ids[-2] ELSE CAST(site_id AS VARCHAR) END AS parent, lower(parent_leaf) = 'leaf' AS leaf, meta, test_cat = 'Y' AS test, other = 'Y' AS other FROM i"""
)
def breadcrumb_etl(spark: SparkSession, sf: str) -> DataFrame:
    return src.breadcrumb_table(table(spark, sf, "big7_data"))


@query(
    """WITH r AS (SELECT o_orderkey AS k, o_custkey % 3 + 1 AS lv, 'n' || o_orderkey AS name FROM orders),
    w AS (SELECT *, MAX(CASE WHEN lv < 2 THEN k END) OVER p AS a1, MAX(CASE WHEN lv < 3 THEN k END) OVER p AS a2 FROM r WINDOW p AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT k AS key, name, CAST(lv AS INTEGER) AS level, COALESCE(CASE lv WHEN 2 THEN a1 WHEN 3 THEN a2 END, 0) AS parent FROM w"""
)
def level_etl(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a level table: the level in which the name stands depends on the customer."""
    o = table(spark, sf, "orders")
    lv = [F.when(F.col("o_custkey") % 3 == i, F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))).alias(f"l{i + 1}") for i in range(3)]
    return src.level_table(o.select(F.col("o_orderkey").alias("CategoryID"), *lv), ["l1", "l2", "l3"], "CategoryID")


@query("SELECT b.site_id || '_' || b.cat_id AS \"Key\", b.cat_name, s.site_code AS \"Other Category\" FROM big7_data b LEFT JOIN (SELECT * FROM sites WHERE closed_at IS NOT NULL) s ON s.site_id = b.site_id")
def merge_etl(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "big7_data").select("site_id", F.concat_ws("_", "site_id", "cat_id").alias("Key"), "cat_name")
    s = table(spark, sf, "sites").select("site_id", F.when(F.col("closed_at").isNotNull(), F.col("site_code")).alias("Other Category"))
    return src.merge_tables(b, [s], on="site_id").select("Key", "cat_name", "Other Category")


@query("SELECT vec_id, CASE WHEN n = 0 THEN '0B' WHEN n < 1024 THEN CAST(n AS DOUBLE) || 'B' WHEN n < 1048576 THEN round(n / 1024.0, 2) || 'KB' ELSE round(n / 1048576.0, 2) || 'MB' END AS size FROM (SELECT vec_id, vec_id * vec_id AS n FROM embeddings)")
def size_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", src.human_size(F.col("vec_id") * F.col("vec_id")).alias("size"))


# -- pipelines with the stand-in models


def _acyclic(spark: SparkSession, sf: str) -> Taxonomy:
    """The project's own taxonomy without the edges on its cycles, every top under the root concept."""
    t = _own(spark, sf)
    scratch = Scratch(spark, "own")
    edges = scratch.keep(t.edges.join(cl.cyclic_edges(t.edges), ["src", "tgt"], "left_anti"))
    whole = Taxonomy(scratch.keep(t.nodes), edges.fillna("original", ["label"])).attach_root()
    return Taxonomy(scratch.keep(whole.nodes), scratch.keep(whole.edges))


def _label_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, embedding): the usable label vectors, one per category."""
    v = table(spark, sf, "label_vectors").where(F.size("embedding") == 64)
    v = v.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists("embedding", lambda x: x != 0))
    one = v.groupBy(F.col("cat_id").alias("id")).agg(F.min("embedding").alias("embedding"))
    return Scratch(spark, "vectors").keep(one.select("id", vectors.unit(F.col("embedding")).alias("embedding")))


@query()
def enrich_seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts generated between every category whose id is divisible by 50 and its nearest ones among all, placed and inserted: the new edges."""
    t, v = _acyclic(spark, sf), _label_vectors(spark, sf)
    seeds = t.nodes.where((F.col("id") % 50 == 0) & (F.col("id") != 0)).select("id")
    grown, _, _ = enrich.enrich_seeds(t, seeds, v, models.common_words, InsertionConfig(retrieve_size=10, threshold=0.5), update=True)
    name = grown.nodes.select("id", "label")
    new = grown.edges.where(F.col("label") == "new").select("src", "tgt")
    named = new.join(name.select(F.col("id").alias("src"), F.col("label").alias("sub")), "src").join(name.select(F.col("id").alias("tgt"), F.col("label").alias("sup")), "tgt")
    return named.select("src", "tgt", "sub", "sup")


@query()
def move_retrieved(spark: SparkSession, sf: str) -> DataFrame:
    """Every leaf whose id is divisible by 50 re-homed: parents retrieved among all categories, selected by both features, moved. Gives the targets'
    edges before and after."""
    t, v = _acyclic(spark, sf), _label_vectors(spark, sf)
    targets = t.leaves().where(F.col("id") % 50 == 0).select("id")
    plan = Scratch(spark, "plan").keep(move.predict_moves(t, targets, v, MoveConfig(method="rag", candidate_top_level=0, candidate_bottom_level=1)))
    after, _, _ = move.apply_moves(t, plan)
    edges = lambda x, when: x.edges.join(targets.withColumnRenamed("id", "src"), "src", "left_semi").select(F.lit(when).alias("state"), "src", "tgt", "label")
    return edges(t, "before").unionByName(edges(after, "after"))


@query()
def manual_placement(spark: SparkSession, sf: str) -> DataFrame:
    """Places a narrower concept, named after it, below every category whose id is divisible by 50."""
    t = _acyclic(spark, sf)
    q = t.nodes.where((F.col("id") % 50 == 0) & (F.col("id") != 0) & F.col("label").isNotNull())
    q = Scratch(spark, "asked").keep(q.select("id", F.concat(F.lit("Deluxe "), "label").alias("label"), F.col("id").alias("query_id")))
    placed = enrich.place(t, q, q.select("query_id", F.col("id").alias("node")), InsertionConfig(threshold=0.6))
    return placed.log.select("label", "node", "role", F.round("p_sup", 6).alias("p_sup"), F.round("p_sub", 6).alias("p_sub"))

from taxograft.model import EDGE_SCHEMA, NODE_SCHEMA, Taxonomy


def make(spark, edges, labels=None, extra=()):
    """A taxonomy from (src, tgt[, label]) tuples; isolated nodes in ``extra``."""
    edges = [(e[0], e[1], e[2] if len(e) > 2 else "original", None) for e in edges]
    ids = sorted({x for e in edges for x in e[:2]} | set(extra))
    labels = labels or {}
    return Taxonomy(spark.createDataFrame([(i, labels.get(i, f"n{i}"), None) for i in ids], NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA))


def one(spark, *nodes, q="q"):
    return spark.createDataFrame([(q, n) for n in nodes], "query_id string, node bigint")


def column(df, name):
    return sorted(r[name] for r in df.collect())


def rows(df, *names):
    return sorted(tuple(r[n] for n in (names or df.columns)) for r in df.collect())

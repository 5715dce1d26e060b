"""Vector stores: exact top-k search in blocks of queries, cell-pruned search, unit vectors, similarity, retrieval recall."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxograft.session import Scratch

#: Queries are broadcast in blocks of at most so many numbers (32 MB).
BLOCK_NUMBERS = 4_000_000
#: Rows of a slice, and queries of a block, that meet in one matrix product where queries are many or cells are searched.
SLICE = 20_000


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(x, np.float64) for x in column])


def _best(q: np.ndarray, batches: Iterable[tuple[np.ndarray, np.ndarray]], k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best of all batches (ids, vectors) for each query, ties by id; higher scores are better for either metric."""
    best_s, best_i = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
    for ids, v in batches:
        for a in range(0, len(v), 4096):
            w = v[a : a + 4096]
            s = q @ w.T
            if metric == "l2":
                s = 2 * s - (q * q).sum(1)[:, None] - (w * w).sum(1)[None, :]
            s = np.hstack([best_s, s])
            i = np.hstack([best_i, np.broadcast_to(ids[a : a + 4096], (len(q), len(w)))])
            if s.shape[1] > k:
                order = np.lexsort((i, -s), axis=1)[:, :k]
                s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            best_s, best_i = s, i
    return best_i, best_s


def _scored(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, metric: str) -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.repeat(qids, ids.shape[1]), "id": ids.ravel(), "score": (-scores if metric == "l2" else scores).ravel()})


def _sliced(queries: DataFrame, rows: DataFrame, k: int, metric: str, on: str | None = None) -> DataFrame:
    """(query_id, id, score): the k best of every slice of the rows for each query, by matrix products; with ``on`` only rows with the query's value
    of that column. Rows are cut into slices of about SLICE by hash, a large cell into several; queries into blocks of as many.
    A query goes to every slice (of its cell), a row to every block."""
    key = F.col(on) if on else F.lit(0)
    # both sides may come from one frame, so their columns are named apart
    base = rows.select(F.col("id").alias("_id"), F.col("embedding").alias("_v"), key.alias("_c"))
    asked = queries.select(F.col("query_id").alias("_qid"), F.col("embedding").alias("_q"), key.alias("_c"))
    parts = base.groupBy("_c").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("_slices"))
    blocks = asked.groupBy("_c").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("_blocks"))
    size = parts.join(blocks, "_c")
    all_of = lambda n, name: F.explode(F.sequence(F.lit(0), n - 1)).alias(name)
    scratch = Scratch(rows.sparkSession, "slices")
    size = scratch.keep(size)
    r = base.join(size, "_c").select("_id", "_v", "_c", F.pmod(F.xxhash64("_id"), F.col("_slices")).cast("int").alias("_s"), all_of(F.col("_blocks"), "_b"))
    q = asked.join(size, "_c").select("_qid", "_q", "_c", F.pmod(F.xxhash64("_qid"), F.col("_blocks")).cast("int").alias("_b"), all_of(F.col("_slices"), "_s"))
    q = q.toDF("_qid", "_q", "_c2", "_b2", "_s2")
    r = r.toDF("_id", "_v", "_c", "_s", "_b")

    def score(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(block):
            return pd.DataFrame({"query_id": block["_qid"][:0], "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        v, ids, m, qids = _matrix(part["_v"]), part["_id"].to_numpy(), _matrix(block["_q"]), block["_qid"].to_numpy()
        return pd.concat([_scored(qids[a : a + 512], *_best(m[a : a + 512], [(ids, v)], k, metric), metric) for a in range(0, len(m), 512)])

    kind = f"query_id {dict(queries.dtypes)['query_id']}, id long, score double"
    return r.groupBy("_c", "_s", "_b").cogroup(q.groupBy("_c2", "_s2", "_b2")).applyInPandas(score, kind)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "ip", subset: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best rows per query; ``ip`` by descending inner product, ``l2`` by ascending squared distance,
    ties by id. ``queries`` has query_id and embedding, ``vectors`` id and embedding; ``subset`` (id) restricts the rows searched.

    Exact. Queries that fit one block of BLOCK_NUMBERS numbers are broadcast against one scan of the vectors, which never move; more of them meet
    the vectors slice by slice. Every partition or slice keeps its k best per query before the final ranking. Null vectors, and those of
    another length than the first query's, are left out; fewer than k rows give fewer results.
    """
    first = queries.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
    kind = f"query_id {dict(queries.dtypes)['query_id']}, id long, score double"
    spark = queries.sparkSession
    if first is None:
        return spark.createDataFrame([], kind + ", rank int")
    dim = first[0]
    rows = vectors.where(F.size("embedding") == dim).select("id", "embedding")
    if subset is not None:
        rows = rows.join(subset.select("id").distinct(), "id", "left_semi")
    asked = queries.where(F.size("embedding") == dim).select("query_id", "embedding")
    most = max(1, BLOCK_NUMBERS // max(1, dim))
    block = asked.limit(most + 1).toPandas()  # one block at most, the setting's size
    if len(block) <= most:
        shared = spark.sparkContext.broadcast((block["query_id"].to_numpy(), _matrix(block["embedding"])))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, q = shared.value
            ids, scores = _best(q, ((b["id"].to_numpy(), _matrix(b["embedding"])) for b in batches if len(b)), k, metric)
            if ids.shape[1]:
                yield _scored(qids, ids, scores, metric)

        out = rows.mapInPandas(score, kind)
    else:
        out = _sliced(asked, rows, k, metric)
    better = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    w = Window.partitionBy("query_id").orderBy(better, "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class VectorStore:
    """Vectors by id with add, delete, reconstruct, search and an optional cell index. Immutable, as frames are."""

    def __init__(self, vectors: DataFrame, normalise: bool = False):
        v = vectors.where(F.col("id").isNotNull() & F.col("embedding").isNotNull()).select("id", "embedding")
        self.vectors = v.withColumn("embedding", unit(F.col("embedding"))) if normalise else v
        self.cells: DataFrame | None = None
        self.centroids: np.ndarray | None = None

    @property
    def ntotal(self) -> int:
        return self.vectors.count()

    def concepts(self) -> DataFrame:
        return self.vectors.select("id").distinct()

    def add(self, vectors: DataFrame) -> VectorStore:
        return VectorStore(self.vectors.unionByName(vectors.select("id", "embedding")))

    def delete(self, ids: DataFrame) -> VectorStore:
        return VectorStore(self.vectors.join(ids.select("id"), "id", "left_anti"))

    def reconstruct(self, ids: DataFrame) -> DataFrame:
        return self.vectors.join(ids.select("id"), "id", "left_semi")

    def covers(self, ids: DataFrame) -> bool:
        """Whether the store holds exactly these ids."""
        a, b = self.concepts(), ids.select("id").distinct()
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def search(self, queries: DataFrame, k: int = 5, subset: DataFrame | None = None, metric: str = "ip", nprobe: int | None = None) -> DataFrame:
        """Exact without ``nprobe``; else among the rows of each query's nearest cells, of an index built before."""
        if nprobe is None:
            return top_k(queries, self.vectors, k, metric, subset)
        if self.cells is None:
            raise ValueError("build cells before a cell search")
        return self._probe(queries, k, subset, metric, nprobe)

    def train_cells(self, sample_rows: int = 50_000, rounds: int = 8, seed: int = 7, on: DataFrame | None = None) -> VectorStore:
        """Fit centroids on a bounded sample of ``sample_rows`` vectors (of ``on``, if given), then assign every row to its nearest.

        There are sqrt(N) of them, but no more than a tenth of the sample, so that neither the sample nor the centroids grow with the store;
        cells that hold more rows for it are searched in slices. Vectors of another length than the first by id, null or non-finite ones are in
        no cell and never found.
        """
        n = self.ntotal
        given = self.vectors if on is None else on.select("id", "embedding")
        first = given.where(F.size("embedding") > 0).orderBy("id").select(F.size("embedding").alias("d")).first()
        dim = first["d"] if first else 0
        fine = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1e300))
        picked = given.where(fine).orderBy(F.xxhash64("id", F.lit(seed))).limit(sample_rows).select("embedding").toPandas()
        out = VectorStore(self.vectors)
        if not len(picked):
            out.centroids = np.zeros((1, max(1, dim)))
        else:
            m = _matrix(picked["embedding"])
            rng = np.random.default_rng(seed)
            c = m[rng.choice(len(m), max(1, min(math.isqrt(n), -(-len(m) // 10))), replace=False)]
            for _ in range(rounds):
                near = np.concatenate([np.argmin((c * c).sum(1)[None, :] - 2 * m[a : a + 4096] @ c.T, axis=1) for a in range(0, len(m), 4096)])
                sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))
                np.add.at(sums, near, m)
                c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
            out.centroids = c
        rows = self.vectors.where(fine)
        out.cells = Scratch(self.vectors.sparkSession, "cells").keep(self._assigned(rows, out.centroids, 1, "id long, embedding array<double>, cell int", ["id"]))
        return out

    def probes_for(self, recall: float = 0.95, k: int = 10, sample_queries: int = 64, metric: str = "ip", seed: int = 7) -> int:
        """How many cells to probe for the recall: the exact neighbours of ``sample_queries`` vectors are looked up, and the smallest number of cells
        taken that would have held the share of them."""
        if self.cells is None:
            raise ValueError("build cells first")
        q = self.vectors.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample_queries).select(F.col("id").alias("query_id"), "embedding")
        q = Scratch(q.sparkSession, "probe").keep(q)
        cell_of = self.cells.select("id", "cell")
        found = top_k(q, self.vectors, k, metric).join(cell_of, "id").select("query_id", "cell").collect()  # sample_queries * k rows
        c = self.centroids
        place = {}
        for r in q.collect():
            v = np.asarray(r["embedding"], np.float64)
            far = -(c @ v) if metric == "ip" else (c * c).sum(1) - 2 * c @ v
            place[r["query_id"]] = {int(cell): i for i, cell in enumerate(np.argsort(far, kind="stable"), 1)}
        needed = sorted(place[r["query_id"]][r["cell"]] for r in found)
        return needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)] if needed else 1

    def _assigned(self, rows: DataFrame, centroids: np.ndarray, n: int, kind: str, keys: list[str], metric: str = "l2") -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = shared.value
            for batch in batches:
                if len(batch):
                    m = _matrix(batch["embedding"])
                    far = -(m @ c.T) if metric == "ip" else (c * c).sum(1)[None, :] - 2 * m @ c.T
                    near = np.argpartition(far, min(n, far.shape[1]) - 1, axis=1)[:, :n]
                    at = np.repeat(np.arange(len(m)), near.shape[1])
                    yield pd.DataFrame({**{k: batch[k].to_numpy()[at] for k in keys}, "embedding": [m[i] for i in at], "cell": near.ravel().astype(np.int32)})

        return rows.select(*keys, "embedding").mapInPandas(assign, kind)

    def _probe(self, queries: DataFrame, k: int, subset: DataFrame | None, metric: str, nprobe: int) -> DataFrame:
        dim = self.centroids.shape[1]
        asked = queries.where(F.size("embedding") == dim)
        kind = f"query_id {dict(queries.dtypes)['query_id']}, embedding array<double>, cell int"
        q = Scratch(queries.sparkSession, "asked").keep(self._assigned(asked, self.centroids, nprobe, kind, ["query_id"], metric))
        rows = self.cells if subset is None else self.cells.join(subset.select("id").distinct(), "id", "left_semi")
        found = _sliced(q, rows, k, metric, "cell")
        better = F.col("score").asc() if metric == "l2" else F.col("score").desc()
        w = Window.partitionBy("query_id").orderBy(better, "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def entity_unit_vectors(entities: DataFrame, vectors: DataFrame, nodes: DataFrame, embedder: Callable[[Column], Column]) -> DataFrame:
    """(query_id, embedding): a vector of length 1 for each entity (query_id, id, text): that of a concept in ``vectors``, else of the label of a
    node, else of the text. An entity that is none of these is an error."""
    known = vectors.select(F.col("id").alias("_v"), "embedding")
    labels = nodes.select(F.col("id").alias("_n"), "label")
    found = entities.join(known, F.col("id") == F.col("_v"), "left").join(labels, F.col("id") == F.col("_n"), "left")
    named = Scratch(entities.sparkSession, "entities").keep(found.select("query_id", "embedding", F.coalesce("label", "text").alias("_t")))
    if not named.where(F.col("embedding").isNull() & F.col("_t").isNull()).isEmpty():
        raise ValueError("an entity is neither a concept nor a text to embed")
    ready = named.where(F.col("embedding").isNotNull()).select("query_id", unit(F.col("embedding")).alias("embedding"))
    made = named.where(F.col("embedding").isNull()).select("query_id", unit(embedder(F.col("_t"))).alias("embedding"))
    return ready.unionByName(made)


def hit_at_ratio(knn: DataFrame, clusters: DataFrame, probes: DataFrame, steps: int = 20) -> DataFrame:
    """(ratio, recall, spread): mean over probes of |first ceil(x n) neighbours in the reference| / n for x = 0.1 ... steps/10.

    ``clusters`` is (cluster_id, id), ``probes`` (probe_id, id), ``knn`` (query_id = id, id, rank). A probe's reference is every member of
    all its clusters, n their number. ``spread`` is 1.96 population standard deviations over the root of the number of probes.
    """
    c = clusters.select("cluster_id", "id").distinct()
    ref = probes.select("probe_id", "id").join(c, "id").select("probe_id", "cluster_id").join(c, "cluster_id").select("probe_id", "id").distinct()
    n = ref.groupBy("probe_id").agg(F.count(F.lit(1)).alias("n"))
    near = probes.select("probe_id", F.col("id").alias("query_id")).join(knn.select("query_id", F.col("id").alias("other"), "rank"), "query_id")
    hits = near.join(ref.select("probe_id", F.col("id").alias("other")), ["probe_id", "other"], "left_semi").select("probe_id", "rank")
    grid = n.select("probe_id", "n", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    limit = F.floor((F.col("step") * F.col("n") + 9) / 10)
    counted = grid.join(hits, "probe_id", "left").groupBy("probe_id", "n", "step").agg(F.sum(F.when(F.col("rank") <= limit, 1).otherwise(0)).alias("hits"))
    share = F.col("hits") / F.col("n")
    return counted.groupBy("step").agg(F.avg(share).alias("recall"), (1.96 * F.stddev_pop(share) / F.sqrt(F.count(F.lit(1)))).alias("spread")).select(
        (F.col("step") / 10.0).alias("ratio"), "recall", "spread"
    )

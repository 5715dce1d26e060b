"""The most similar vectors of every vector: a hash-prefix forest over random-hyperplane hash strings.

Each tree hashes every vector to a string of 63 bits and keeps the strings as one sorted array, in which the vectors that share a
prefix stand together. A query descends in every tree to its longest prefix match; then all trees ascend in step, one bit
at a time, until the vectors that share the remaining prefix with it are enough over all trees together. So every query has a prefix length of its own: long where
vectors are dense, short where they are sparse. A first pass over the arrays counts, for every vector, the sharers by length and adds
them over the trees; a second one scores all pairs of which either shares the other's prefix, by matrix products, and keeps those
that may reach the minimum. They are verified exactly.

The number of trees follows from the number of vectors, so that the chance of never meeting a pair at the minimum similarity stays the
same at any size. Arrays are spread over partitions by tree and leading bits, which is as far as trees ascend: no
prefix reaches over a partition's border and the rows do not depend on the number of partitions.

Copies (whatever their lengths) are collapsed before, so a vector that a third of all rows share costs as much as any other.
Groups of many different vectors around one direction have no prefixes that tell them apart: they are found by the width of the
trees' prefix buckets and searched exactly, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxograft.session import Scratch

#: Bits of a hash string, dimensions, seed, and how far a cosine of vectors rounded to bytes may lie from the exact one.
BITS, DIM, SEED, MARGIN = 63, 64, 20240607, 0.012
#: Vectors per tree at which ascending stops, chance that a pair at the minimum similarity never meets at that width, prefix lengths
#: below and above the usual one between which queries differ.
BUCKET, MISS, ABOVE, BELOW = 96, 1e-3, 4, 10
#: Distance of unit vectors whose float32 originals differ by length only; projections and cell width that find them.
SAME, PROJECTIONS, CELL = 2.5e-7, 4, 2e-5
#: Vectors of a group from which on it is searched exactly (smaller ones fit the trees' buckets), trees whose buckets
#: show the groups, vectors of a block.
WIDE, PIVOT_TREES, BLOCK = 600, 4, 4096


def _planes(tree: int, dim: int) -> np.ndarray:
    return np.random.default_rng(SEED + tree).standard_normal((dim, BITS)).astype(np.float32)


def forest_size(n: int, min_similarity: float, bucket: int = BUCKET) -> tuple[int, int]:
    """The number of trees and the prefix length at which a tree's buckets hold ``bucket`` of ``n`` vectors on average.

    Two vectors at the minimum similarity agree in a bit with probability 1 - angle / pi, in a prefix with a power of it; with so many
    trees the chance that they share it in none is MISS.
    """
    length = max(0.0, log2(max(1, n) / bucket))
    together = (1 - acos(min(1.0, min_similarity)) / pi) ** length
    trees = 4 if together > 0.9 else max(4, ceil(log(MISS) / log(1 - together)))
    return trees, int(length)


def unit_vectors(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, unit) of the usable vectors: ``dim`` finite numbers, not all zero. Of several rows of one id the one with the
    smallest content counts. ``unit`` holds float64 of length 1 as bytes."""

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = batch[[x is not None and len(x) == dim for x in batch["embedding"]]]
            if not len(keep):
                continue
            m = np.array([np.array([np.nan if v is None else v for v in x], np.float64) for x in keep["embedding"]])
            good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
            m, ids = m[good], keep["id"].to_numpy()[good]
            m = m / np.abs(m).max(axis=1, keepdims=True)
            m = m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
            yield pd.DataFrame({"id": ids, "unit": [v.tobytes() for v in m]})

    shaped = vectors.where(F.col("id").isNotNull() & F.col("embedding").isNotNull()).select("id", "embedding")
    return shaped.mapInPandas(scale, "id long, unit binary").groupBy("id").agg(F.min("unit").alias("unit"))


def copy_classes(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapse copies: (cls, unit) of each distinct direction, and (cls, id); cls is the smallest id of its class.

    Scaling a float32 vector rounds every number anew and so moves its direction by up to ``SAME``. Directions are put in cells
    by a few projections, in both cells where a border is nearer than that, so that copies always share a cell;
    each is compared with the first of its cells.
    """
    scratch = Scratch(units.sparkSession, "copies")

    @F.pandas_udf("array<long>")
    def cells(unit: pd.Series) -> pd.Series:
        import xxhash

        if not len(unit):
            return pd.Series([], dtype=object)
        m = np.frombuffer(b"".join(unit), np.float64).reshape(len(unit), -1)
        r = np.random.default_rng(SEED - 1).standard_normal((m.shape[1], PROJECTIONS))
        at = m @ (r / np.linalg.norm(r, axis=0))
        low, high = np.floor((at - SAME) / CELL).astype(np.int64), np.floor((at + SAME) / CELL).astype(np.int64)
        out = []
        for lo, hi in zip(low, high):
            places = np.array(list(product(*({a, b} for a, b in zip(lo.tolist(), hi.tolist())))), np.int64)
            out.append([xxhash.xxh64_intdigest(p.tobytes()) - (1 << 63) for p in places])
        return pd.Series(out)

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), np.float64).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.float64).reshape(len(b), -1)
        return pd.Series(np.sqrt(np.square(x - y).sum(axis=1)) <= SAME)

    placed = scratch.keep(units.select("id", "unit", F.explode(cells("unit")).alias("cell")))
    firsts = placed.groupBy("cell").agg(F.min("id").alias("first"), F.min_by("unit", "id").alias("_u"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    links = placed.join(firsts, "cell").where((F.col("first") < F.col("id")) & same("unit", "_u")).groupBy("id").agg(F.min("first").alias("first"))
    links = scratch.keep(links)
    # a first of one cell may be a copy of the first of another
    up = links.select(F.col("id").alias("first"), F.col("first").alias("_up"))
    for _ in range(2):
        links = links.join(up, "first", "left").select("id", F.coalesce("_up", "first").alias("first"))
    members = units.join(links, "id", "left").select(F.coalesce("first", "id").alias("cls"), "id", "unit")
    return members.where(F.col("id") == F.col("cls")).select("cls", "unit"), members.select("cls", "id")


def _matrix(column: pd.Series, dtype: type, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(-1, dim)


def crowded(reps: DataFrame, min_similarity: float, dim: int = DIM) -> DataFrame | None:
    """(cls, grp, own): the groups of at least ``WIDE`` vectors around one direction, ``own`` marking the nearest of several; null without any.

    Their directions are the means of prefix buckets that hold far more vectors than their share.
    """
    spark = reps.sparkSession
    n = reps.count()
    if n < WIDE:
        return None
    length = max(1, int(np.ceil(np.log2(n / BUCKET))))

    def buckets(m: np.ndarray) -> np.ndarray:
        powers = 1 << np.arange(length, dtype=np.int64)
        return np.stack([t * (1 << length) + (m @ _planes(t, dim)[:, :length] > 0) @ powers for t in range(PIVOT_TREES)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                b, c = np.unique(buckets(_matrix(batch["unit"], np.float64, dim).astype(np.float32)), return_counts=True)
                yield pd.DataFrame({"b": b, "n": c})

    counts = reps.mapInPandas(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).where(F.col("n") >= WIDE // 2)
    wide = {r["b"]: r["n"] for r in counts.collect()}  # at most PIVOT_TREES * 2 n / WIDE
    if not wide:
        return None
    shared = spark.sparkContext.broadcast(np.array(sorted(wide), np.int64))
    names = [f"d{i}" for i in range(dim)]

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = _matrix(batch["unit"], np.float64, dim)
            for b in buckets(m.astype(np.float32)):
                hit = np.isin(b, shared.value)
                if hit.any():
                    yield pd.DataFrame(m[hit], columns=names).groupby(b[hit]).sum().rename_axis("b").reset_index()

    kind = "b long, " + ", ".join(f"{x} double" for x in names)
    sums = reps.mapInPandas(total, kind).groupBy("b").agg(*[F.sum(x).alias(x) for x in names]).collect()
    found = []
    for r in sorted(sums, key=lambda r: (-wide[r["b"]], r["b"])):
        v = np.array(r[1:])
        size = float(np.linalg.norm(v))
        # a bucket around one direction has a long mean, one that merely holds many vectors has not
        if size >= 0.5 * wide[r["b"]] and (not found or np.max(np.stack(found) @ (v / size)) < 0.98):
            found.append(v / size)
    if not found:
        return None
    pivots = spark.sparkContext.broadcast(np.stack(found))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                s = _matrix(batch["unit"], np.float64, dim) @ pivots.value.T
                i, g = np.nonzero(s >= min_similarity)
                yield pd.DataFrame({"cls": batch["cls"].to_numpy()[i], "grp": g, "own": g == s[i].argmax(axis=1)})

    every = reps.mapInPandas(assign, "cls long, grp long, own boolean")
    large = every.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= WIDE)
    return every.join(F.broadcast(large), "grp")


def crowd_pairs(reps: DataFrame, groups: DataFrame, k: int, min_similarity: float, dim: int = DIM) -> DataFrame:
    """(x, y, sim): for each vector of a crowded group the k most similar ones of the group, smaller ids first, by brute force."""

    def best(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cls", kind="stable")
        here, there = part[part["block"] == key[1]], part[part["block"] == key[2]]
        out = []
        for left, right in [(here, there)] if key[1] == key[2] else [(here, there), (there, here)]:
            if not len(left) or not len(right):
                continue
            u, v = _matrix(left["unit"], np.float64, dim), _matrix(right["unit"], np.float64, dim)
            x, y = left["cls"].to_numpy(), right["cls"].to_numpy()
            for a in range(0, len(u), 512):
                s = np.round(u[a : a + 512] @ v.T, 12)
                s[x[a : a + 512, None] == y[None, :]] = -2
                last = np.partition(s, -min(k, len(y)), axis=1)[:, -min(k, len(y)), None]
                take, tied = s > last, s == last
                take |= tied & (np.cumsum(tied, axis=1) <= k - take.sum(axis=1, keepdims=True))
                i, j = np.nonzero(take & (s >= min_similarity))
                out.append(pd.DataFrame({"x": x[a + i], "y": y[j], "sim": s[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"x": [], "y": [], "sim": []})

    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    rows = groups.join(reps, "cls").select("grp", "cls", "unit", F.pmod(F.xxhash64("cls"), blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_o"))
    rows = rows.select("grp", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "cls", "unit", "block")
    near = rows.groupBy("grp", "i", "j").applyInPandas(best, "x long, y long, sim double").distinct()
    rank = Window.partitionBy("x").orderBy(F.col("sim").desc(), "y")
    top = near.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k)
    return top.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "sim").groupBy("x", "y").agg(F.max("sim").alias("sim"))


def _whole_buckets(batches: Iterator[pd.DataFrame], floor: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by tree and code, re-cut so that no bucket of the shortest prefix is parted."""
    rows: list[pd.DataFrame] = []
    held = 0
    for batch in batches:
        if not len(batch):
            continue
        rows.append(batch)
        held += len(batch)
        if held < 16_384:
            continue
        part = pd.concat(rows, ignore_index=True)
        tree, top = part["tree"].to_numpy(), part["code"].to_numpy() >> (BITS - floor)
        ends = np.nonzero((tree[1:] != tree[:-1]) | (top[1:] != top[:-1]))[0]
        if len(ends):
            yield part.iloc[: ends[-1] + 1]
            part = part.iloc[ends[-1] + 1 :]
        rows, held = [part], len(part)
    if held:
        yield pd.concat(rows, ignore_index=True)


def _bounds(tree: np.ndarray, code: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a sorted array the first place and the place behind the last that share its prefix."""
    top = code >> (BITS - length)
    starts = np.concatenate([[0], np.nonzero((tree[1:] != tree[:-1]) | (top[1:] != top[:-1]))[0] + 1])
    sizes = np.diff(np.append(starts, len(code)))
    return np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)


def _coded(reps: DataFrame, trees: int, floor: int, dim: int, ship: bool) -> DataFrame:
    """The sorted arrays of all trees: (tree, code, cls) and with ``ship`` also (grp, level, v), v being the vector in bytes."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = [_planes(t, dim) for t in range(trees)]
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            m = _matrix(batch["unit"], np.float64, dim).astype(np.float32)
            if ship:
                small = np.rint(m * (127 / np.abs(m).max(axis=1, keepdims=True))).astype(np.int8)
                short = [v.tobytes() for v in small]
            for t in range(trees):
                code = (m @ planes[t] > 0).astype(np.int64) @ powers
                out = pd.DataFrame({"tree": np.int32(t), "top": code >> (BITS - floor), "code": code, "cls": batch["cls"]})
                yield out.assign(grp=batch["grp"], level=batch["level"], v=short) if ship else out

    kind = "tree int, top long, code long, cls long" + (", grp long, level int, v binary" if ship else "")
    return reps.mapInPandas(hashes, kind).repartition("tree", "top").drop("top").sortWithinPartitions("tree", "code", "cls")


def prefix_lengths(reps: DataFrame, trees: int, floor: int, bucket: int = BUCKET, dim: int = DIM) -> DataFrame:
    """(cls, level): the longest prefix length at which the trees together hold ``trees * bucket`` other vectors that share it, at least
    ``floor`` and at most ABOVE + BELOW more."""
    lengths = [min(BITS, floor + i) for i in range(1, ABOVE + BELOW + 1)]
    field = 21  # bits of a count; three travel in one number
    most = (1 << field) // trees - 1
    packs = [lengths[i : i + 3] for i in range(0, len(lengths), 3)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _whole_buckets(batches, floor):
            tree, code = part["tree"].to_numpy(), part["code"].to_numpy()
            out = {"cls": part["cls"].to_numpy()}
            for p, pack in enumerate(packs):
                total = np.zeros(len(part), np.int64)
                for i, length in enumerate(pack):
                    low, high = _bounds(tree, code, length)
                    total += np.minimum(high - low - 1, most) << (field * i)
                out[f"p{p}"] = total
            yield pd.DataFrame(out)

    names = [f"p{p}" for p in range(len(packs))]
    kind = "cls long, " + ", ".join(f"{n} long" for n in names)
    sums = _coded(reps, trees, floor, dim, False).mapInPandas(count, kind).groupBy("cls").agg(*[F.sum(n).alias(n) for n in names])
    enough = [
        F.when(F.shiftright(f"p{p}", field * i).bitwiseAND(F.lit((1 << field) - 1)) >= min(most, trees * bucket), F.lit(length))
        for p, pack in enumerate(packs)
        for i, length in enumerate(pack)
    ]
    return sums.select("cls", F.greatest(F.lit(floor), *enough).cast("int").alias("level"))


def forest_pairs(reps: DataFrame, min_similarity: float, bucket: int = BUCKET, dim: int = DIM) -> DataFrame:
    """(x, y), x < y: distinct class pairs of which one shares, in some tree, the other's prefix, and whose cosine may reach the minimum.

    ``reps`` may name a crowded group (``grp``, -1 for none), whose own pairs are left out. Vectors travel as bytes, whose
    rounding moves a cosine by less than MARGIN; exact cosines are computed later.
    """
    if "grp" not in reps.columns:
        reps = reps.withColumn("grp", F.lit(-1).cast("long"))
    scratch = Scratch(reps.sparkSession, "levels")
    trees, usual = forest_size(reps.count(), min_similarity, bucket)
    floor = max(0, usual - ABOVE)
    levels = scratch.keep(prefix_lengths(reps, trees, floor, bucket, dim))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _whole_buckets(batches, floor):
            n = len(part)
            m = np.frombuffer(b"".join(part["v"]), np.int8).reshape(-1, dim).astype(np.float32)
            m /= np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
            tree, code, cls, grp, level = (part[c].to_numpy() for c in ("tree", "code", "cls", "grp", "level"))
            low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for length in np.unique(level).tolist():
                mine = level == length
                first, behind = _bounds(tree, code, length)
                low[mine], high[mine] = first[mine], behind[mine]
            # the last place whose own prefix reaches back to a row
            back = np.zeros(n, np.int64)
            np.maximum.at(back, low, np.arange(n))
            reach = np.maximum(high, np.maximum.accumulate(back) + 1)
            place = np.arange(n)
            step = 128
            for a in range(0, n, step):
                b = min(n, a + step)
                xs, ys = [], []
                for c in range(a, int(reach[a:b].max()), 8192):
                    d = min(c + 8192, int(reach[a:b].max()))
                    i, j = np.nonzero(m[a:b] @ m[c:d].T >= min_similarity - MARGIN)
                    i, j = i + a, j + c
                    met = (place[i] < place[j]) & ((j < high[i]) | (low[j] <= i)) & ((grp[i] < 0) | (grp[i] != grp[j]))
                    xs.append(cls[i[met]])
                    ys.append(cls[j[met]])
                if xs:
                    x, y = np.concatenate(xs), np.concatenate(ys)
                    if len(x):
                        yield pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y)}).drop_duplicates()

    array = _coded(reps.join(levels, "cls"), trees, floor, dim, True)
    return array.mapInPandas(scan, "x long, y long").where(F.col("x") != F.col("y")).distinct()


def similar_pairs(vectors: DataFrame, k: int = 10, min_similarity: float = 0.9, **forest: int) -> DataFrame:
    """Distinct (a, b, sim), a < b: pairs of at least the similarity where one is among the k most similar of the other.

    ``vectors`` has ``id`` (long) and ``embedding``. Null, short, zero or non-finite embeddings take no part;
    repeated rows count once; ties go to the smaller id, the vector itself left out. An empty input gives no rows. The
    search is approximate: a pair may be missed, and then a farther one of at least the minimum may take its rank. Similarities are
    exact, ranks are those among the pairs found.
    """
    scratch = Scratch(vectors.sparkSession, "forest")
    units = scratch.keep(unit_vectors(vectors))
    reps, members = copy_classes(units)
    reps, members = scratch.keep(reps), scratch.keep(members)
    groups = crowded(reps, min_similarity)
    if groups is None:
        half = forest_pairs(reps, min_similarity, **forest)
    else:
        groups = scratch.keep(groups)
        marked = reps.join(groups.where("own").select("cls", "grp"), "cls", "left").fillna(-1, ["grp"])
        half = forest_pairs(marked, min_similarity, **forest)
    u = reps.select(F.col("cls").alias("_c"), "unit")
    exact = (
        half.join(u.withColumnRenamed("unit", "ux"), F.col("x") == F.col("_c")).drop("_c").join(u.withColumnRenamed("unit", "uy"), F.col("y") == F.col("_c")).drop("_c")
    )

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x = np.frombuffer(b"".join(a), np.float64).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.float64).reshape(len(b), -1)
        return pd.Series(np.round(np.einsum("ij,ij->i", x, y), 12))

    scored = exact.select("x", "y", cosine("ux", "uy").alias("sim")).where(F.col("sim") >= min_similarity)
    if groups is not None:
        crowd = crowd_pairs(reps, groups, k, min_similarity)
        scored = scored.unionByName(crowd).groupBy("x", "y").agg(F.max("sim").alias("sim"))
    scored = scratch.keep(scored)
    both = scored.unionByName(scored.select(F.col("y").alias("x"), F.col("x").alias("y"), "sim"))
    own = reps.select(F.col("cls").alias("x"), F.col("cls").alias("y"), F.lit(1.0).alias("sim"))
    # the k + 1 smallest ids of a class are all that can be anybody's neighbours
    first = Window.partitionBy("cls").orderBy("id")
    head = scratch.keep(members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n"))
    near = both.unionByName(own).join(head.withColumnRenamed("cls", "y"), "y")
    rank = Window.partitionBy("x").orderBy(F.col("sim").desc(), F.col("id"))
    best = near.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k + 1)
    lists = best.select("x", F.col("id").alias("other"), "sim", "n")
    asked = members.select(F.col("cls").alias("x"), F.col("id").alias("q")).join(lists, "x").where(F.col("q") != F.col("other"))
    top = asked.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("n"))).where(F.col("r") <= k)
    return top.select(F.least("q", "other").alias("a"), F.greatest("q", "other").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))

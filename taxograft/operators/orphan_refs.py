"""References to records that do not exist, are deleted, or are not there yet.

A Bloom filter of all parent keys proves definite orphans without a join: a key outside the filter is absent.
Only the filter-positive references are verified by an exact, time-aware join. The filter's size is a
parameter with a fixed upper bound, whatever the number of parents; a full filter only sends more references to the
exact join, it never changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxograft.session import Scratch

#: Bits per parent key, hash functions, bits of one block and the bound on the filter (64 MiB).
BITS_PER_KEY, HASHES, BLOCK_BITS, MAX_BITS = 12, 6, 1 << 19, 1 << 29


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES bit positions of each 64-bit hash, by double hashing."""
    h = h.astype(np.int64).view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    k = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((a + k * b) % np.uint64(bits)).astype(np.int64)


def bloom_filter(keys: DataFrame, n_keys: int) -> tuple[np.ndarray, int]:
    """The packed bits of a filter over the long column ``h`` (hashes of the keys), and its number of bits.

    Partitions build their share block by block; blocks are merged by a grouped aggregate, and only the
    finished filter (at most MAX_BITS / 8 bytes) reaches the driver.
    """
    bits = 1 << max(16, min(MAX_BITS, max(1, n_keys) * BITS_PER_KEY).bit_length())
    bits = min(bits, MAX_BITS)
    per_block = min(BLOCK_BITS, bits)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(_positions(batch["h"].to_numpy(), bits))
            for block in np.unique(at // per_block):
                inside = at[at // per_block == block] % per_block
                if block not in own:
                    own[block] = np.zeros(per_block // 8, np.uint8)
                np.bitwise_or.at(own[block], inside >> 3, np.uint8(1) << (inside & 7).astype(np.uint8))
        if own:
            yield pd.DataFrame({"block": list(own), "bits": [v.tobytes() for v in own.values()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch["block"], batch["bits"]):
                v = np.frombuffer(raw, np.uint8)
                own[block] = own[block] | v if block in own else v
        if own:
            yield pd.DataFrame({"block": list(own), "bits": [v.tobytes() for v in own.values()]})

    kind = "block long, bits binary"
    blocks = keys.mapInPandas(partial, kind).repartition("block").mapInPandas(merge, kind)
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():  # bounded: the filter itself, a block at a time
        start = row["block"] * per_block // 8
        out[start : start + per_block // 8] |= np.frombuffer(row["bits"], np.uint8)
    return out, bits


def bloom_hits(bits: np.ndarray, n_bits: int, h: np.ndarray) -> np.ndarray:
    """For each 64-bit hash whether it may be in the filter."""
    at = _positions(h, n_bits)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def might_contain(refs: DataFrame, bits: np.ndarray, n_bits: int) -> DataFrame:
    """``refs`` with a boolean ``maybe``: false proves that the key ``h`` is not in the filter."""
    shared = refs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(bloom_hits(shared.value, n_bits, h.to_numpy()))

    return refs.withColumn("maybe", test("h"))


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references that no parent satisfies at their time.

    ``refs`` has ``key`` (string), ``at`` (timestamp) and any further columns; ``parents`` has ``key``,
    ``valid_from`` and ``valid_to`` (null: still valid). A reference is an orphan if no parent of its key has
    ``valid_from <= at`` and ``valid_to`` null or later than ``at``. References with a null key are left out, since they
    refer to nothing; a null ``at`` or ``valid_from`` never matches. Repeated rows are kept as often as they stand in
    ``refs``. No parents at all make every reference an orphan.

    Of the parents that are still valid only the earliest of each key counts, and hot keys on the reference side are reduced to distinct
    (key, at). What then is left is held against the deliveries that have ended by running maxima: a delivery is valid at a time if the latest
    end among those that began by then lies beyond it. They are taken day by day, so no key is held against itself and none is sorted whole.
    """
    scratch = Scratch(refs.sparkSession, "orphans")
    parents = parents.where(F.col("key").isNotNull() & F.col("valid_from").isNotNull())
    opened = scratch.keep(parents.groupBy("key").agg(F.min(F.when(F.col("valid_to").isNull(), F.col("valid_from"))).alias("open_from")))
    bits, n_bits = bloom_filter(opened.select(F.xxhash64("key").alias("h")), opened.count())
    refs = refs.where(F.col("key").isNotNull()).withColumn("h", F.xxhash64("key"))
    tested = scratch.keep(might_contain(refs, bits, n_bits).drop("h"))
    absent = tested.where(~F.col("maybe")).drop("maybe")
    maybe = tested.where(F.col("maybe")).drop("maybe")
    # exact join of the distinct (key, at) that passed the filter
    ask = maybe.select("key", "at").distinct()
    by_open = ask.join(opened, "key", "left")
    rest = scratch.keep(by_open.where(~F.coalesce(F.col("open_from") <= F.col("at"), F.lit(False))).select("key", "at"))
    closed = parents.where(F.col("valid_to") > F.col("valid_from")).join(rest.select("key").distinct(), "key", "left_semi")
    ends = closed.groupBy("key", F.col("valid_from").alias("t")).agg(F.max("valid_to").alias("end"))
    # deliveries that begin at the very time come first
    events = ends.select("key", "t", F.lit(0).alias("kind"), "end").unionByName(rest.select("key", F.col("at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz" if dict(ends.dtypes)["end"] == "timestamp_ntz" else "timestamp").alias("end")))
    events = scratch.keep(events.withColumn("day", F.to_date("t")))
    days = events.groupBy("key", "day").agg(F.max("end").alias("_m"))
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    start = days.select("key", "day", F.max("_m").over(before).alias("_past"))
    inside = Window.partitionBy("key", "day").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("_here", F.max("end").over(inside)).where(F.col("kind") == 1).join(start, (events["key"].eqNullSafe(start["key"])) & events["day"].eqNullSafe(start["day"])).drop(start["key"]).drop(start["day"])
    missing = seen.where(~F.coalesce(F.greatest("_past", "_here") > F.col("t"), F.lit(False)))
    m = missing.select(F.col("key").alias("_mk"), F.col("t").alias("_ma"))
    proven = maybe.join(m, (F.col("key") == F.col("_mk")) & F.col("at").eqNullSafe(F.col("_ma")), "left_semi")
    return absent.unionByName(proven)


def breadcrumb_refs(big7: DataFrame) -> DataFrame:
    """(record_key, key, at, period): each id of id_breadcrumb but the row's own, as ``site_id_id``."""
    own = F.col("cat_id").cast("string")
    ids = F.expr("filter(transform(split(id_breadcrumb, '>'), x -> trim(x)), x -> x <> '' AND x rlike '^[0-9]+$')")
    rows = big7.where(F.col("site_id").isNotNull() & F.col("cat_id").isNotNull())
    rows = rows.select("site_id", "cat_id", "loaded_at", F.explode(F.array_distinct(ids)).alias("ref"))
    return rows.where(F.col("ref").cast("bigint") != F.col("cat_id")).select(
        F.concat_ws("_", "site_id", own).alias("record_key"),
        F.concat_ws("_", "site_id", F.col("ref").cast("bigint")).alias("key"),
        F.col("loaded_at").alias("at"),
        F.date_format("loaded_at", "yyyy-MM").alias("period"),
    )


def big7_orphans(big7: DataFrame, sites: DataFrame) -> DataFrame:
    """Distinct (target_table, record_key, missing_key, period) of this project's orphan references."""
    record = F.concat_ws("_", "site_id", "cat_id")
    parents = big7.select(record.alias("key"), F.col("loaded_at").alias("valid_from"), F.col("deleted_at").alias("valid_to"))
    owners = sites.select(F.col("site_id").cast("string").alias("key"), F.col("opened_at").alias("valid_from"), F.col("closed_at").alias("valid_to"))
    # records are keyed site_id_cat_id, sites without an underline, so both targets go through one pass
    site_refs = big7.where(F.col("site_id").isNotNull()).select(
        record.alias("record_key"), F.col("site_id").cast("string").alias("key"), F.col("loaded_at").alias("at"), F.date_format("loaded_at", "yyyy-MM").alias("period")
    )
    found = orphans(breadcrumb_refs(big7).unionByName(site_refs).distinct(), parents.unionByName(owners))
    target = F.when(F.col("key").contains("_"), "big7_data").otherwise("sites")
    return found.select(target.alias("target_table"), "record_key", F.col("key").alias("missing_key"), "period").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references, referring records and missing keys per referenced table and month."""
    return found.groupBy("target_table", "period").agg(
        F.count(F.lit(1)).alias("n_orphans"),
        F.countDistinct("record_key").alias("n_records"),
        F.countDistinct("missing_key").alias("n_missing_keys"),
    )

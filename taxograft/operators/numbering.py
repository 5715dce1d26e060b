"""Dense numbers and running sums without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def dense_numbers(rows: DataFrame, key: str, *group: str, name: str = "place") -> DataFrame:
    """``rows`` (distinct in group and key) with numbers from 0 within each group (or all).

    Rows are counted per hash bucket of the key, then numbered within buckets, so not even one large group is sorted in a single
    task; only the counts (BUCKETS rows a group at most) are summed in order. The order is that of buckets, then keys.
    """
    b = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    counts = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = b.withColumn("_i", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(key)) - 1)
    return inside.join(start, [*group, "_b"]).withColumn(name, F.col("_start") + F.col("_i")).drop("_b", "_i", "_start")


def sum_before(rows: DataFrame, value: str, order: str, name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows earlier by ``order``, a column of hexadecimal digests: sums per three-digit prefix first
    (4,096 rows), then within prefixes."""
    b = rows.withColumn("_b", F.substring(order, 1, 3))
    sums = b.groupBy("_b").agg(F.sum(value).alias("_s"))
    start = sums.withColumn("_start", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = b.withColumn("_i", F.coalesce(F.sum(value).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(start, "_b").withColumn(name, F.col("_start") + F.col("_i")).drop("_b", "_i", "_start")


def _range_bucket(rows: DataFrame, key: str, group: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``_b``: BUCKETS stretches of equal width between the smallest and largest key (a number) of each group; in their order."""
    ends = rows.groupBy(*group).agg(F.min(key).cast("double").alias("_lo"), F.max(key).cast("double").alias("_hi"))
    both = rows.join(ends, list(group)) if group else rows.crossJoin(F.broadcast(ends))  # one row
    width = F.greatest((F.col("_hi") - F.col("_lo")) / BUCKETS, F.lit(1e-9))
    at = F.floor((F.col(key).cast("double") - F.col("_lo")) / width).cast("int")
    return both.withColumn("_b", F.least(at, F.lit(BUCKETS - 1))).drop("_lo", "_hi")


def ordered_numbers(rows: DataFrame, key: str, *group: str, name: str = "place") -> DataFrame:
    """As :func:`dense_numbers`, but in the order of a numeric key: buckets are stretches of its range."""
    b = _range_bucket(rows, key, group)
    counts = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = b.withColumn("_i", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(key)) - 1)
    return inside.join(start, [*group, "_b"]).withColumn(name, F.col("_start") + F.col("_i")).drop("_b", "_i", "_start")


def latest_before(rows: DataFrame, order: str, values: dict[str, Column], *group: str) -> DataFrame:
    """``rows`` with, for each name of ``values``, its greatest value (structs compare by their first field) among all rows earlier by the numeric
    ``order``: greatest values per stretch of the order first, then within stretches."""
    b = _range_bucket(rows, order, group).select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    per = b.groupBy(*group, "_b").agg(*[F.max(f"_v_{n}").alias(f"_m_{n}") for n in values])
    past = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select(*group, "_b", *[F.max(f"_m_{n}").over(past).alias(f"_s_{n}") for n in values])
    inside = Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = b.select("*", *[F.max(f"_v_{n}").over(inside).alias(f"_i_{n}") for n in values]).join(start, [*group, "_b"])
    return seen.select(*rows.columns, *[F.greatest(f"_s_{n}", f"_i_{n}").alias(n) for n in values])

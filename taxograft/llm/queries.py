"""Queries of the training-data problems (p2, p3, p6 to p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograft.llm.bpe import encode_corpus
from taxograft.llm.leaks import leak_report, leaked_items
from taxograft.llm.neighbours import similar_pairs
from taxograft.llm.overlap import content_hashes, cross_split_pairs, overlap_report
from taxograft.llm.splits import record_groups, split_of
from taxograft.llm.stuffed import stuffed_pages
from taxograft.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "label_vectors").select(F.col("cat_id").alias("id"), "embedding")
    return similar_pairs(vectors).select(F.col("a").alias("cat_id_a"), F.col("b").alias("cat_id_b"))


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return record_groups(*[table(spark, sf, t) for t in ("sub_pairs", "emb_triples", "siblings_data", "cat_data")])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf)


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf).withColumn("split", split_of(F.col("group_id")))


def _hashes(spark: SparkSession, sf: str) -> DataFrame:
    return content_hashes(*[table(spark, sf, t) for t in ("sub_pairs", "emb_triples", "gen_prompts", "cat_data")])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split_pairs(_hashes(spark, sf))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_report(_hashes(spark, sf))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    return leak_report(leaked_items(docs, items), items, docs)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffed_pages(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_splits, p6_found, p6_report, p7_ids, p8_found, p8_report, p9_found)}
SQL: dict[str, str] = {}

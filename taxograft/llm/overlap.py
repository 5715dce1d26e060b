"""Same or near-same records across splits.

Records are canonicalised field by field (case, punctuation, blanks, escapes, accents, word order; mistyped names by
their class) and hashed; evaluation hashes are joined with training hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.functions.names import canonical, canonical_name
from taxograft.llm.same_name import aliases
from taxograft.operators.orphan_refs import bloom_filter, bloom_hits
from taxograft.operators.packed_fields import with_pieces
from taxograft.session import Scratch


TABLES = ("sub_pairs", "emb_triples", "gen_prompts")


#: Between a row's two fields, and between the names of its second field.
FIELD, NAME = "\x1e", "\x1f"
#: Names of a batch whose clean forms are kept.
CACHED = 20_000


def _content(one: Column, many: Column) -> Column:
    """A row's canonical content as one string: the first field's name, then the second's distinct names in order; null where a field has no
    name. ``many`` holds the second field's names joined by NAME."""

    @F.pandas_udf("string")
    def run(first: pd.Series, rest: pd.Series) -> pd.Series:
        out = []
        clean = lru_cache(maxsize=CACHED)(canonical_name)
        for a, b in zip(first, rest):
            head = clean(a)
            tail = clean(b) if NAME not in b else NAME.join(sorted({clean(x) for x in b.split(NAME)} - {""}))
            out.append(f"{head}{FIELD}{tail}" if head and tail else None)
        return pd.Series(out, dtype=object)

    return run(one, many)


def _records(sub_pairs: DataFrame, triples: DataFrame, prompts: DataFrame) -> DataFrame:
    """(code, row_id, split, source, content) of all complete rows, straight from the scans."""

    def part(code: int, df: DataFrame, one: str, many: Column) -> DataFrame:
        rows = df.where(F.col("split").isin("train", "eval", "test") & F.col("row_id").isNotNull() & F.col(one).isNotNull() & many.isNotNull())
        return rows.select(F.lit(code).cast("tinyint").alias("code"), "row_id", "split", "source", _content(F.col(one), many).alias("content"))

    packed = with_pieces(prompts, "text", "source", prompt=True).where(F.col("text").isNotNull())
    return (
        part(0, sub_pairs, "subclass", F.col("superclass"))
        .unionByName(part(1, triples, "query_label", F.col("positive_label")))
        .unionByName(part(2, packed, "summary", F.array_join(F.transform("_pieces", lambda p: p["val"]), NAME)))
        .where(F.col("content").isNotNull())
    )


def _name_hash(name: str) -> int:
    return xxhash.xxh64_intdigest(name) - (1 << 63)


def content_hashes(sub_pairs: DataFrame, triples: DataFrame, prompts: DataFrame, cats: DataFrame) -> DataFrame:
    """(code, row_id, split, source, content): the hash of each complete row's canonical content; ``code`` is the place in TABLES.

    Rows with a null among the content fields or the split, or with a field that holds no name at all, are left out; the names of
    one row's packed field form a set. Mistyped names are replaced by their class; since few names are mistyped, a Bloom filter of bounded
    size tells which rows may hold one, and all others are hashed where they stand.
    """
    scratch = Scratch(sub_pairs.sparkSession, "content")
    rec = scratch.keep(_records(sub_pairs, triples, prompts))
    forms = rec.select(F.explode(F.split("content", f"[{FIELD}{NAME}]")).alias("canon")).groupBy("canon").agg(F.count(F.lit(1)).alias("n"))
    known = scratch.keep(cats.where(F.col("label").isNotNull()).select(canonical("label").alias("canon")).where(F.col("canon") != "").distinct())
    foreign = scratch.keep(forms.join(known, "canon", "left_anti"))
    linked = aliases(foreign, known)
    linked = scratch.keep(linked.where(F.col("canon") != F.col("name_class")))

    @F.pandas_udf("long")
    def hashed(name: pd.Series) -> pd.Series:
        return pd.Series([_name_hash(x) for x in name], dtype="int64")

    bits, n_bits = bloom_filter(linked.select(hashed("canon").alias("h")), linked.count())
    shared = sub_pairs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def touched(content: pd.Series) -> pd.Series:
        if not len(content):
            return pd.Series([], dtype=bool)
        names = [x.replace(FIELD, NAME).split(NAME) for x in content]
        hit = bloom_hits(shared.value, n_bits, np.array([_name_hash(x) for own in names for x in own], np.int64))
        return pd.Series(np.logical_or.reduceat(hit, np.cumsum([0, *(len(own) for own in names[:-1])])))

    digest = lambda c: F.unhex(F.md5(c))
    keys = ["code", "row_id", "split", "source"]
    marked = rec.withColumn("_t", touched("content"))
    marked = scratch.keep(marked.select(*keys, F.when(~F.col("_t"), digest("content")).alias("digest"), F.when(F.col("_t"), F.col("content")).alias("content")))
    plain = marked.where(F.col("digest").isNotNull()).select(*keys, F.col("digest").alias("content"))
    # the few rows that may hold a mistyped name: bounded by their own fields
    parts = F.split("content", FIELD)
    loose = marked.where(F.col("content").isNotNull()).withColumn("_i", F.col("content"))
    one = loose.select(*keys, "_i", F.lit(0).alias("field"), parts[0].alias("canon"))
    many = loose.select(*keys, "_i", F.lit(1).alias("field"), F.explode(F.split(parts[1], NAME)).alias("canon"))
    named = one.unionByName(many).join(linked, "canon", "left").withColumn("canon", F.coalesce("name_class", "canon"))
    names_of = lambda f: F.array_join(F.sort_array(F.collect_set(F.when(F.col("field") == f, F.col("canon")))), NAME)
    again = named.groupBy(*keys, "_i").agg(F.concat_ws(FIELD, names_of(0), names_of(1)).alias("content"))
    return plain.unionByName(scratch.keep(again.select(*keys, digest("content").alias("content"))))


def table_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TABLES]), code + 1)


def cross_split_pairs(hashes: DataFrame) -> DataFrame:
    """Distinct (rec_table, id_a, id_b) of rows with the same content, one in train, the other in eval or test, id_a < id_b."""
    train = hashes.where(F.col("split") == "train").select("code", "content", F.col("row_id").alias("t"))
    held = hashes.where(F.col("split") != "train").select("code", "content", F.col("row_id").alias("e")).distinct()
    both = train.join(held, ["code", "content"]).where(F.col("t") != F.col("e"))
    pairs = both.select("code", F.least("t", "e").alias("id_a"), F.greatest("t", "e").alias("id_b")).distinct()
    return pairs.select(table_name(F.col("code")).alias("rec_table"), "id_a", "id_b")


def overlap_report(hashes: DataFrame) -> DataFrame:
    """Per table, held-out split and source: rows, rows whose content stands in train, and pairs. Pairs are counted from
    training counts per content and never built."""
    train = hashes.where(F.col("split") == "train").select("code", "content", "row_id").distinct().groupBy("code", "content").agg(F.count(F.lit(1)).alias("n_train"))
    held = hashes.where(F.col("split") != "train").distinct().join(train, ["code", "content"], "left")
    return held.groupBy(table_name(F.col("code")).alias("rec_table"), "split", "source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("n_train").alias("n_overlapping"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("n_pairs")
    )

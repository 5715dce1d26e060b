"""Lexical functions over breadcrumbs and labels, as column expressions that stay in the JVM.

Words are lower-cased runs of letters and digits without stop words, with plural endings cut by rule; there is no part-of-speech tagger
or word net behind them. Where "more general word" matters, a closure table (node, anc) of words is an input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no meaning of their own in a label.
STOP_WORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "other", "the", "to", "with")


def segment(text: Column, sep: str = ">") -> Column:
    """The parts of a breadcrumb between blanks and the separator."""
    return F.split(text, f" \\Q{sep}\\E ")


def normalise_breadcrumb(text: Column, link: str = "raw") -> Column:
    """``symbol``: names without their bracketed ids, joined by `` > ``; ``word``: "A contains B, which contains C."; ``id``: the bracketed
    ids joined by blanks (null where there is none); anything else: the text itself."""
    names = F.transform(segment(text), lambda x: F.regexp_replace(x, r"(?s) \(\d+\).*$", ""))
    if link == "symbol":
        return F.array_join(names, " > ")
    if link == "word":
        tail = F.array_join(F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))), ", which contains ")
        return F.concat(F.element_at(names, 1), F.when(F.size(names) > 1, F.concat(F.lit(" contains "), tail)).otherwise(""), F.lit("."))
    if link == "id":
        ids = F.regexp_extract_all(F.concat(text, F.lit(" > ")), F.lit(r" \((\d+)\)\s?> "), F.lit(1))
        return F.when(F.size(ids) > 0, F.array_join(ids, " "))
    return text


def list_union(x: Column, y: Column) -> Column:
    """Both lists one after the other, each member at its first place."""
    return F.array_distinct(F.concat(x, y))


def list_diff(x: Column, y: Column) -> Column:
    """The members of x, repeated ones too, that y does not hold."""
    return F.filter(x, lambda z: ~F.array_contains(y, z))


def list_add(x: Column, item: Column) -> Column:
    return F.when(F.array_contains(x, item), x).otherwise(F.concat(x, F.array(item)))


def tokenise(text: Column) -> Column:
    """Words, contractions' endings and single punctuation marks, in order."""
    return F.regexp_extract_all(text, F.lit(r"('(?:s|re|ve|ll|d|m)\b|[\p{L}\p{N}]+(?:[-.][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}])"), F.lit(1))


def lemma(word: Column) -> Column:
    """The word without a plural ending."""
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(word.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & word.rlike("(?:ss|sh|ch|x|z)es$"), word.substr(F.lit(1), n - 2))
        .when((n > 3) & word.endswith("s") & ~word.rlike("(?:ss|us|is)$"), word.substr(F.lit(1), n - 1))
        .otherwise(word)
    )


def token_set(text: Column) -> Column:
    """The distinct meaning-bearing words of a breadcrumb, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(kept, lemma))


def lexical_key(label: Column) -> Column:
    """What labels are matched on: their token set; null (no match) where it is empty."""
    t = token_set(label)
    return F.when(F.size(t) > 0, F.array_join(t, " "))


def lexical_match(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """``labels`` with the node of the same token set: the largest id where several have it; null without one."""
    cache = nodes.select(lexical_key(F.col("label")).alias("_key"), "id").where(F.col("_key").isNotNull()).groupBy("_key").agg(F.max("id").alias("match"))
    return labels.withColumn("_key", lexical_key(F.col("label"))).join(cache, "_key", "left").drop("_key")


def to_string(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.array_join(tokens, ", ")).otherwise("None")


def hypernym(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``pairs`` (word1, word2) with a boolean ``hypernym``: word1 equals or is more general than word2. A null word2 is below everything, a
    null word1 above nothing. ``words`` is a closure (node, anc) of words."""
    c = words.select(F.col("node").alias("word2"), F.col("anc").alias("word1"), F.lit(True).alias("_hit")).distinct()
    hit = pairs.join(c, ["word1", "word2"], "left")
    value = F.when(F.col("word2").isNull(), True).when(F.col("word1").isNull(), False).otherwise(F.coalesce("_hit", F.col("word1") == F.col("word2")))
    return hit.withColumn("hypernym", value).drop("_hit")


def hyper_hypo(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``pairs`` (word1, word2) with ``hyper`` (the more general word; the other where one is null) and ``hypo`` (the more specific;
    null where one is null); both null for unrelated words."""
    flip = hypernym(pairs.select(F.col("word2").alias("word1"), F.col("word1").alias("word2")).distinct(), words)
    up = hypernym(pairs, words).withColumnRenamed("hypernym", "_up")
    down = flip.select(F.col("word2").alias("_a"), F.col("word1").alias("_b"), F.col("hypernym").alias("_down"))
    j = up.join(down, up["word1"].eqNullSafe(down["_a"]) & up["word2"].eqNullSafe(down["_b"]), "left")
    one = F.col("word1").isNull() | F.col("word2").isNull()
    hyper = F.when(one, F.coalesce("word1", "word2")).when(F.col("_up"), F.col("word1")).when(F.col("_down"), F.col("word2"))
    hypo = F.when(one, None).when(F.col("_up"), F.col("word2")).when(F.col("_down"), F.col("word1"))
    return j.select("word1", "word2", hyper.alias("hyper"), hypo.alias("hypo"))


def hypernym_reduce(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``tokens`` (row_id, token) without those that are more general than another token of the row."""
    up = tokens.select("row_id", F.col("token").alias("node")).join(words.select("node", F.col("anc").alias("token")), "node")
    general = up.where(F.col("node") != F.col("token")).select("row_id", "token").distinct()
    return tokens.join(general, ["row_id", "token"], "left_anti")


def keyword_strings(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(row_id, keywords): the reduced tokens of each row by position, joined by commas. ``tokens`` has row_id, pos, token."""
    kept = hypernym_reduce(tokens, words).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return kept.select("row_id", F.array_join(F.transform("t", lambda x: x["token"]), ", ").alias("keywords"))


def breadcrumb_screening(pairs: DataFrame, tokens: DataFrame, words: DataFrame, relax: int = 0) -> DataFrame:
    """``pairs`` (pair_id, left, right: row_ids of ``tokens``) with two booleans: at most ``relax`` tokens of the reduced union are missing on
    that side."""
    own = hypernym_reduce(tokens.select("row_id", "token").distinct(), words)
    side = lambda c: pairs.select("pair_id", F.col(c).alias("row_id")).join(own, "row_id").select(F.col("pair_id").alias("row_id"), "token")
    left, right = side("left").distinct(), side("right").distinct()
    union = hypernym_reduce(left.unionByName(right).distinct(), words)
    miss = lambda s, name: union.join(s, ["row_id", "token"], "left_anti").groupBy("row_id").agg(F.count(F.lit(1)).alias(name))
    out = pairs.select("pair_id", F.col("pair_id").alias("row_id")).join(miss(left, "ml"), "row_id", "left").join(miss(right, "mr"), "row_id", "left")
    ok = lambda c: (F.coalesce(c, F.lit(0)) <= relax)
    return out.select("pair_id", ok("ml").alias("left_ok"), ok("mr").alias("right_ok"))


def common_parent(pairs: DataFrame, tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(pair_id, token): for each token of the left side the most general one of it and the right side's tokens related to it, where it is related
    to any; of several unrelated ones the first by name."""
    star = words.select("node", "anc").unionByName(tokens.select(F.col("token").alias("node"), F.col("token").alias("anc"))).distinct()
    side = lambda c: pairs.select("pair_id", F.col(c).alias("row_id")).join(tokens.select("row_id", "token"), "row_id").select("pair_id", "token").distinct()
    left, right = side("left"), side("right")

    up = star.select(F.col("node").alias("token"), "anc")
    # left tokens above a right one stand for themselves, right tokens above a left one for that one
    own = right.join(up, "token").select("pair_id", F.col("anc").alias("token")).join(left, ["pair_id", "token"], "left_semi").distinct()
    cand = own.select("pair_id", F.col("token").alias("of"), "token")
    over = left.join(up, "token").select("pair_id", F.col("token").alias("of"), F.col("anc").alias("token")).join(right, ["pair_id", "token"], "left_semi")
    cand = cand.unionByName(over).distinct()
    strict = words.where(F.col("node") != F.col("anc")).select(F.col("node").alias("token"), "anc").distinct()
    below = cand.join(strict, "token").join(cand.select("pair_id", "of", F.col("token").alias("anc")), ["pair_id", "of", "anc"], "left_semi")
    top = cand.join(below.select("pair_id", "of", "token"), ["pair_id", "of", "token"], "left_anti")
    return top.groupBy("pair_id", "of").agg(F.min("token").alias("token")).select("pair_id", "token").distinct()

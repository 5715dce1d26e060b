"""Models as columns: adapters for user callables (Arrow batches) and deterministic stand-ins that need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.session import Scratch

#: A scorer maps two label columns (sub, sup) to the probability that sup subsumes sub.
Scorer = Callable[[Column, Column], Column]


def sub_model(call: Callable[[list[str], list[str]], np.ndarray]) -> Scorer:
    """A scorer from a callable over two lists of labels."""

    @F.pandas_udf("double")
    def run(sub: pd.Series, sup: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(call(sub.tolist(), sup.tolist()), np.float64).ravel()) if len(sub) else pd.Series([], dtype="float64")

    return lambda a, b: run(a, b)


def emb_model(call: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """Embeddings (array<float>) from a callable over a list of labels."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for labels in batches:
            yield pd.Series([np.asarray(v, np.float32) for v in call(labels.tolist())] if len(labels) else [], dtype=object)

    return lambda c: run(c)


def gen_model(call: Callable[[list[str]], str]) -> Callable[[Column], Column]:
    """A label from a callable over the list of labels it is to cover."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: call(list(x)))

    return lambda c: run(c)


def words_of(label: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def word_scorer(sub: Column, sup: Column) -> Column:
    """Stand-in for a subsumption model: the share of sup's words that sub holds; 0 for labels without words."""
    a, b = words_of(sub), words_of(sup)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(b)), F.lit(0.0))


def common_words(labels: Column) -> Column:
    """Stand-in for a label generator: the labels' common words in order of the alphabet; null where there are none."""
    sets = F.transform(labels, words_of)
    common = F.aggregate(F.slice(sets, F.lit(2), F.greatest(F.size(sets) - 1, F.lit(0))), F.element_at(sets, 1), F.array_intersect)
    return F.when(F.size(common) > 0, F.array_join(F.array_sort(common), " "))


class ScoreCache:
    """Scores of label pairs, asked of the model once each and kept as written tables."""

    def __init__(self, spark, scorer: Scorer):
        self.scorer = scorer
        self._scratch = Scratch(spark, "scores")
        self._parts: list[DataFrame] = []

    @classmethod
    def over(cls, spark, scorer: Scorer | ScoreCache) -> ScoreCache:
        return scorer if isinstance(scorer, ScoreCache) else cls(spark, scorer)

    def known(self) -> DataFrame | None:
        """(sub, sup, p) of all pairs scored so far."""
        out = None
        for p in self._parts:
            out = p if out is None else out.unionByName(p)
        return out

    def of(self, pairs: DataFrame) -> DataFrame:
        """(sub, sup, p) of the distinct pairs (sub, sup), nulls included; only pairs never asked before go to the model."""
        asked = pairs.select("sub", "sup").distinct()
        known = self.known()
        same = lambda k: F.col("sub").eqNullSafe(k["_a"]) & F.col("sup").eqNullSafe(k["_b"])
        if known is not None:
            k = known.select(F.col("sub").alias("_a"), F.col("sup").alias("_b"), "p")
            new = asked.join(k, same(k), "left_anti")
        else:
            new = asked
        fresh = self._scratch.keep(new.select("sub", "sup", self.scorer(F.col("sub"), F.col("sup")).alias("p")))
        self._parts.append(fresh)
        if len(self._parts) > 8:  # few files to read however many levels were walked
            merged = self._scratch.keep(self.known())
            self._scratch.drop(*self._parts)
            self._parts = [merged]
        k = self.known().select(F.col("sub").alias("_a"), F.col("sup").alias("_b"), "p")
        return asked.join(k, same(k)).select("sub", "sup", "p")


def classifier_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, precision, recall and F1 of a 0/1 prediction, to 6 decimals; null where undefined."""
    hit = lambda a, b: F.sum(F.when((F.col(label) == a) & (F.col(predicted) == b), 1).otherwise(0))
    s = df.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    acc = F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return s.select(*[F.round(c, 6).alias(n) for c, n in ((acc, "accuracy"), (p, "precision"), (r, "recall"), (f1, "f1"))])


def ngram_overlap(reference: Column, candidate: Column, up_to: int = 4) -> Column:
    """Sentence GLEU: matched 1- to 4-grams over the larger number of n-grams of both sides; null where neither has any."""

    def grams(text: Column) -> Column:
        w = F.split(F.trim(text), r"\s+")

        def of_length(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
            return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

        return F.concat(*[of_length(n) for n in range(1, up_to + 1)])

    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    a, b = grams(reference), grams(candidate)
    both = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return F.try_divide(both.cast("double"), F.greatest(F.size(a), F.size(b)))

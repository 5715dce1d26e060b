"""Classes of names that are the same but for notation and at most two mistyped characters.

Notation is removed by :func:`taxograft.functions.names.canonical`. Typing errors are found by a complete
signature scheme on the canonical words: two errors touch at most two words, so

* (one word touched) all words but one are intact, and of that one the first, middle or last third, with its place;
* (two words touched, one error each) all words but two are intact, and of either touched word the first or the last
  half: four signatures for each pair left out.

Names of one or two words have too little besides the touched pieces to tell them apart; of their touched words all strings with up to two
letters deleted (one in each of two) are signed instead: words within so many errors share one. Names of more than ``MAX_WORDS`` words are
dealt into eight groups by their words' hashes; two errors touch at most four, so some four groups are intact, and every choice of four
is signed. An error that joins or splits words changes their number: the forms that splitting or joining a probe's words
gives are looked up as whole names.

Two names with no more than two errors that leave the number of words unchanged always share a signature, however many words they have, and a
signature holds everything but the touched pieces, so words that many names share make no large buckets. Candidates are verified by
edit distance. Names are reduced to distinct canonical forms before any of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.llm.components import components
from taxograft.operators.orphan_refs import bloom_filter, bloom_hits
from taxograft.session import Scratch

#: Names with more words than this are signed by groups of words instead; letters of a word whose deletions are signed.
MAX_WORDS, GROUPS, LONG = 12, 8, 20
#: A name outside the catalogue that stands this often is compared first, as a form that others are mistyped from; what it
#: leaves unlinked is compared with all.
FREQUENT = 3
#: Words whose hashes a worker keeps, names whose signatures are built at a time.
CACHED, AT_ONCE = 20_000, 256


_MASK = (1 << 64) - 1
_WHOLE = xxhash.xxh64_intdigest("whole name")
_CHOICES = list(combinations(range(GROUPS), GROUPS // 2))


@lru_cache(maxsize=CACHED)
def _word(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


@lru_cache(maxsize=CACHED)
def _halves(word: str, probe: bool) -> tuple[int, ...]:
    """Hashes of the first and last half. An error may have made a probe's word one letter longer or shorter than the reference's."""
    n = len(word)
    sizes = {(n - 1) // 2, n // 2, (n + 1) // 2} if probe else {n // 2}
    return tuple(h for k in sizes for h in (xxhash.xxh64_intdigest(word[:k], 2 * k + 1), xxhash.xxh64_intdigest(word[n - k :], 2 * k + 2)))


@lru_cache(maxsize=CACHED)
def _thirds(word: str, probe: bool) -> tuple[int, ...]:
    """Hashes of the three parts of a word. Two errors leave one part intact; a probe takes the parts that a reference of any near length
    would have, at the places to which errors before and behind them can have moved them."""
    m = len(word)
    found = set()
    for n in range(max(1, m - 2), m + 3) if probe else (m,):
        for k in range(3):
            start, end = n * k // 3, n * (k + 1) // 3
            for moved in range(max(-k, m - n - 2 + k), min(k, m - n + 2 - k) + 1) if probe else (0,):
                if 0 <= start + moved and end + moved <= m:
                    found.add((n, k, word[start + moved : end + moved]))
    return tuple(xxhash.xxh64_intdigest(part, 3 * n + k + (1 << 40)) for n, k, part in found)


@lru_cache(maxsize=CACHED)
def _deletions(word: str, most: int) -> tuple[int, ...]:
    """Hashes of the word with up to ``most`` letters deleted."""
    found = {word[:i] + word[i + 1 :] for i in range(len(word))} if most else set()
    if most == 2:
        found |= {w[:i] + w[i + 1 :] for w in found for i in range(len(w))}
    return tuple(xxhash.xxh64_intdigest(f"-{most}{w}") for w in {word, *found})


def _pieces(word: str, errors: int, probe: bool) -> tuple[int, ...]:
    """What a word of a short name leaves after so many errors: its deletions, or of a long word its halves or thirds."""
    n, out = len(word), ()
    if n <= LONG + (2 if probe else 0):
        out += _deletions(word, errors)
    if n > LONG - (2 if probe else 0):
        out += _halves(word, probe) if errors == 1 else _thirds(word, probe)
    return out


def signatures(name: str, probe: bool) -> list[int]:
    """The signatures of a canonical name as 64-bit sums of word and piece hashes, whatever the order of the words."""
    words = name.split(" ")
    own = [_word(w) for w in words]
    total = sum(own)
    if len(words) > MAX_WORDS:
        groups = [0] * GROUPS
        for h in own:
            groups[h % GROUPS] += h
        size = len(words)
        return [xxhash.xxh64_intdigest(f"{size}:{c}:{[groups[g] for g in chosen]}") for c, chosen in enumerate(_CHOICES)]
    short = len(words) <= 2
    out = [total - h + x & _MASK for w, h in zip(words, own) for x in (_pieces(w, 2, probe) if short else _thirds(w, probe))]
    half = [_pieces(w, 1, probe) if short else _halves(w, probe) for w in words]
    for i in range(len(words)):
        for j in range(i):
            rest = total - own[i] - own[j]
            out += [rest + x + y & _MASK for x in half[i] for y in half[j]]
    return list(dict.fromkeys(out))


@lru_cache(maxsize=CACHED)
def _reference(word: str) -> tuple[int, ...]:
    return (_word(word), *_halves(word, False), *_thirds(word, False))


def reference_signatures(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``names``, signature) of references: those of :func:`signatures` and the whole name's, for names of one length at a time."""
    by_size: dict[int, list[int]] = {}
    places, codes = [], []
    for i, name in enumerate(names):
        size = name.count(" ") + 1
        if 3 <= size <= MAX_WORDS:
            by_size.setdefault(size, []).append(i)
        else:
            own = signatures(name, False) + ([_whole(name)] if size <= MAX_WORDS else [])
            places.append(np.full(len(own), i))
            codes.append(np.array(own, np.uint64))
    for size, at in by_size.items():
        m = np.array([[_reference(w) for w in names[i].split(" ")] for i in at], np.uint64)
        own, half, third = m[:, :, 0], m[:, :, 1:3], m[:, :, 3:]
        total = own.sum(axis=1)
        i, j = np.tril_indices(size, -1)
        rest = total[:, None] - own[:, i] - own[:, j]
        two = rest[:, :, None, None] + half[:, i][:, :, :, None] + half[:, j][:, :, None, :]
        one = (total[:, None] - own)[:, :, None] + third
        whole = np.array([_whole(names[i]) for i in at], np.uint64)
        every = np.concatenate([one.reshape(len(at), -1), two.reshape(len(at), -1), whole[:, None]], axis=1)
        places.append(np.repeat(at, every.shape[1]))
        codes.append(every.ravel())
    return (np.concatenate(places), np.concatenate(codes)) if codes else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def respaced(name: str) -> set[str]:
    """The canonical forms of a name with one blank too many or too few, or one mistyped as a letter."""
    words = name.split(" ")
    out: set[str] = set()
    for i, w in enumerate(words):
        rest = words[:i] + words[i + 1 :]
        for k in range(1, len(w)):
            out.add(" ".join(sorted([*rest, w[:k], w[k:]])))
            if k < len(w) - 1:
                out.add(" ".join(sorted([*rest, w[:k], w[k + 1 :]])))
        for j, v in enumerate(words):
            if i != j:
                out.add(" ".join(sorted([*(x for n, x in enumerate(words) if n not in (i, j)), w + v])))
    return out


def _whole(name: str) -> int:
    return xxhash.xxh64_intdigest(name) + _WHOLE & _MASK


def _signed(names: DataFrame, probe: bool, alias: str, among: tuple | None = None) -> DataFrame:
    """(name, sig) of each canonical name; with ``among`` (a Bloom filter's bits and size) only signatures that may be in it."""
    shared = names.sparkSession.sparkContext.broadcast(among[0]) if among else None

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), AT_ONCE):
                some = batch["canon"].iloc[a : a + AT_ONCE].to_numpy()
                if probe:
                    own = [signatures(n, True) + ([_whole(x) for x in respaced(n)] if n.count(" ") < MAX_WORDS else []) for n in some]
                    at, codes = np.repeat(np.arange(len(some)), [len(x) for x in own]), np.array([x for sigs in own for x in sigs], np.uint64)
                else:
                    at, codes = reference_signatures(some.tolist())
                codes = codes.view(np.int64)
                if among:
                    hit = bloom_hits(shared.value, among[1], codes)
                    at, codes = at[hit], codes[hit]
                if len(codes):
                    yield pd.DataFrame({alias: some[at], "sig": codes})

    return names.select("canon").mapInPandas(sign, f"{alias} string, sig long")


def _two_errors(a: Column, b: Column) -> Column:
    """Whether two canonical names differ by at most two mistyped characters, words in any order."""
    ta, tb = F.split(a, " "), F.split(b, " ")
    ra, rb = F.array_except(ta, tb), F.array_except(tb, ta)
    w = lambda r, i: F.get(r, F.lit(i))
    straight = F.levenshtein(w(ra, 0), w(rb, 0)) + F.levenshtein(w(ra, 1), w(rb, 1))
    crossed = F.levenshtein(w(ra, 0), w(rb, 1)) + F.levenshtein(w(ra, 1), w(rb, 0))
    digits = lambda r: F.forall(r, lambda x: x.rlike("^[0-9]+$"))
    number = digits(ra) & digits(rb) & (F.size(ra) > 0) & (F.size(rb) > 0)
    close = (
        F.when((F.size(ra) == 1) & (F.size(rb) == 1), F.levenshtein(w(ra, 0), w(rb, 0)))
        .when((F.size(ra) == 2) & (F.size(rb) == 2), F.least(straight, crossed))
        .otherwise(F.levenshtein(a, b))
    )
    return (close <= 2) & ~number


def mistyped_links(probes: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a canonical probe and another canonical reference within two errors or one misplaced blank.

    The few probes' signatures make a Bloom filter of bounded size; references send only the signatures that pass it, so of the many
    references hardly anything is shuffled. The join is told to merge: estimates made before the explosion would broadcast it.
    """
    scratch = Scratch(probes.sparkSession, "links")
    p = scratch.keep(_signed(probes, True, "a"))
    bits = bloom_filter(p.select(F.col("sig").alias("h")), p.count())
    r = _signed(refs, False, "b", bits)
    pairs = scratch.keep(p.hint("merge").join(r, "sig").where(F.col("a") != F.col("b")).select("a", "b").distinct())

    @F.pandas_udf("boolean")
    def one_blank(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([y in respaced(x) for x, y in zip(a, b)], dtype=bool)

    marked = pairs.withColumn("_d", F.size(F.split("a", " ")) != F.size(F.split("b", " ")))
    near = marked.where(~F.col("_d") & _two_errors(F.col("a"), F.col("b"))).select("a", "b")
    return scratch.keep(near.unionByName(marked.where("_d").where(one_blank("a", "b")).select("a", "b")))


def aliases(foreign: DataFrame, known: DataFrame) -> DataFrame:
    """(canon, name_class) of the canonical names that typing errors link to others; the class is a catalogue form of those linked, else the
    most frequent, else the smallest.

    ``foreign`` (canon, n) are distinct forms outside the catalogue and how often each stands, ``known`` (canon) the distinct catalogue.
    Foreign forms are linked to known and frequent foreign ones, and what stays alone to all foreign ones, linked or not, so no form stays alone
    beside another within two errors, however seldom they stand. Two forms that both have a link are not compared again: of the
    many mistyped forms of one name not all pairs are made. A name without a row here is its own
    class. Empty forms belong to no class and must be left out by the caller.
    """
    scratch = Scratch(foreign.sparkSession, "names")
    refs = known.select("canon").unionByName(foreign.where(F.col("n") >= FREQUENT).select("canon"))
    links = mistyped_links(foreign.select("canon"), refs)
    alone = scratch.keep(foreign.where(F.col("n") < FREQUENT).join(links.select(F.col("a").alias("canon")).distinct(), "canon", "left_anti").select("canon"))
    more = mistyped_links(alone, foreign.select("canon"))
    comp = scratch.keep(components(links.unionByName(more)))
    # the clean form stands for its class, so that names written properly are the ones that need no replacement
    member = comp.join(known.select(F.col("canon").alias("node"), F.lit(0).alias("strange")), "node", "left").join(foreign.select(F.col("canon").alias("node"), "n"), "node", "left")
    order = F.struct(F.coalesce("strange", F.lit(1)), -F.coalesce("n", F.lit(0)), "node")
    best = member.groupBy("component").agg(F.min_by("node", order).alias("name_class"))
    return comp.join(best, "component").select(F.col("node").alias("canon"), "name_class")

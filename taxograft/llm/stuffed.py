"""Keyword-stuffed and link-list pages, by groups of line shapes.

A page is cut into units (lines, and sentences within lines). Units that many differing pages of one host share are furniture
(menus, notices, footers) and left aside. Each other unit is reduced to a shape: its kind, number of words, initial capital,
separators and links. Units of one shape are grouped, and a page is flagged if its few largest groups of stuffing hold more words
than everything with the form of sentences or data, and something in them marks them as stuffing: links, tags, separated lists, many rows of
keywords, or word pairs that come again and again. Sentences that only repeat the page's keyword, of one word or two, count as keywords.

Nothing rests on one script: initials of scripts without capitals say nothing, separators need no blanks around them, and what stands between
the separators of scripts without blanks counts by its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.session import Scratch

#: A unit is furniture if this share of its host's differing pages, and at least so many, hold it. The share bounds the
#: number of such units of a host by (units of a page) / FURNITURE_SHARE, however large the host.
FURNITURE_SHARE, FURNITURE_LEAST, CONTENT_WORDS = 0.005, 3, 6
#: Words of a short unit at most, words between separators of a list at most, times a pair is repeated at least,
#: shapes that may make up the stuffing of a page.
SHORT, PIECE, REPEATED, FEW = 8, 5.0, 4, 6
#: Least share of all words for a keyword in sentences: of two words, of one word.
PAIR_SHARE, WORD_SHARE = 0.12, 0.14

_END = re.compile(r"[.!?…。！？]+[\"”»’')\]]*$")
_SPLIT = re.compile(r"(?<=[.!?…])[\"”»’]?\s+|(?<=[.!?…][\"”»’])\s+|(?<=[。！？])")
_SEPARATOR = re.compile(r"^[|/•·*–—\-»>;,、，；｜・]+$")
_TIGHT = re.compile(r"(?<=[^\W\d_])[,;|/、，；｜・]+(?=[^\W\d_#])")
_LINK = re.compile(r"https?://|www\.")
_YEAR = re.compile(r"^(?:19|20)\d\d$")
_CODE = re.compile(r"^[^\W\d_]{1,3}-?\d{2,}$")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿฀-๿]")
_EDGE = "\"'“”„«»()[]{}.,;:!?…#|/•·、，；｜・。！？"
_ENDS = frozenset(".!?…。！？")


class Shape(NamedTuple):
    kind: str  # sentence, data, link, tag, list, short or run
    size: int  # bucket of the number of words
    initial: str  # A, a, or - for scripts without capitals
    separators: int
    links: bool


class Unit(NamedTuple):
    words: list[str]
    separators: int
    links: int
    tags: int
    numbers: int


def units(text: str | None) -> list[str]:
    """The lines of a text, cut after sentence ends."""
    if not text:
        return []
    return [u for line in text.splitlines() for u in _SPLIT.split(line.strip()) if u and not u.isspace()]


def read(unit: str) -> Unit:
    """The words of a unit and what else stands between blanks; a count in brackets is a separator, all product codes are one word."""
    if ("," in unit or "/" in unit or "|" in unit or ";" in unit or not unit.isascii()) and not _LINK.search(unit):
        unit = _TIGHT.sub(" , ", unit)
    words: list[str] = []
    separators = links = tags = numbers = 0
    for t in unit.split():
        first = t[0]
        if first == "#" and len(t) > 1:
            tags += 1
            continue
        if first in 'hw(<"' and _LINK.search(t):
            links += 1
            continue
        w = t.strip(_EDGE)
        if not w:
            separators += 1
            continue
        separators += t[-1] in ",;|/、，；｜"
        if w.isalpha():
            words.append(w.lower())
        elif "0" <= w[0] <= "9":
            if first == "(" and t[-1] == ")" and w.isdigit():
                separators += 1
            elif _YEAR.match(w):
                words.append(w)
            else:
                numbers += 1
        elif _CODE.match(w):
            words.append("0")
        elif _SEPARATOR.match(t):
            separators += 1
        elif any(c.isalpha() for c in w):
            words.append(w.lower())
    return Unit(words, separators, links, tags, numbers)


def _size(n: int) -> int:
    return 0 if n < 1 else 1 if n < 2 else 2 if n < 4 else 3 if n <= SHORT else 4 if n <= 2 * SHORT else 5


def shape(unit: str, u: Unit) -> tuple[Shape, int]:
    """The shape of a unit and its number of words, links and tags."""
    n = len(u.words)
    if not unit.isascii() and _UNSPACED.search(unit):
        n = sum(max(1, len(w) // 2) if _UNSPACED.search(w) else 1 for w in u.words)
    first = next((c for c in unit if c.isalpha()), "")
    initial = "A" if first.isupper() else "a" if first.islower() else "-"
    ended = unit[-1] in _ENDS or bool(_END.search(unit))
    total = n + u.links + u.tags
    if u.links and (4 * u.links >= n or u.links >= 4):
        kind = "link"
    elif u.tags and 2 * u.tags >= total + u.numbers:
        kind = "tag"
    elif u.numbers and (n <= SHORT or 4 * u.numbers >= n):
        kind = "data"
    elif 4 <= u.separators < n <= PIECE * (u.separators + 1) and not (ended and initial != "a" and n > 3 * (u.separators + 1)):
        kind = "list"
    elif ended and n >= 4:
        kind = "sentence"
    else:
        kind = "short" if n <= SHORT else "run"
    return Shape(kind, _size(n), initial, min(u.separators, 4), u.links > 0), total


def _plain(unit: str) -> bool:
    """Whether a unit is a sentence at sight, without reading its words."""
    return (
        unit[-1] in _ENDS
        and unit[0].isupper()
        and unit.count(" ") >= 5
        and unit.count(",") + unit.count(";") + unit.count("|") + unit.count("/") + unit.count("(") < 4
        and "#" not in unit
        and "www." not in unit
        and "://" not in unit
        and (unit.isascii() or not _UNSPACED.search(unit))
    )


def _keywords(sentences: list[list[str]]) -> tuple[set[tuple[str, str]], set[str]]:
    """The pairs and the single words that sentences repeat over and over."""
    counts = Counter(w for ws in sentences for w in ws)
    total = sum(counts.values()) or 1
    often = {w for w, c in counts.items() if c >= REPEATED and 2 * c >= PAIR_SHARE * total}
    if not often:
        return set(), set()
    pairs: Counter[tuple[str, str]] = Counter()
    pair_twice: Counter[tuple[str, str]] = Counter()
    word_twice: Counter[str] = Counter()
    distinct = {tuple(ws) for ws in sentences}
    for ws in distinct:
        own = Counter(p for p in zip(ws, ws[1:]) if p[0] in often and p[1] in often)
        pairs.update(own)
        pair_twice.update(p for p, c in own.items() if c >= 2)
        word_twice.update(w for w, c in Counter(w for w in ws if w in often).items() if c >= 2)
    # a keyword is a pair that stands at least twice in one sentence, in several sentences, or a word that does so in most of them
    two = {p for p, c in pair_twice.items() if c >= 3 and 2 * pairs[p] >= PAIR_SHARE * total}
    one = {w for w, c in word_twice.items() if c >= 3 and 2 * c >= len(distinct) and counts[w] >= WORD_SHARE * total and (len(w) > 3 or not w.isascii())}
    return two, one


def stuffed(text: str | None, furniture: set[int]) -> bool:
    """Whether more than half of a page's own words are keywords, links or tags."""
    own = [u for u in units(text) if unit_hash(u) not in furniture] if furniture else units(text)
    if not own:
        return False
    sentences: list[list[str]] = []
    other: list[str] = []
    for u in own:
        if _plain(u):
            sentences.append([w.strip(_EDGE) for w in u.lower().split()])
        else:
            other.append(u)
    prose = sum(len(ws) for ws in sentences)
    groups: Counter[Shape] = Counter()
    links = tags = pieces = marked = rows = low = capital = 0
    rest: list[tuple[Shape, int, Unit]] = []
    for line in other:
        u = read(line)
        s, n = shape(line, u)
        rest.append((s, n, u))
        if s.kind == "sentence":
            sentences.append(u.words)
            prose += n
    two, one = _keywords(sentences)
    if not two and not one and prose >= sum(n for s, n, _ in rest if s.kind != "sentence"):
        return False
    if two or one:
        prose = 0
        for ws in sentences:
            pair = Counter(p for p in zip(ws, ws[1:]) if p in two)
            single = Counter(w for w in ws if w in one)
            covered = 2 * sum(pair.values()) if max(pair.values(), default=0) >= 2 else sum(single.values()) if max(single.values(), default=0) >= 2 else 0
            if covered >= (0.28 if pair else WORD_SHARE) * max(1, len(ws)) and covered:
                groups[Shape("sentence", _size(len(ws)), "A", 0, False)] += len(ws)
                marked += 1
            else:
                prose += len(ws)
    pairs = Counter(p for ws in {tuple(u.words) for s, _, u in rest if s.kind != "sentence"} for p in zip(ws, ws[1:]))
    spoken = sum(pairs.values()) or 1
    repeated = {p for p, c in pairs.items() if c >= REPEATED and c >= 0.01 * spoken}
    for s, n, u in rest:
        if s.kind == "sentence":
            continue
        links, tags = links + u.links, tags + u.tags
        share = sum(p in repeated for p in zip(u.words, u.words[1:])) / max(1, len(u.words) - 1)
        if s.kind == "list":
            pieces += u.separators + 1
            marked += share > 0
        elif s.kind == "run":
            if share < 0.25:
                prose += n
                continue
            marked += 4
        elif s.kind == "short":
            if s.initial != "a" and not share and not s.separators:
                capital += n
                continue
            marked += share > 0
            rows += n >= 2
            pieces += u.separators
            low += n
        elif s.kind == "data":
            prose += n
            continue
        groups[s] += n
    # short lines with capitals go with the page's other short lines: nouns are capitals somewhere, verses are none of it
    few = sum(n for _, n in groups.most_common(FEW)) + (capital if low >= capital else 0)
    prose += 0 if low >= capital else capital
    return few > prose and (links >= 5 or tags >= 5 or pieces >= 8 or marked >= 4 or rows >= 15)


def unit_hash(unit: str) -> int:
    return xxhash.xxh64_intdigest(unit) - (1 << 63)


_PAGE = unit_hash("")


def _hosts(docs: DataFrame) -> DataFrame:
    """(text, host): null hosts, and all pages of a table without hosts, are one host."""
    host = F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))) if "source" in docs.columns else F.lit(0).cast("long")
    return docs.withColumn("_host", host)


def furniture_units(docs: DataFrame) -> DataFrame:
    """(host, units): hashes of the units that stand on many differing pages of a host, counted over the whole corpus.

    Copies and near copies of a page count once: a page's content is named by the smallest hashes of its longer units, and a unit
    is counted by the different names it stands beside, once without and once with the last of them, whichever is less. A host with fewer than
    ``FURNITURE_LEAST`` differing pages has no furniture.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            host, page, other, unit = [], [], [], []
            for h, text in zip(batch["_host"], batch["text"]):
                every = set(units(text))
                if every:
                    known = {u: unit_hash(u) for u in every}
                    own = set(known.values())
                    # a mirror's line changes few of the smallest hashes; each unit is named by others than itself
                    content = sorted(known[u] for u in every if u.count(" ") >= CONTENT_WORDS - 1)[:3] or sorted(own)[:3]
                    for u in (*own, _PAGE):
                        rest = [c for c in content if c != u][:2] or [u]
                        page.append(rest[0])
                        other.append(rest[-1])
                        unit.append(u)
                    host += [h] * (len(own) + 1)
            if unit:
                yield pd.DataFrame({"host": np.array(host, np.int64), "unit": unit, "page": page, "other": other})

    scratch = Scratch(docs.sparkSession, "furniture")
    named = _hosts(docs).where(F.col("text").isNotNull()).select("text", "_host").mapInPandas(emit, "host long, unit long, page long, other long")
    pages = named.groupBy("host", "unit", "page").agg(F.min("other").alias("other"))
    beside = pages.groupBy("host", "unit", "other").agg(F.count(F.lit(1)).alias("n"))
    counted = beside.groupBy("host", "unit").agg(F.least(F.sum("n"), F.count(F.lit(1))).alias("n")).where(F.col("n") >= FURNITURE_LEAST)
    counted = scratch.keep(counted)
    hosts = counted.where(F.col("unit") == _PAGE).select("host", F.col("n").alias("pages"))
    shared = counted.where(F.col("unit") != _PAGE).join(hosts, "host").where(F.col("n") >= FURNITURE_SHARE * F.col("pages"))
    return scratch.keep(shared.groupBy("host").agg(F.collect_list("unit").alias("units")))  # bounded by the share


def stuffed_pages(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id) of the pages flagged.

    Null, empty and blank texts are never flagged; a doc_id with several rows is flagged if any of them is; texts are read whole. One counting pass
    and one map over the corpus; the hosts' furniture is joined, so Spark broadcasts it where it is small and splits a large host where not.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, set[int]] = {}
        for batch in batches:
            flagged = []
            for doc, text, host, own in zip(batch["doc_id"], batch["text"], batch["_host"], batch["units"]):
                furniture = known.get(host)
                if furniture is None:
                    if len(known) > 2_000:
                        known.clear()
                    furniture = known[host] = set() if own is None else set(own.tolist())
                if stuffed(text, furniture):
                    flagged.append(doc)
            if flagged:
                yield pd.DataFrame({"doc_id": flagged})

    own = furniture_units(docs).withColumnRenamed("host", "_host")
    rows = _hosts(docs).where(F.col("text").isNotNull()).select("doc_id", "text", "_host").join(own, "_host", "left")
    return rows.select("doc_id", "text", "_host", "units").mapInPandas(judge, "doc_id long").distinct()

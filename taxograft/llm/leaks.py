"""Evaluation texts that leak into a corpus: SimHash windows, multi-index Hamming blocks, exact verification.

1. Words are folded so that case, punctuation, accents and wrongly decoded letters do not matter: Latin words keep their ASCII letters and digits,
   words of other scripts all their letters, and scripts written without blanks give one word a letter. UTF-8 that was read as Latin-1 is read
   again. Item words are weighted by their inverse document frequency over the whole corpus.
2. Every run of ``window`` words of every document and, at a stride of ``STRIDE``, of every item gets a 64-bit SimHash: the signs of
   the weighted sum of its words' random signs. Windows are sized to the items: half an item at most.
3. The items' fingerprints are indexed in four 16-bit blocks, each holding all values within two bits. Two
   fingerprints within RADIUS = 11 bits agree in some block up to two bits (pigeonhole), so the index returns every
   fingerprint within the radius; full distances then sort out the rest. A passage with a word in seven replaced may have no such
   window; so every run of ``RUN`` item words is looked up too, and several runs of one item near one diagonal make a candidate.
4. Candidates are verified by exact weighted-shingle similarity: a shingle of five item words and one of the document agree if the words they
   share in place carry half of the shingle's weight; the weight of the item's words in agreeing shingles, taken in order with any furniture in
   between, over the item's weight is the similarity. Rows of the item are held against the region a block at a time, so memory does not
   grow with the product of their lengths.

The items are the query set: they are processed in blocks of a bounded number of fingerprints, each broadcast (at most some 130 MB, see
MAX_FINGERPRINTS), against all documents. Documents never move: the search is one map over the corpus after one counting pass.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window at most, stride of the item windows, Hamming radius, rows for words outside the items, item
#: fingerprints in one broadcast index.
WINDOW, STRIDE, RADIUS, UNKNOWN, MAX_FINGERPRINTS = 12, 3, 11, 4096, 60_000
#: Least similarity (half of an item, less one word in seven, less its neighbours' shingles), least share of the weight
#: found outside the phrases that items share that must be in order, and least number of matched words outside them.
MIN_COVER, MIN_ORDER, MIN_WORDS = 0.38, 0.8, 10
#: Least share of a shingle's weight that agrees.
AGREE = 0.5
#: Pairs of an item and a region word compared at a time.
CELLS = 1 << 20
#: Words of a run looked up letter for letter, runs that make a candidate, words of an item for each of these.
RUN, RUNS, RUN_WORDS = 3, 3, 8
#: An opening is shared if this many items hold one of its five-word shingles.
SHARED_BY, SHINGLE = 3, 5

_UNSPACED = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_SPACES = re.compile("[\\s\u2010-\u2015\u2026\u3000-\u303f]+")
_LOST = re.compile(r"(?<=[a-z])\?+(?=[a-z])")
# Latin letters beyond ASCII, marks, quotes and symbols: what a false charset makes of them differs
_FOREIGN = re.compile("[\x80-\u036f\u1dc0-\u1eff\u2000-\u2e7f\ufb00-\ufb06\ufe00-\ufe0f\ufff0-\uffff]+")
_WORD = re.compile("[a-z0-9]+")
_ANY_WORD = re.compile(f"[{_UNSPACED}]|[a-z0-9]+|(?:(?![a-z0-9{_UNSPACED}])[^\\W_])+")
# two to four bytes of UTF-8 read as Windows-1252 or Latin-1
_HIGH = "\x80-\xbf" + "".join(bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0))
_MISREAD = re.compile(f"[\xc2-\xf4][{_HIGH}]{{1,3}}")


def _reread(m: re.Match) -> str:
    raw = b"".join(c.encode("latin-1") if c < "\u0100" else c.encode("cp1252") for c in m[0])
    return raw.decode("utf-8", "ignore")


def words(text: str | None) -> list[str]:
    """The folded words of a text, none for null: ASCII letters and digits of Latin words, all letters of other scripts."""
    if not text:
        return []
    if text.isascii():
        text = text.lower()
        return _WORD.findall(_LOST.sub("", text) if "?" in text else text)
    if "\xd0" in text or "\xd1" in text or "\xe3" in text or "\xce" in text or "\xd8" in text or "\xe0" in text:
        text = _MISREAD.sub(_reread, text)
    text = _FOREIGN.sub("", _SPACES.sub(" ", text.lower()))
    text = _LOST.sub("", text) if "?" in text else text
    return _WORD.findall(text) if text.isascii() else _ANY_WORD.findall(text)


def document_frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """In how many of all documents each item word stands, and their number: a map-side count, one row per item word and partition."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Counter[str] = Counter()
        for batch in batches:
            own[""] += len(batch)  # no word is empty
            for text in batch["text"]:
                own.update(shared.value.intersection(words(text)))
        if own:
            yield pd.DataFrame({"w": list(own), "n": list(own.values())})

    rows = docs.select("text").mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    found = {r["w"]: r["n"] for r in rows}  # at most the items' own vocabulary
    return found, found.pop("", 0)


class ItemIndex:
    """Fingerprints of a block of items in multi-index Hamming blocks; pickled into a broadcast."""

    def __init__(self, items: list[tuple[int, list[str]]], frequency: dict[str, int], n_docs: int, shared: set[tuple[str, ...]] | None = None):
        vocabulary = sorted({w for _, ws in items for w in ws})
        self.rows = {w: i for i, w in enumerate(vocabulary)}
        idf = lambda n: max(1, round(8 * np.log((n_docs + 1) / (n + 0.5))))
        top = idf(1)
        seeds = [(w, idf(frequency.get(w, 0))) for w in vocabulary] + [(f"\x00{i}", top) for i in range(UNKNOWN)]
        h = np.array([xxhash.xxh64_intdigest(w) for w, _ in seeds], np.uint64)
        bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32)
        self.table = (2 * bits - 1) * np.array([x for _, x in seeds], np.int32)[:, None]
        shared = shared_shingles(ws for _, ws in items) if shared is None else shared
        self.ids = [i for i, _ in items]
        self.words = [np.array([self.rows[w] for w in ws], np.int32) for _, ws in items]
        weight = np.array([x for _, x in seeds], np.int32)
        self.weights = [weight[ws] for ws in self.words]
        self.core = []
        for _, ws in items:
            core = np.ones(len(ws), bool)
            for i in range(len(ws) - SHINGLE + 1):
                if tuple(ws[i : i + SHINGLE]) in shared:
                    core[i : i + SHINGLE] = False
            # an opening is less than half a text; what shares more are versions of one text
            self.core.append(core if 2 * core.sum() >= len(ws) else np.ones(len(ws), bool))
        self.blocks: dict[int, dict] = {}
        by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, ws in enumerate(self.words):
            if len(ws):
                size = max(1, min(WINDOW, len(ws) // 2))
                by_size[size] += [(n, s) for s in dict.fromkeys([*range(0, len(ws) - size + 1, STRIDE), len(ws) - size])]
        flips = [0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i, j in combinations(range(16), 2))]
        for size, places in by_size.items():
            prints = np.concatenate([self.prints(self.words[n][s : s + size], size) for n, s in places])
            tables = []
            for b in range(4):
                part = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                keys = (part[:, None] ^ np.array(flips)).ravel()
                owner = np.repeat(np.arange(len(prints), dtype=np.int32), len(flips))
                order = np.argsort(keys, kind="stable")
                tables.append((np.searchsorted(keys[order], np.arange(65537)).astype(np.int64), owner[order]))
            self.blocks[size] = {"prints": prints, "item": np.array([n for n, _ in places], np.int32), "start": np.array([s for _, s in places], np.int32), "tables": tables}

        self.runs: dict[int, tuple[np.ndarray, ...]] = {}
        self.lengths = np.array([len(ws) for ws in self.words], np.int64)
        short: dict[int, list[int]] = defaultdict(list)
        for n, ws in enumerate(self.words):
            if len(ws):
                short[max(1, min(RUN, len(ws) // 2))].append(n)
        for size, owners in short.items():
            keys = np.concatenate([run_keys(self.words[n], size) for n in owners])
            item = np.repeat(owners, [len(self.words[n]) - size + 1 for n in owners])
            start = np.concatenate([np.arange(len(self.words[n]) - size + 1) for n in owners])
            order = np.argsort(keys, kind="stable")
            known, first, count = np.unique(keys[order], return_index=True, return_counts=True)
            self.runs[size] = (known, first, count, item[order], start[order])

    def run_hits(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, offset) of the runs that stand near others of their item in ``ids``."""
        docs, items, offsets = [], [], []
        for size, (known, first, count, item, start) in self.runs.items():
            keys = run_keys(ids, size)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            w = np.nonzero((known[at] == keys) & (owner[: len(keys)] == owner[size - 1 :]))[0]
            n = count[at[w]]
            e = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at[w]], n)
            w = np.repeat(w, n)
            docs.append(owner[w])
            items.append(item[e])
            offsets.append(w - start[e])
        if not docs:
            return (np.zeros(0, np.int64),) * 3
        d, i, o = (np.concatenate(x) for x in (docs, items, offsets))
        order = np.lexsort((o, i, d))
        d, i, o = d[order], i[order], o[order]
        need = np.clip(self.lengths[i] // RUN_WORDS, 1, RUNS)
        keep = need == 1
        for k in range(2, RUNS + 1):
            a, b = slice(0, max(0, len(d) - k + 1)), slice(k - 1, None)
            near = np.nonzero((need[a] == k) & (d[a] == d[b]) & (i[a] == i[b]) & (o[b] - o[a] <= self.lengths[i[a]]))[0] if len(d) >= k else []
            for step in range(k):
                keep[np.asarray(near, np.int64) + step] = True
        return d[keep], i[keep], o[keep]

    def prints(self, ids: np.ndarray, size: int) -> np.ndarray:
        """The SimHash of each window of ``size`` words."""
        if len(ids) < size:
            return np.zeros(0, np.uint64)
        sums = np.zeros((len(ids) + 1, 64), np.int32)
        np.cumsum(self.table[ids], axis=0, out=sums[1:])
        return np.packbits(sums[size:] - sums[:-size] > 0, axis=1, bitorder="little").view(np.uint64).ravel()

    def hits(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item fingerprint) of every pair within the radius."""
        block = self.blocks[size]
        found: list[np.ndarray] = []
        for b, (starts, owner) in enumerate(block["tables"]):
            key = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            first, n = starts[key], starts[key + 1] - starts[key]
            total = int(n.sum())
            if not total:
                continue
            w = np.repeat(np.arange(len(prints)), n)
            at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            f = owner[at]
            near = np.bitwise_count(prints[w] ^ block["prints"][f]) <= RADIUS
            found.append(w[near] * len(block["prints"]) + f[near])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // len(block["prints"]), both % len(block["prints"])

    def holds(self, item: int, region: np.ndarray) -> bool:
        """Whether the region of a document is similar enough to the item by weighted shingles in order."""
        core = self.core[item]
        similarity, order, inside = shingle_similarity(self.words[item], region, self.weights[item], core)
        return similarity >= MIN_COVER and order >= MIN_ORDER and inside >= min(MIN_WORDS, MIN_COVER * max(1, int(core.sum())))


def shared_shingles(texts: Iterable[list[str]]) -> set[tuple[str, ...]]:
    """The shingles that at least SHARED_BY different texts hold."""
    seen = Counter(s for ws in {tuple(ws) for ws in texts} for s in {ws[i : i + SHINGLE] for i in range(len(ws) - SHINGLE + 1)})
    return {s for s, n in seen.items() if n >= SHARED_BY}


def run_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key of each run of ``size`` words; what shares one by chance is sorted out later."""
    n = max(0, len(ids) - size + 1)
    key = np.zeros(n, np.uint64)
    for j in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    return key


def shingle_similarity(item: np.ndarray, region: np.ndarray, weights: np.ndarray, core: np.ndarray) -> tuple[float, int, float]:
    """The share of the item's weight in agreeing shingles in their order; of what agrees outside shared phrases, the share of the
    weight that is in order; and the number of those words."""
    n, m, reach = len(item), len(region), SHINGLE // 2
    total = max(1, int(weights.sum()))
    if int(weights[np.isin(item, region)].sum()) < MIN_COVER * total:
        return 0.0, 0, 0.0  # too little even word by word
    padded = np.zeros(n + 2 * reach, np.int64)
    padded[reach : n + reach] = weights
    whole = sum(padded[d : n + d] for d in range(SHINGLE))
    best = np.zeros(m + 1, np.int64)  # the heaviest chain that ends before a place of the region
    inside = np.zeros(m + 1, np.int64)  # the same outside shared phrases, with the number of words in the low bits
    anywhere = 0
    step = max(1, CELLS // (m + 1))
    for a in range(0, n, step):
        b = min(n, a + step)
        low, high = max(0, a - reach), min(n, b + reach)
        agreed = np.zeros((b - a + 2 * reach, m + 2 * reach), np.int32)
        rows = slice(low - a + reach, high - a + reach)
        agreed[rows, reach : m + reach] = np.where(item[low:high, None] == region[None, :], weights[low:high, None], 0)
        support = sum(agreed[d : d + b - a, d : d + m] for d in range(SHINGLE))
        good = (agreed[reach : reach + b - a, reach : m + reach] > 0) & (support >= AGREE * whole[a:b, None])
        for i in np.nonzero(good.any(axis=1))[0].tolist():
            at = np.nonzero(good[i])[0]
            weight = int(weights[a + i])
            longer = best[at] + weight
            best[at + 1] = np.maximum(best[at + 1], longer)
            np.maximum.accumulate(best, out=best)
            if core[a + i]:
                anywhere += weight
                longer = inside[at] + ((weight << 32) + 1)
                inside[at + 1] = np.maximum(inside[at + 1], longer)
                np.maximum.accumulate(inside, out=inside)
    heaviest = int(inside[-1])
    return float(best[-1]) / total, (heaviest >> 32) / max(1, anywhere), heaviest & 0xFFFFFFFF


def _search(index: ItemIndex, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, known = index.rows, len(index.rows)
    memo: dict[str, int] = {}

    def row(w: str) -> int:
        i = rows.get(w)
        return known + zlib.crc32(w.encode()) % UNKNOWN if i is None else i

    def ids_of(text: str | None) -> list[int]:
        out = []
        for w in words(text):
            i = memo.get(w)
            if i is None:
                if len(memo) > 500_000:
                    memo.clear()
                i = memo[w] = row(w)
            out.append(i)
        return out

    def flush(docs: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
        ids = np.concatenate([np.array(d, np.int32) for _, d in docs])
        ends = np.cumsum([len(d) for _, d in docs])
        owner = np.repeat(np.arange(len(docs)), [len(d) for _, d in docs])
        offsets: dict[tuple[int, int], list[int]] = defaultdict(list)
        for size, block in index.blocks.items():
            step = 16384
            for a in range(0, max(0, len(ids) - size + 1), step):
                w, f = index.hits(index.prints(ids[a : a + step + size - 1], size), size)
                w += a
                inside = owner[w] == owner[w + size - 1]
                for place, k in zip(w[inside], f[inside]):
                    offsets[int(owner[place]), int(block["item"][k])].append(int(place) - int(block["start"][k]))
        for d, item, start in zip(*(x.tolist() for x in index.run_hits(ids, owner))):
            offsets[d, item].append(start)
        out = []
        for (d, item), starts in offsets.items():
            n, begin, end = len(index.words[item]), int(ends[d]) - len(docs[d][1]), int(ends[d])
            starts = sorted(set(starts))
            at = 0
            while at < len(starts):
                last = at
                while last + 1 < len(starts) and starts[last + 1] - starts[last] <= n:
                    last += 1
                region = ids[max(begin, starts[at] - n // 2) : min(end, starts[last] + 2 * n)]
                if index.holds(item, region):
                    out.append((docs[d][0], index.ids[item]))
                    break
                at = last + 1
        return out

    def frame(found: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["doc_id", "item_id"])

    waiting: list[tuple[int, list[int]]] = []
    held = 0
    for batch in batches:
        found: list[tuple[int, int]] = []
        for doc, text in zip(batch["doc_id"], batch["text"]):
            ids = ids_of(text)
            if ids:
                waiting.append((doc, ids))
                held += len(ids)
            if held > 200_000:
                found += flush(waiting)
                waiting, held = [], 0
        if found:
            yield frame(found)
    if waiting:
        yield frame(flush(waiting))


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id): the documents that hold an item or a passage with half of its words in order.

    Null, empty and blank texts hold nothing and leak nowhere; repeated rows count once; items with one id and several texts leak if
    any of them does. Very long documents are searched whole. Without items or documents the result is empty.
    """
    spark = docs.sparkSession
    rows = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text")
    docs = docs.where(F.col("text").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    size = 0
    for r in rows.toLocalIterator():
        ws = words(r["text"])
        if ws:
            blocks[-1].append((r["item_id"], ws))
            size += len(ws) // STRIDE + 2
            if size > MAX_FINGERPRINTS:
                blocks.append([])
                size = 0
    blocks = [b for b in blocks if b]
    kind = "doc_id long, item_id long"
    if not blocks:
        return spark.createDataFrame([], kind)
    openings = shared_shingles(ws for block in blocks for _, ws in block)
    out = None
    for block in blocks:
        frequency, n_docs = document_frequencies(docs, {w for _, ws in block for w in ws})
        shared = spark.sparkContext.broadcast(ItemIndex(block, frequency, n_docs, openings))
        part = docs.mapInPandas(lambda batches, s=shared: _search(s.value, batches), kind)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def leak_report(found: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """Per suite and item: the documents and sources that hold it (0 where none does)."""
    where = docs.select("doc_id", "source").distinct()
    per = found.join(where, "doc_id", "left").groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("source").alias("n_sources"))
    return items.select("item_id", "suite").distinct().join(per, "item_id", "left").fillna(0, ["n_docs", "n_sources"])

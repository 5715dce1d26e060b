"""Token ids of whole texts by a public byte-level BPE vocabulary, in linear time.

A piece of text is mapped byte by byte to Latin-1, so pyahocorasick (which works on characters) can walk its bytes. From the
longest token at the start, the encoder takes the longest match at each place; a token may follow another only if the pair is
compatible, that is if merging the bytes of both by rank would give exactly these two tokens. Where it is not, the encoder falls
back to the next shorter token at that place, and where none is left it gives up the token before. Places that lead
nowhere are marked, so each is left once at most. Compatibility of a pair does not depend on the text and is memoised, as are the
ids of short pieces. The result equals that of applying the merges in the order of their ranks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-tokenisation pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces up to this many bytes are memoised, and so many of them per worker; pairs likewise.
MEMO_BYTES, MEMO_PIECES, MEMO_PAIRS = 48, 400_000, 2_000_000


class ByteBpe:
    """An encoder for a vocabulary whose token ids are the ranks of the merges."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.length = [0] * (max(ranks.values()) + 1)
        self.shorter = [-1] * len(self.length)  # the longest token that is a proper prefix
        self.parts: list[tuple[int, int]] = [(-1, -1)] * len(self.length)  # the two tokens whose merge makes it
        self.merge: dict[tuple[int, int], int] = {}
        self.trie = ahocorasick.Automaton()
        for text, rank in sorted(self.ids.items(), key=lambda x: x[1]):
            self.length[rank] = len(text)
            self.trie.add_word(text, rank)
            for k in range(len(text) - 1, 0, -1):
                if (head := self.ids.get(text[:k])) is not None:
                    self.shorter[rank] = head
                    break
            self.parts[rank] = self._last_merge(text, rank)
            if self.parts[rank][0] >= 0:
                self.merge[self.parts[rank]] = rank
        self.trie.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def _last_merge(self, text: str, rank: int) -> tuple[int, int]:
        """The pair that the merges below ``rank`` leave of the token's bytes; itself a single byte: none."""
        if len(text) == 1:
            return -1, -1
        symbols = [self.ids[c] for c in text]
        while len(symbols) > 2:
            best = min((self.merge.get(p, rank), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if best[0] >= rank:
                return -1, -1
            symbols[best[1] : best[1] + 2] = [best[0]]
        return symbols[0], symbols[1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens again."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the merges of both tokens from the latest on. The tokens are torn apart by a merge across the
        # border exactly if such a merge comes before the one that next has to happen on either side.
        limit = len(self.length)
        while True:
            across = self.merge.get((left, right))
            if across is not None and across < limit:
                return False
            # the later of the two was made last; the border's own symbol before that is its inner part
            if left > right:
                limit, (_, left_inner) = left, self.parts[left]
                if left_inner < 0:
                    limit, (right_inner, _) = right + 1, self.parts[right]
                    if right_inner < 0:
                        return True
                    right = right_inner
                else:
                    left = left_inner
            else:
                limit, (right_inner, _) = right + 1, self.parts[right]
                if right_inner < 0:
                    limit, (_, left_inner) = left, self.parts[left]
                    if left_inner < 0:
                        return True
                    left = left_inner
                else:
                    right = right_inner

    def _longest(self, piece: str) -> list[int]:
        """The longest token that starts at each place."""
        out = [-1] * len(piece)
        for end, rank in self.trie.iter(piece):
            start = end - self.length[rank] + 1
            if out[start] < 0 or self.length[out[start]] < self.length[rank]:
                out[start] = rank
        return out

    def encode_bytes(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, longest, ids = len(piece), self._longest(piece), []
        usable = bytearray([1]) * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            last = ids[-1] if ids else -1
            while True:
                end = at + self.length[token]
                if usable[end] and (last < 0 or self.compatible(last, token)):
                    ids.append(token)
                    at = end
                    if at < n:
                        token = longest[at]
                    break
                if self.shorter[token] >= 0:
                    token = self.shorter[token]
                    continue
                usable[at] = 0
                token = ids.pop()
                at -= self.length[token]
                # this token leads nowhere from here; its place is looked at again with a shorter one
                break
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; none for null and for empty texts."""
        if not text:
            return []
        out: list[int] = []
        memo = self.pieces
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace").decode("latin-1")
                ids = self.encode_bytes(raw)
                if len(raw) <= MEMO_BYTES:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """One encoder per worker process and vocabulary."""
    return ByteBpe(path)


def encode_corpus(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) of every row: the ids of the whole ``text``.

    Null and empty texts have an empty list; repeated rows stay repeated; other columns are ignored; strings that look like special
    tokens are ordinary text. A map without a shuffle: its cost is linear in the text. The vocabulary file must be readable at
    the same path on every executor.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(vocabulary)
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [bpe.encode(t) for t in batch["text"]]})

    return docs.select("doc_id", "text").mapInPandas(encode, "doc_id long, ids array<int>")

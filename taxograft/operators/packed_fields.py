"""Several values packed in one field: infer the separators per source, then split with positions.

Two passes over the field, both in Arrow batches:

1. *Profile.* Every candidate separator is tried on every field outside quotes. Per source the operator sums, for each candidate, the fields
   that hold it, their pieces (and squares, for the spread of the piece counts) and the pieces' word counts, and the same for pieces that
   are certain (quoted ones and list literals). A candidate's score is its piece-count consistency (1 for equal counts, less the wider they
   spread) times its piece type regularity (1 if its pieces have as many words as the certain ones, less the farther they are off). Candidates that enough
   fields hold and that score well are accepted, in the order of their scores. Small sources lean on the profile of the whole table. Where nothing is
   certain, candidates are held against the mean of all, each weighted by its consistency.
2. *Split.* Each field is split at all accepted strong separators it holds; only where it holds none, at the best
   accepted weak one (comma, slash, blank between quotes), since those may stand bare inside a value.

Nothing is collected but nothing needs to be: the profile has one row per source and is joined back.
"""

from __future__ import annotations

import ast
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxograft.session import Scratch

#: Candidates: name, pattern, and whether it may also stand bare inside a value (weak). Strong ones first.
CANDIDATES: tuple[tuple[str, str, bool], ...] = (
    ("sep", r"\[\s*[sS][eE][pP]\s*\]", False),
    ("newline", r"\r\n|\r|\n", False),
    ("tab", r"\t", False),
    ("pipe", r"\|", False),
    ("semicolon", r";", False),
    ("guillemet", r"»", False),
    ("colons", r"::", False),
    ("greater", r">", False),
    ("spaced_slash", r"(?<=\s)/(?=\s)", True),
    ("comma", r",", True),
    ("slash", r"/", True),
    ("quoted_blank", r"(?<=[\"”])\s+(?=[\"“])", True),
)
_PATTERN = {name: pattern for name, pattern, _ in CANDIDATES}
_COMPILED = {name: re.compile(pattern) for name, pattern, _ in CANDIDATES}
_WEAK = tuple(name for name, _, weak in CANDIDATES if weak)
_STRONG = tuple(name for name, _, weak in CANDIDATES if not weak)

#: Share of a source's fields that must hold a candidate; least score; how far the mean words of its pieces may lie from those of the
#: certain pieces to halve its regularity, in standard deviations or as a share; the weight of the table's own profile in
#: fields; scores that differ by less than this are told apart by the order of CANDIDATES, the more specific first.
MIN_SHARE, MIN_SCORE, DEVIATIONS, RATIO, PRIOR_FIELDS, SCORE_STEP = 0.002, 0.6, 1.0, 0.35, 200.0, 0.2
NO_SOURCE = "\u0000"

_QUOTED = re.compile(r"""(?:"(?:[^"\\]|""|\\.)*"|“[^”]*”|«[^«»]*»|'(?:[^'\\]|''|\\.|'(?=\w))*'(?=\s*(?:$|[,;|/>»\r\n\t]|::|\[)))""")
_OPENING = '"“«\''
_LITERAL = re.compile(r"^\s*[\[(]\s*(?:['\"].*['\"]\s*)?,?\s*[\])]\s*$", re.S)
_BULLET = re.compile(r"^\s*(?:[-*•‣·–—]\s+|\(?\d{1,3}[.)]\s+)")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_PROMPT = re.compile(r"^\s*summari[sz]e\s*:\s*", re.I)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_MASK = ""


def _unescape(piece: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1]
        return chr(int(code[1:], 16)) if len(code) == 5 else _SHORT.get(code, code)

    return _ESCAPE.sub(one, piece)


def _clean(piece: str) -> str:
    """A piece without outer blanks, bullets or numbering, quotes and brackets, and with escapes undone."""
    piece = _BULLET.sub("", piece).strip()
    while len(piece) >= 2:
        a, b = piece[0], piece[-1]
        if a == b == '"':
            piece = piece[1:-1].replace('""', '"').replace('\\"', '"').strip()
        elif (a, b) in (("'", "'"), ("“", "”"), ("‘", "’"), ("«", "»"), ("[", "]"), ("{", "}")):
            piece = piece[1:-1].strip()
        else:
            break
    return _unescape(piece) if "\\" in piece else piece


def _literal(text: str) -> list[str] | None:
    """The members of a JSON or Python list literal of strings, else None."""
    if not _LITERAL.match(text):
        return None
    for parse in (json.loads, ast.literal_eval):
        try:
            found = parse(text.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        if isinstance(found, (list, tuple)):
            return ["" if x is None else str(x) for x in found]
    return None


def _prepare(text: str, prompt: bool) -> str:
    text = html.unescape(text) if "&" in text else text
    return _PROMPT.sub("", text, count=1) if prompt else text


def _quoted(text: str) -> Iterator[re.Match]:
    """The quoted stretches that start a piece; a mark after a letter or digit is an inch mark, an apostrophe or the like."""
    at = 0
    while m := _QUOTED.search(text, at):
        before = text[: m.start()].rstrip(" ")
        if before and _WORD.match(before[-1]):
            at = m.start() + 1
        else:
            yield m
            at = m.end()


def _mask(text: str) -> str:
    """The text with quoted stretches that start a piece blotted out, at the same length."""
    if not any(q in text for q in _OPENING):
        return text
    out, at = [], 0
    for m in _quoted(text):
        out.append(text[at : m.start()])
        out.append(_MASK * (m.end() - m.start()))
        at = m.end()
    out.append(text[at:])
    return "".join(out)


def split_field(text: str | None, accepted: tuple[str, ...], prompt: bool = False) -> list[tuple[int, str]]:
    """(position, value) of each value in one field, the accepted separators being given best first; empty places count but give nothing; null
    gives nothing."""
    if text is None:
        return []
    text = _prepare(text, prompt)
    if not text.strip():
        return []
    members = _literal(text)
    if members is None:
        masked = _mask(text)
        # the blank between quotes has to be looked for where the quotes still stand
        use = [n for n in _STRONG if n in accepted and _COMPILED[n].search(masked)]
        if not use:
            use = [n for n in accepted if n in _WEAK and n != "quoted_blank" and _COMPILED[n].search(masked)][:1]
        if use:
            cuts = list(re.finditer("|".join(_PATTERN[n] for n in use), masked))
        elif "quoted_blank" in accepted:
            cuts = list(re.finditer(rf"(?<={_MASK}) +(?={_MASK})", masked))
        else:
            cuts = []
        members, at = [], 0
        for m in cuts:
            members.append(text[at : m.start()])
            at = m.end()
        members.append(text[at:])
        if cuts and cuts[0].group().strip() == "" and "newline" in use and not members[0].strip():
            members = members[1:]  # a line break before the first bullet is layout, not an empty place
        members = [_clean(x) for x in members]
    else:
        members = [x.strip() for x in members]
    return [(i, x) for i, x in enumerate(members, 1) if x]


def _profile_one(text: str | None, prompt: bool) -> list[tuple[str, int, float, float, float, float]]:
    """(candidate, fields, pieces, squared pieces, words, squared words) of one field; candidate '' holds the certain pieces."""
    if text is None or not text.strip():
        return []
    text = _prepare(text, prompt)

    def row(name: str, pieces: list[str]) -> tuple[str, int, float, float, float, float]:
        n = [len(_WORD.findall(x)) for x in pieces if x.strip()]
        return name, 1, float(len(n)), float(len(n) ** 2), float(sum(n)), float(sum(x * x for x in n))

    members = _literal(text)
    if members is not None:
        return [row("", members)]
    masked = _mask(text)
    rows = [("*", 1, 0.0, 0.0, 0.0, 0.0)]
    if _MASK in masked:
        rows.append(row("", [m[0] for m in _quoted(text)]))
    # only fields that hold one strong candidate, or no strong one, tell of a candidate's own pieces
    held = [n for n in _STRONG if _COMPILED[n].search(masked)]
    if not held:
        held = [n for n in _WEAK if n != "quoted_blank" and _COMPILED[n].search(masked)][:1]
    if len(held) == 1:
        cuts = list(_COMPILED[held[0]].finditer(masked))
        ends = [0, *(m.end() for m in cuts)]
        starts = [*(m.start() for m in cuts), len(text)]
        rows.append(row(held[0], [text[a:b] for a, b in zip(ends, starts)]))
    return rows


def separator_profile(df: DataFrame, text: str, source: str, prompt: bool = False) -> DataFrame:
    """One row per source with the accepted separators, best first (``accepted`` array<string>), and every candidate's share of the
    fields and score (``scores`` array<struct>).

    Input: any frame with the text and source columns (null sources form one source of their own).
    An empty frame gives an empty profile.
    """
    kind = T.StructType.fromDDL("source string, candidate string, fields long, pieces double, counts double, words double, squares double")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple, list[float]] = {}
            for src, value in zip(batch["source"], batch["text"]):
                for name, *numbers in _profile_one(value, prompt):
                    into = sums.setdefault((src, name), [0, 0.0, 0.0, 0.0, 0.0])
                    for i, x in enumerate(numbers):
                        into[i] += x
            if sums:
                yield pd.DataFrame([(s, c, *v) for (s, c), v in sums.items()], columns=kind.names)

    base = df.select(F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    sums = ("fields", "pieces", "counts", "words", "squares")
    per = base.mapInPandas(count, kind).groupBy("source", "candidate").agg(*[F.sum(c).alias(c) for c in sums])
    per = Scratch(df.sparkSession, "profile").keep(per.withColumn("source", F.coalesce("source", F.lit(NO_SOURCE))))
    # one row per candidate, of which there are a fixed few: the table's own profile as a prior of every source
    whole = {r["candidate"]: r for r in per.groupBy("candidate").agg(*[F.sum(c).alias(c) for c in sums]).collect()}
    scale = PRIOR_FIELDS / max(1.0, float(whole["*"]["fields"]) if "*" in whole else 0.0)
    names = [n for n in whole if n not in ("", "*")]
    flat = per.groupBy("source").agg(
        *[
            (F.sum(F.when(F.col("candidate") == n, F.col(c)).otherwise(0)) + F.lit(float(whole[n][c] if n in whole else 0.0) * scale)).alias(f"{c}_{i}")
            for i, n in enumerate(["", "*", *names])
            for c in sums
        ]
    )
    order = [c for c, _, _ in CANDIDATES]
    shape = "source string, accepted array<string>, scores array<struct<candidate:string,share:double,score:double>>"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_scores({n: tuple(r[f"{c}_{i}"] for c in sums) for i, n in enumerate(["", "*", *names])}) for r in batch.to_dict("records")]
            good = [[x for x in own if x[1] > MIN_SHARE and x[2] >= MIN_SCORE] for own in rows]
            best = [[n for n, _, _ in sorted(own, key=lambda x: (-int(x[2] / SCORE_STEP), order.index(x[0])))] for own in good]
            yield pd.DataFrame({"source": batch["source"], "accepted": best, "scores": [[dict(zip(("candidate", "share", "score"), x)) for x in own] for own in rows]})

    return flat.mapInPandas(score, shape)


def _scores(sums: dict[str, tuple[float, ...]]) -> list[tuple[str, float, float]]:
    """(candidate, share of the fields, score) from the sums (fields, pieces, squared pieces, words, squared words) of a source."""
    # equal piece counts give 1, counts that spread as widely as they are large one half
    even = {n: 1 / (1 + max(0.0, c * f / (p * p) - 1)) if p else 0.0 for n, (f, p, c, _, _) in sums.items()}
    found = [n for n in sums if n not in ("", "*")]
    _, pieces, _, words, squares = sums[""]
    if pieces < 1:
        pieces, words, squares = (sum(even[n] * sums[n][i] for n in found) for i in (1, 3, 4))
    centre = words / max(pieces, 1e-9)
    width = max(DEVIATIONS * max(0.0, squares / max(pieces, 1e-9) - centre * centre) ** 0.5, RATIO * centre, 1e-9)
    off = {n: abs(sums[n][3] / max(sums[n][1], 1e-9) - centre) / width for n in found}
    return [(n, sums[n][0] / max(sums["*"][0], 1e-9), even[n] / (1 + off[n] ** 2)) for n in found]


def with_pieces(df: DataFrame, text: str, source: str, prompt: bool = False) -> DataFrame:
    """``df`` with a column ``_pieces`` (array<struct<pos, val>>): the values of each field; empty for null, empty and blank fields.

    The list of accepted separators comes from :func:`separator_profile`, joined on the source.
    """
    profile = separator_profile(df, text, source, prompt).select(F.col("source").alias("_src"), F.col("accepted").alias("_acc"))

    @F.pandas_udf("array<struct<pos:int,val:string>>")
    def pieces(value: pd.Series, accepted: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"pos": p, "val": v} for p, v in split_field(x, ("quoted_blank", *a) if a is not None else tuple(_PATTERN), prompt)]
                for x, a in zip(value, accepted)
            ]
        )

    joined = df.join(profile, F.coalesce(df[source].cast("string"), F.lit(NO_SOURCE)) == F.col("_src"), "left")
    return joined.withColumn("_pieces", pieces(F.col(text), F.col("_acc"))).drop("_src", "_acc")


def split_packed(df: DataFrame, text: str, source: str, keep: list[Column], prompt: bool = False) -> DataFrame:
    """One row per value: the ``keep`` columns, ``pos`` (from 1, counting empty places) and ``val``.

    Null, empty and blank fields give no row; repeated rows give repeated values; very long fields are split
    whole; extra columns are ignored.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    base = df.select(*[c.alias(n) for c, n in zip(keep, names)], F.col(text).alias("_text"), F.col(source).alias("_source"))
    out = with_pieces(base.where(F.col("_text").isNotNull()), "_text", "_source", prompt)
    return out.select(*names, F.explode("_pieces").alias("_p")).select(*names, F.col("_p.pos").alias("pos"), F.col("_p.val").alias("val"))


def packed_names(big7: DataFrame, triples: DataFrame, prompts: DataFrame) -> DataFrame:
    """Distinct (rec_table, rec_key, pos, val) over the three packed fields of this project."""

    def part(name: str, df: DataFrame, text: str, source: str, key: Column, prompt: bool = False) -> DataFrame:
        one = split_packed(df, text, source, [key.cast("string")], prompt)
        return one.select(F.lit(name).alias("rec_table"), F.col("_k0").alias("rec_key"), "pos", "val")

    parts = [
        part("big7_data", big7, "breadcrumb", "site_id", F.concat_ws("_", "site_id", "cat_id")),
        part("emb_triples", triples, "negatives_label", "source", F.col("row_id")),
        part("gen_prompts", prompts, "text", "source", F.col("row_id"), True),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()

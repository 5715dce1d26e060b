"""Canonical forms of category names, shared by matching operators."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BRACKETED = re.compile(r"\s*\(\s*\d+\s*\)(?=\s*(?:,|\W*$))")
_APOSTROPHE = re.compile(r"['’ʼ`´]")
_TOKEN = re.compile(r"[^\W_]+")


def canonical_name(name: str | None) -> str | None:
    """The name without case, blanks, punctuation, quotes, escapes, accents, a bracketed number at the end and word order.

    Null stays null; a name without any letter or digit gives an empty string.
    """
    if name is None:
        return None
    text = name
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        if "Ã" in text or "Â" in text:
            try:
                text = text.encode("cp1252").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = text.lower()
    if "(" in text:
        text = _BRACKETED.sub("", text.strip())
    if "'" in text or "`" in text or not text.isascii():
        text = _APOSTROPHE.sub("", text)
    words = _TOKEN.findall(text)
    words.sort()
    return " ".join(words)


def canonical(name: Column | str) -> Column:
    """:func:`canonical_name` of a column."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return pd.Series([canonical_name(x) for x in names], dtype=object)

    return run(name)

"""RDF triples of Turtle, N-Triples and RDF/XML files.

N-Triples are read line by line, so a file of any size is split over tasks; it is the format for large ontologies. Turtle and RDF/XML can't
be cut (prefixes, nesting): a file is parsed by one task, many files by many.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "{http://www.w3.org/XML/1998/namespace}"
KIND = "s string, p string, o string, literal boolean"

Triple = tuple[str, str, str, bool]

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
      | <(?P<iri>[^<>"{}|^`\\\s]*(?:\\u[0-9A-Fa-f]{4}[^<>"{}|^`\\\s]*)*)>
      | (?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
      | (?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      | (?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s))
      | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      | (?P<mark>\^\^|[;,.\[\]()](?![0-9]))
      | (?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      | (?P<name>(?:_:)?[^\W\d_]?[\w\-]*(?:\.[\w\-]+)*:?(?:[\w\-:%]|\\[_~.\-!$&'()*+,;=/?\#@%]|\.(?=[\w\-:%\\]))*)""",
    re.X,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_SHORT = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def unescape(text: str) -> str:
    """A literal's text with its escapes undone."""
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _SHORT.get(m[1], m[1]), text)


class TurtleError(ValueError):
    pass


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise TurtleError(f"can't read at {text[at:at + 40]!r}")
        at = m.end()
        if m.lastgroup != "skip":
            yield m.lastgroup, m[m.lastgroup]


def turtle(text: str, base: str = "") -> list[Triple]:
    """The triples of a Turtle document: prefixes, bases, ``a``, lists of predicates and objects, blank nodes, collections, literals."""
    tokens = list(_tokens(text))
    prefixes: dict[str, str] = {}
    out: list[Triple] = []
    at = blank = 0

    def peek() -> tuple[str, str]:
        return tokens[at] if at < len(tokens) else ("end", "")

    def take(*marks: str) -> str:
        nonlocal at
        kind, value = peek()
        if marks and (kind != "mark" or value not in marks):
            raise TurtleError(f"{marks[0]!r} expected, not {value!r}")
        at += 1
        return value

    def fresh() -> str:
        nonlocal blank
        blank += 1
        return f"_:anon{blank}"

    def named(value: str) -> str:
        if value.startswith("_:"):
            return value
        prefix, colon, local = value.partition(":")
        if not colon or prefix not in prefixes:
            raise TurtleError(f"unknown name {value!r}")
        return prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def node() -> tuple[str, bool]:
        nonlocal at
        kind, value = peek()
        at += 1
        if kind == "iri":
            return urljoin(base, unescape(value)) if base else unescape(value), False
        if kind in ("text", "long"):
            cut = 3 if kind == "long" else 1
            if peek()[0] == "lang":
                at += 1
            elif peek() == ("mark", "^^"):
                at += 1
                node()
            return unescape(value[cut:-cut]), True
        if kind == "number" or (kind == "name" and value in ("true", "false")):
            return value, True
        if kind == "name":
            return named(value), False
        if (kind, value) == ("mark", "["):
            own = fresh()
            if peek() != ("mark", "]"):
                about(own)
            take("]")
            return own, False
        if (kind, value) == ("mark", "("):
            members = []
            while peek() != ("mark", ")"):
                members.append(node())
            take(")")
            head = RDF + "nil"
            for o, literal in reversed(members):
                cell = fresh()
                out.extend([(cell, RDF + "first", o, literal), (cell, RDF + "rest", head, False)])
                head = cell
            return head, False
        raise TurtleError(f"a term expected, not {value!r}")

    def about(s: str) -> None:
        nonlocal at
        while True:
            if peek() == ("name", "a"):
                at += 1
                p = RDF + "type"
            else:
                p = node()[0]
            while True:
                o, literal = node()
                out.append((s, p, o, literal))
                if peek() != ("mark", ","):
                    break
                take(",")
            while peek() == ("mark", ";"):
                take(";")
            if peek()[0] == "end" or peek() in (("mark", "."), ("mark", "]")) or tokens[at - 1] != ("mark", ";"):
                return

    while peek()[0] != "end":
        kind, value = peek()
        if kind == "directive":
            at += 1
            if value.lstrip("@").lower() == "prefix":
                name = take()
                if not name.endswith(":"):
                    raise TurtleError(f"a prefix expected, not {name!r}")
                iri = node()[0]
                prefixes[name[:-1]] = iri
            else:
                base = node()[0]
            if value.startswith("@"):
                take(".")
            continue
        s, _ = node()
        if peek() != ("mark", "."):
            about(s)
        take(".")
    return out


def rdfxml(data: bytes, base: str = "") -> list[Triple]:
    """The triples of an RDF/XML document: node elements by ``rdf:about``, ``rdf:ID`` or ``rdf:nodeID``, nested or not, property elements and
    attributes. Collections give their members as objects."""
    root = ET.parse(io.BytesIO(data)).getroot()
    out: list[Triple] = []
    blank = 0
    r = lambda name: f"{{{RDF}}}{name}"
    uri = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def node(e: ET.Element, base: str) -> str:
        nonlocal blank
        base = e.get(XML + "base", base)
        if e.get(r("about")) is not None:
            s = urljoin(base, e.get(r("about"))) if base else e.get(r("about"))
        elif e.get(r("ID")) is not None:
            s = f"{base.split('#')[0]}#{e.get(r('ID'))}"
        elif e.get(r("nodeID")) is not None:
            s = f"_:{e.get(r('nodeID'))}"
        else:
            blank += 1
            s = f"_:anon{blank}"
        if e.tag != r("Description"):
            out.append((s, RDF + "type", uri(e.tag), False))
        for name, value in e.attrib.items():
            if not name.startswith((f"{{{RDF}}}", XML)) and name.startswith("{"):
                out.append((s, uri(name), value, True))
        for p in e:
            if p.get(r("resource")) is not None:
                o = p.get(r("resource"))
                out.append((s, uri(p.tag), urljoin(base, o) if base else o, False))
            elif p.get(r("nodeID")) is not None:
                out.append((s, uri(p.tag), f"_:{p.get(r('nodeID'))}", False))
            elif len(p):
                if p.get(r("parseType")) == "Resource":
                    blank += 1
                    own = f"_:anon{blank}"
                    out.append((s, uri(p.tag), own, False))
                    out.extend((own, uri(c.tag), (c.text or "").strip(), True) for c in p)
                else:
                    out.extend((s, uri(p.tag), node(c, base), False) for c in p)
            else:
                out.append((s, uri(p.tag), p.text or "", True))
        return s

    base = root.get(XML + "base", base)
    for e in root if root.tag == r("RDF") else [root]:
        node(e, base)
    return out


def _files(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(parse(bytes(content)), columns=["s", "p", "o", "literal"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, KIND)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, literal) of a file or folder, by its suffix: ``.nt`` N-Triples, ``.ttl`` and ``.n3`` Turtle, anything else RDF/XML."""
    if path.endswith(".nt"):
        return ntriples(spark, path)
    if path.endswith((".ttl", ".n3")):
        return _files(spark, path, lambda data: turtle(data.decode("utf-8")))
    return _files(spark, path, rdfxml)


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """A line a triple; comments and blank lines are skipped, any other line that is no triple is an error."""
    line = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:[^\s.]+)|"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
    part = lambda i: F.regexp_extract("value", line, i)
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))

    @F.pandas_udf("string")
    def plain(text: pd.Series) -> pd.Series:
        return text.map(lambda x: unescape(x) if "\\" in x else x)

    bad = F.raise_error(F.concat(F.lit("no triple: "), F.substring("value", 1, 80)))
    checked = rows.select(F.when(F.col("value").rlike(line), F.col("value")).otherwise(bad).alias("value"))
    literal = (part(3) == "") & (part(4) == "")
    found = checked.select(F.regexp_replace(part(1), "^<|>$", "").alias("s"), part(2).alias("p"), F.when(part(3) != "", part(3)).when(part(4) != "", part(4)).otherwise(part(5)).alias("o"), literal.alias("literal"))
    return found.select(plain("s").alias("s"), plain("p").alias("p"), plain("o").alias("o"), "literal")

"""Packed fields, orphan references and hierarchies on small cases."""

import datetime as dt
import random

import pytest

from taxograft.operators.hierarchy import descendants, hierarchy
from taxograft.operators.orphan_refs import big7_orphans, bloom_filter, bloom_hits, orphan_report, orphans
from taxograft.operators.packed_fields import _PATTERN, separator_profile, split_field, split_packed
from taxograft.plans import general_queries
from tests.helpers import rows

ALL = tuple(_PATTERN)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        ("   ", []),
        ("[]", []),
        ("A b | C d |  | E", [(1, "A b"), (2, "C d"), (4, "E")]),
        ('"Nuts, Bolts" ; Pins', [(1, "Nuts, Bolts"), (2, "Pins")]),
        ('X > "7"" Tablets" > Y', [(1, "X"), (2, '7" Tablets'), (3, "Y")]),
        ("['A', '', \"B's\"]", [(1, "A"), (3, "B's")]),
        ('["L\\u00e9 a", "12\\" b"]', [(1, "Lé a"), (2, '12" b')]),
        ("P &gt; Q &amp; R", [(1, "P"), (2, "Q & R")]),
        ("One / Audio/Visual / Two", [(1, "One"), (2, "Audio/Visual"), (3, "Two")]),
        ("A; B\tC|D", [(1, "A"), (2, "B"), (3, "C"), (4, "D")]),
        ("x\r\ny\nz", [(1, "x"), (2, "y"), (3, "z")]),
        ('"A b" "C d"', [(1, "A b"), (2, "C d")]),
        ("'Shoes, low','Boots'", [(1, "Shoes, low"), (2, "Boots")]),
        ("'Men's shoes, low', Boys' boots", [(1, "Men's shoes, low"), (2, "Boys' boots")]),
        ("«A, b» | C", [(1, "A, b"), (2, "C")]),
        ("A » B » C", [(1, "A"), (2, "B"), (3, "C")]),
        ('Men\'s 7" Tablets, Girls\' Hats', [(1, 'Men\'s 7" Tablets'), (2, "Girls' Hats")]),
    ],
)
def test_split_field(text, want):
    assert split_field(text, ALL) == want


def test_the_best_weak_separator_cuts():
    assert split_field("a, b/c / d", ("spaced_slash", "comma")) == [(1, "a, b/c"), (2, "d")]
    assert split_field("a, b/c / d", ("comma", "spaced_slash")) == [(1, "a"), (2, "b/c / d")]


def test_scores(spark):
    """Separators are told from marks inside names by even piece counts and by pieces that look like the certain ones."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    name = lambda n=3: " ".join(word() for _ in range(n))
    data = []
    for i in range(400):
        # commas separate; a slash stands now and then inside a name, and parts it into single words
        data.append((f'"{name()}", {name()}, {name()}', "even"))
        data.append((f"{word()} / {word()} / {word()} / {word()}" if i % 2 else f'"{name()}", "{name()}"', "words"))
        # without any certain piece
        data.append((f"{name()}; {name()}; {name()}", "plain"))
    df = spark.createDataFrame(data, "text string, src string")
    got = {r["src"]: (r["accepted"], {x["candidate"]: x["score"] for x in r["scores"]}) for r in separator_profile(df, "text", "src").withColumnRenamed("source", "src").collect()}
    assert "comma" in got["even"][0] and "spaced_slash" not in got["words"][0]
    assert got["words"][1]["spaced_slash"] < 0.5 < 0.9 < got["even"][1]["comma"]
    assert "semicolon" in got["plain"][0]
    alone = separator_profile(df.where("src = 'plain'"), "text", "src").first()
    assert alone["accepted"] == ["semicolon"]
    uneven = spark.createDataFrame([("; ".join(name() for _ in range(n)), "s") for n in [1, 2, 40] * 30], "text string, src string")
    even = spark.createDataFrame([("; ".join(name() for _ in range(5)), "s") for _ in range(90)], "text string, src string")
    score = lambda d: separator_profile(d, "text", "src").first()["scores"][0]["score"]
    assert score(uneven) < 0.6 < score(even)


def test_prompts():
    assert split_field("Summarise :\n1. A a\n2. \"B b\"", ALL, True) == [(1, "A a"), (2, "B b")]
    assert split_field("summarize: A[SEP][sep] B", ALL, True) == [(1, "A"), (3, "B")]
    assert split_field("Only Name", ALL, True) == [(1, "Only Name")]


def test_profile_and_split(spark):
    rnd = random.Random(1)
    name = lambda: " ".join("".join(rnd.choice("abcdef") for _ in range(5)).title() for _ in range(3))
    data = []
    for i in range(300):
        names = [name() for _ in range(rnd.randint(2, 5))]
        sep, source = ((", ", "comma") if i % 2 else (" | ", "pipe"))
        if source == "pipe":
            names[0] += ", Large"  # a comma inside a value stands bare where the pipe separates
        data.append((i, sep.join(f'"{n}"' if j == 1 else n for j, n in enumerate(names)), source, names))
    df = spark.createDataFrame([(i, t, s, "clash") for i, t, s, _ in data], "id long, text string, src string, source string")
    accepted = dict(rows(separator_profile(df, "text", "src"), "source", "accepted"))
    assert "comma" in accepted["comma"] and "pipe" in accepted["pipe"]
    got = split_packed(df, "text", "src", [df["id"]])
    assert rows(got, "_k0", "pos", "val") == sorted((i, j, n) for i, _, _, names in data for j, n in enumerate(names, 1))
    assert split_packed(df.limit(0), "text", "src", [df["id"]]).count() == 0
    long = spark.createDataFrame([(1, "|".join(["Abc Def"] * 5000), None), (2, None, "s"), (3, "", None)], "id long, text string, src string")
    assert split_packed(long, "text", "src", [long["id"]]).count() == 5000


def test_bloom(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS h")
    bits, n = bloom_filter(keys, 5000)
    inside = spark.range(5000).selectExpr("xxhash64(id) AS h").toPandas()["h"].to_numpy()
    outside = spark.range(10_000, 30_000).selectExpr("xxhash64(id) AS h").toPandas()["h"].to_numpy()
    assert bloom_hits(bits, n, inside).all() and bloom_hits(bits, n, outside).mean() < 0.02
    bits, n = bloom_filter(keys.limit(0), 0)
    assert not bloom_hits(bits, n, inside).any()


def test_orphans(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    refs = spark.createDataFrame(
        [("r1", "a", t(5)), ("r2", "a", t(1)), ("r3", "b", t(5)), ("r4", "zz", t(5)), ("r5", None, t(5)), ("r6", "c", t(9)), ("r6", "c", t(9)), ("r7", "a", None), ("r8", "c", t(3))],
        "record_key string, key string, at timestamp",
    )
    parents = spark.createDataFrame(
        [("a", t(2), None), ("a", t(4), None), ("b", t(1), t(5)), ("c", t(1), t(2)), ("c", t(3), t(4)), ("d", None, None), (None, t(1), None)],
        "key string, valid_from timestamp, valid_to timestamp",
    )
    assert rows(orphans(refs, parents), "record_key") == [("r2",), ("r3",), ("r4",), ("r6",), ("r6",), ("r7",)]
    assert orphans(refs, parents.limit(0)).count() == 8 and orphans(refs.limit(0), parents).count() == 0


def test_big7_orphans(spark):
    t = lambda m: dt.datetime(2024, m, 1)
    big = spark.createDataFrame(
        [(0, 3, "1 > 2>3", t(2), None), (0, 2, "1>2", t(3), None), (0, 1, None, t(1), t(2)), (9, 4, "4", t(2), None), (0, 3, "1 > 2>3", t(2), None)],
        "site_id int, cat_id bigint, id_breadcrumb string, loaded_at timestamp, deleted_at timestamp",
    )
    sites = spark.createDataFrame([(0, t(1), None), (9, t(1), t(2))], "site_id int, opened_at timestamp, closed_at timestamp")
    found = big7_orphans(big, sites)
    assert rows(found) == [
        ("big7_data", "0_2", "0_1", "2024-03"), ("big7_data", "0_3", "0_1", "2024-02"), ("big7_data", "0_3", "0_2", "2024-02"), ("sites", "9_4", "9", "2024-02"),
    ]
    assert rows(orphan_report(found), "target_table", "period", "n_orphans") == [("big7_data", "2024-02", 2), ("big7_data", "2024-03", 1), ("sites", "2024-02", 1)]


def _walk(nodes, links):
    out = {}
    for n in nodes:
        path, seen, x = [n], {n}, n
        while links.get(x) in nodes:
            x = links[x]
            if x in seen:
                path = None
                break
            seen.add(x)
            path.append(x)
        out[n] = ("cycle", -1, "cycle") if path is None else (path[-1], len(path) - 1, "/".join(reversed(path)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy(spark, seed):
    rnd = random.Random(seed)
    n = 60
    nodes = {str(i) for i in range(n)}
    links = {str(i): str(rnd.randrange(max(0, i - 3), i) if rnd.random() < 0.9 else rnd.randrange(n + 5)) for i in range(1, n)}
    nd = spark.createDataFrame([(x, 1) for x in [*nodes, "0", None]], "node string, extra int")
    ld = spark.createDataFrame([*links.items(), *list(links.items())[:5], (None, "1"), ("3", None)], "node string, parent string")
    tree = hierarchy(nd, ld)
    want = _walk(nodes, links)
    assert {r["node"]: (r["root"], r["depth"], r["path"]) for r in tree.collect()} == want and tree.count() == n
    down = rows(descendants(tree), "node", "descendant", "distance")
    assert down == sorted((a, x, len(w[2].split("/")) - 1 - i) for x, w in want.items() if w[1] > 0 for i, a in enumerate(w[2].split("/")[:-1]))


def test_hierarchy_empty(spark):
    none = spark.createDataFrame([], "node string, parent string")
    assert hierarchy(none.select("node"), none).count() == 0


def test_descendants_of_both_hierarchies(spark, tmp_path):
    save = lambda name, data, kind: spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    save("taxo_nodes", [(1, "a"), (2, "b")], "id long, label string")
    save("taxo_edges", [(2, 1)], "src long, tgt long")
    save("big7_data", [(0, 5, "5"), (0, 6, "5 > 6"), (0, 7, "5>6 >7"), (1, 6, "5>6")], "site_id int, cat_id long, id_breadcrumb string")
    got = rows(general_queries.QUERIES["p5_descendants_all"](spark, str(tmp_path)), "hierarchy", "node", "descendant", "distance")
    assert got == [("big7_data", "0_5", "0_6", 1), ("big7_data", "0_5", "0_7", 2), ("big7_data", "0_6", "0_7", 1), ("taxo_nodes", "1", "2", 1)]

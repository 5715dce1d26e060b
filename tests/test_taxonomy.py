import json

import pytest
from pyspark.sql import functions as F

from taxograft.model import CycleError, EditSession, TreeTaxonomy
from taxograft.operators import closure as cl
from taxograft.operators import lattice, space
from taxograft.sources import taxonomies as src
from tests.helpers import column, make, one, rows

ANIMALS = {0: "Root", 1: "Animal", 2: "Mammal", 3: "Bird", 4: "Dog"}
SIMPLE = [(1, 0), (2, 1), (3, 1), (4, 2)]
DIAMOND = [(1, 0), (2, 0), (3, 1), (3, 2), (4, 1), (4, 2)]


@pytest.fixture(scope="module")
def simple(spark):
    return make(spark, SIMPLE, ANIMALS)


@pytest.fixture(scope="module")
def diamond(spark):
    return make(spark, DIAMOND)


def test_counts_and_labels(spark, simple):
    assert rows(simple.stats()) == [(5, 4, 1, 2)]
    assert rows(simple.labels_of(one(spark, 0, 4)), "node", "label") == [(0, "Root"), (4, "Dog")]
    assert simple.labels_of(one(spark, 99)).first()["known"] is None


def test_walks(spark, simple):
    assert column(simple.children(one(spark, 1)), "child") == [2, 3]
    assert column(simple.parents(one(spark, 2)), "parent") == [1]
    assert column(simple.ancestors(one(spark, 4)), "anc") == [0, 1, 2]
    assert column(simple.descendants(one(spark, 1)), "desc") == [2, 3, 4]
    assert column(simple.ancestors(one(spark, 4), max_depth=1), "anc") == [2]
    assert column(simple.leaves(), "id") == [3, 4] and column(simple.roots(), "id") == [0]
    assert rows(simple.siblings(one(spark, 3)), "sibling") == [(2,)] and rows(simple.siblings(one(spark, 0))) == []


def test_subsumes(spark, simple):
    p = spark.createDataFrame([(1, 4), (3, 4), (2, 2), (7, 7), (7, 1)], "upper bigint, lower bigint")
    assert rows(simple.subsumes(p), "upper", "lower", "subsumes") == [(1, 4, True), (2, 2, True), (3, 4, False), (7, 1, False), (7, 7, True)]


def test_edits(spark, simple):
    edge = lambda *e: spark.createDataFrame(list(e), "src bigint, tgt bigint")
    _, codes = simple.add_edges(edge((0, 4), (4, 2), (3, 0), (5, 5), (3, None)).where("tgt is not null"))
    assert rows(codes, "src", "tgt", "code") == [(0, 4, -1), (3, 0, 0), (4, 2, 1), (5, 5, -1)]
    after, codes = simple.add_edges(edge((10, 11), (11, 12), (12, 10), (13, 4)))
    assert rows(codes, "src", "code") == [(10, -1), (11, -1), (12, -1), (13, 0)]
    assert 13 in column(after.nodes, "id") and 10 not in column(after.nodes, "id")
    node = lambda *n: spark.createDataFrame(list(n), "id bigint, label string")
    again, codes = simple.add_nodes(node((1, "Duplicate"), (2, "Mammal"), (9, "New")))
    assert rows(codes, "id", "code") == [(1, 2), (2, 1), (9, 0)]
    assert dict(rows(again.nodes, "id", "label"))[1] == "Duplicate"
    with pytest.raises(ValueError):
        simple.add_nodes(node((None, "x")))
    gone = simple.remove_nodes(node((2, "")))
    assert rows(gone.edges, "src", "tgt") == [(1, 0), (3, 1)] and 4 in column(gone.nodes, "id")
    with pytest.raises(KeyError):
        simple.remove_edges(edge((4, 1)))
    assert rows(simple.remove_edges(edge((4, 2))).edges, "src") == [(1,), (2,), (3,)]
    assert simple.next_id() == 5


def test_undo(spark, simple):
    s = EditSession(simple)
    new = s.add_node("Cat", 2)
    assert new == 5 and s.dirty and column(s.current.children(one(spark, 2)), "child") == [4, 5]
    with pytest.raises(CycleError):
        s.add_edge(0, 4)
    s.rename(4, "Wolf")
    assert s.undo() and dict(rows(s.current.nodes, "id", "label"))[4] == "Dog"
    assert s.undo() and not s.undo() and rows(s.current.stats()) == [(5, 4, 1, 2)]


def test_reduce_and_lca(spark, simple, diamond):
    assert column(simple.reduce_subset(one(spark, 1, 4)), "node") == [4]
    assert column(simple.reduce_subset(one(spark, 1, 4), True), "node") == [1]
    assert column(simple.lca(one(spark, 3, 4)), "node") == [1]
    assert column(diamond.lca(one(spark, 3, 4)), "node") == [1, 2]
    assert column(diamond.gcd(one(spark, 1, 2)), "node") == [3, 4]
    assert dict(rows(diamond.levels, "id", "level")) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}
    assert dict(rows(diamond.reverse_levels, "id", "reverse_level")) == {3: 0, 4: 0, 1: 1, 2: 1, 0: 2}
    forest = make(spark, [(1, 0), (3, 2)], extra=[5])
    assert column(forest.lca(one(spark, 1, 3)), "node") == []
    assert column(forest.roots(), "id") == [0, 2, 5] and column(forest.leaves(), "id") == [1, 3, 5]


def test_wu_palmer(spark, diamond):
    p = spark.createDataFrame([("a", 3, 4), ("b", 0, 0), ("c", 3, 3)], "query_id string, a bigint, b bigint")
    assert dict(rows(diamond.wu_palmer(p), "query_id", "similarity")) == {"a": 0.5, "b": None, "c": 1.0}


def test_transitive_reduction_and_labels(spark):
    t = make(spark, [*SIMPLE, (4, 1, "auto"), (4, 0, "auto")], ANIMALS)
    kept = rows(t.transitive_reduction().edges, "src", "tgt")
    assert kept == sorted(SIMPLE)
    assert column(t.parents(one(spark, 4), ["original"]), "parent") == [2]
    assert dict(rows(t.levels, "id", "level"))[4] == 1
    with pytest.raises(cl.MissingLabel):
        make(spark, [(1, 0, None)]).edges.transform(lambda e: cl.edges_with(e, ["original"]))


def test_levels_and_spaces(spark, simple):
    assert 0 in column(simple.filter_by_level(0, 1), "id")
    assert column(simple.filter_by_level(-1, 1), "id") == [1, 2]
    assert column(simple.filter_by_level(1, -1), "id") == [1]
    ids, edges = space.insertion_space(one(spark, 3, 4), simple.nodes, simple.edges, simple.closure())
    assert {3, 4} <= set(column(ids, "id")) and rows(edges, "src", "tgt") == [(2, 1), (3, 1), (4, 2)]
    ids, _ = space.insertion_space(one(spark, 2), simple.nodes, simple.edges, simple.closure(), crop_top=False)
    assert column(ids, "id") == [0, 1, 2, 3]
    ids, _ = space.insertion_space(one(spark, 2), simple.nodes, simple.edges, simple.closure(), crop_top=False, strict=True)
    assert column(ids, "id") == [0, 1, 2]


def test_deep_levels_and_cycles(spark):
    chain = make(spark, [(i + 1, i) for i in range(40)])
    assert dict(rows(chain.levels, "id", "level"))[40] == 40
    assert dict(rows(chain.reverse_levels, "id", "reverse_level"))[0] == 40
    assert max(r["dist"] for r in chain.closure().collect()) == 40 and chain.closure().count() == 40 * 41 // 2
    assert cl.is_acyclic(chain.edges)
    loop = make(spark, [(2, 1), (3, 2), (1, 3), (4, 1), (5, 5), *[(10 + i, 9 + i) for i in range(20)]])
    assert rows(cl.cyclic_edges(loop.edges), "src", "tgt") == [(1, 3), (2, 1), (3, 2), (5, 5)]
    assert rows(loop.validate(), "finding", "id") == [("cycle", 1), ("cycle", 2), ("cycle", 3), ("cycle", 5)]
    with pytest.raises(CycleError):
        loop.require_acyclic()


def test_empty(spark, simple):
    none = make(spark, [(1, 0)]).edges.limit(0)
    assert cl.closure(none).count() == 0 and cl.is_acyclic(none)
    empty = simple.nodes.limit(0)
    assert cl.levels(empty, none).count() == 0
    assert lattice.lca(one(spark, 1).limit(0), simple.closure(), simple.nodes).count() == 0


def test_tree(spark):
    t = make(spark, [(1, 0), (2, 0), (3, 1)])
    tree = TreeTaxonomy(t.nodes, t.edges).require_tree()
    add = spark.createDataFrame([(3, 2)], "src bigint, tgt bigint")
    with pytest.raises(ValueError):
        tree.add_edges(add)
    moved, _ = tree.add_edges(add, overwrite=True)
    assert rows(moved.edges, "src", "tgt") == [(1, 0), (2, 0), (3, 2)]
    with pytest.raises(ValueError):
        tree.remove_nodes(spark.createDataFrame([(0,)], "id bigint"))
    assert dict(rows(tree.depth(), "id", "depth")) == {0: 0, 1: 1, 2: 1, 3: 2}
    assert dict((r["node"], list(r["crumb"])) for r in tree.breadcrumbs().collect())[3] == [0, 1, 3]


def test_json_round_trip(spark, tmp_path):
    doc = {"nodes": [{"id": 1, "label": "A", "weight": 3, "tags": ["x"]}, {"id": 2, "label": 'B "q"'}, {"id": 3, "label": "C"}], "edges": [{"src": 2, "tgt": 1, "label": "original"}, {"src": 3, "tgt": 1}]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(doc))
    t = src.load(spark, str(path))
    assert rows(t.edges, "src", "tgt") == [(1, 0), (2, 1), (3, 1)] and dict(rows(t.nodes, "id", "label"))[0] == "Root Concept"
    out = tmp_path / "u.json"
    src.to_json(t, str(out))
    again = json.loads(out.read_text())
    assert next(n for n in again["nodes"] if n["id"] == 1) == {"id": 1, "label": "A", "weight": 3, "tags": ["x"]}
    assert {(e["src"], e["tgt"]) for e in again["edges"]} == {(1, 0), (2, 1), (3, 1)}
    path.write_text(json.dumps({"nodes": [{"id": "x", "label": "A"}], "edges": []}))
    with pytest.raises(Exception):  # noqa: B017
        src.from_json(spark, str(path))
    path.write_text(json.dumps({"nodes": [{"id": 1, "label": "A"}, {"id": 2, "label": "B"}], "edges": [{"src": 1, "tgt": 2}, {"src": 2, "tgt": 1}]}))
    with pytest.raises(CycleError):
        src.from_json(spark, str(path))
    with pytest.raises(ValueError):
        src.load(spark, "x.csv")


def test_owl_round_trip(spark, tmp_path):
    t = make(spark, [(1, 0), (2, 1), (3, 1), (3, 0)], {1: "A & B", 2: "<two>"})
    src.to_owl(t, str(tmp_path / "o.owl"))
    back = src.load(spark, str(tmp_path / "o.owl"))
    assert rows(back.edges, "src", "tgt") == [(1, 0), (2, 1), (3, 1)]
    assert dict(rows(back.nodes, "id", "label"))[1] == "A & B"


def test_tables(spark):
    lv = spark.createDataFrame([(1, "a", None, None), (2, None, "b", None), (3, None, None, "c"), (4, "d", None, None), (5, None, None, "e"), (6, None, "", "f")], "CategoryID bigint, l1 string, l2 string, l3 string")
    assert rows(src.level_table(lv, ["l1", "l2", "l3"], "CategoryID"), "key", "level", "parent") == [(1, 1, 0), (2, 2, 1), (3, 3, 2), (4, 1, 0), (5, 3, 4), (6, 3, 4)]
    sizes = spark.createDataFrame([(0,), (1,), (1536,), (1 << 20,)], "n bigint").select("n", src.human_size(F.col("n")).alias("s"))
    assert dict(rows(sizes)) == {0: "0B", 1: "1.0B", 1536: "1.5KB", 1 << 20: "1.0MB"}
    main = spark.createDataFrame([("a",), ("b",)], "Key string")
    extra = spark.createDataFrame([("a", "x"), ("b", None)], "Key string, `Other Category` string")
    assert sorted((r[0], r[1]) for r in src.merge_tables(main, [extra, extra]).collect() if r[1]) == [("a", "x"), ("a", "x")]


def test_paths_and_search(spark, diamond):
    p = cl.root_paths(diamond.nodes, diamond.edges)
    assert p.count() == 7
    assert cl.path_prefixes(p).count() == 10
    parts = spark.createDataFrame([("Red red.hat",), (None,)], "label string").select(space.highlight(F.col("label"), "RED"), space.highlight(F.col("label"), ".")).collect()
    assert [tuple(x) for x in parts[0][0]] == [("Red", True), (" ", False), ("red", True), (".hat", False)] and parts[1][0] is None
    assert [x["text"] for x in parts[0][1]] == ["Red red", ".", "hat"]
    listed = space.preview_rows(p, diamond.nodes)
    assert listed.count() == 5
    assert rows(space.search_labels(diamond.nodes, "N1"), "id") == [(1,)]
    members, inner = space.neighbourhood(one(spark, 1), diamond.edges)
    assert dict(rows(members, "id", "role")) == {1: "selected", 0: "ancestor", 3: "child", 4: "child", 2: "sibling"}
    assert inner.count() == 6


def test_command_line(spark, tmp_path, capsys):
    from taxograft.cli import main

    path = tmp_path / "t.json"
    path.write_text(json.dumps({"nodes": [{"id": 1, "label": "A"}, {"id": 2, "label": "B"}], "edges": [{"src": 2, "tgt": 1, "label": "original"}]}))
    assert main(["stats", str(path)]) == 0 and "nodes: 3" in capsys.readouterr().out
    assert main(["preview", str(path)]) == 0 and "    B (2)" in capsys.readouterr().out
    assert main(["convert", str(path), str(tmp_path / "u.json")]) == 0 and main(["convert", str(path), "u.owl"]) == 1
    assert main(["validate", str(path)]) == 0
    path.write_text(json.dumps({"nodes": [{"id": 1, "label": ""}], "edges": []}))
    assert main(["validate", str(path)]) == 1


def test_training_csv(spark, tmp_path):
    df = spark.createDataFrame([("a, b", ["x", 'y "z"'])], "query_label string, negatives_label array<string>")
    src.write_training_csv(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first()
    assert back["query_label"] == "a, b" and json.loads(back["negatives_label"]) == ["x", 'y "z"']


def test_auto_targets(spark):
    from taxograft.config import MoveConfig
    from taxograft.plans.move import auto_targets

    t = make(spark, [(1, 0), (2, 0), (3, 1), (4, 1)], {3: "keep", 4: "Test one", 2: "two"})
    assert column(auto_targets(t, MoveConfig(), "Test"), "id") == [2, 3]
    assert auto_targets(t, MoveConfig(max_outer_loop=1), "Test", spark.createDataFrame([(2,)], "id bigint")).first()["id"] == 3


def test_closure_cte_rows(spark):
    """No limit on the rows of a recursion cuts the closure short, and the session's own limit stays as it was."""
    edges = make(spark, [(i, 0) for i in range(1, 40)] + [(i, i - 30) for i in range(40, 70)] + [(40, 10)]).edges
    key = cl.ROW_LIMIT
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        got = rows(cl.closure_cte(spark, edges), "node", "anc", "dist")
        assert spark.conf.get(key) == "50"
    finally:
        spark.conf.set(key, before)
    assert got == rows(cl.closure(edges), "node", "anc", "dist") and len(got) == 99


def test_neighbourhood_roles_by_query(spark):
    """Many askers below few parents, nodes with several roles, queries of two nodes, a loop: as by a search through all pairs."""
    edges = [(1, 0), (2, 0), (3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (5, 3), (6, 3), (6, 1), (7, 8), (8, 7), *((i, 2) for i in range(20, 60))]
    asks = [("a", 3), ("b", 4), ("c", 5), ("d", 1), ("d", 5), ("e", 0), ("f", 7), ("g", 99), ("h", 3), ("h", 6), *((f"n{i}", i) for i in range(20, 60))]
    e = set(edges)
    want = {}

    def put(q, node, rank):
        want[q, node] = min(rank, want.get((q, node), 9))

    for q, n in asks:
        put(q, n, 0)
        for s, t in e:
            if s == n:
                put(q, t, 1)
                for s2, t2 in e:
                    if s2 == t:
                        put(q, t2, 4)
                    if t2 == t and s2 != n:
                        put(q, s2, 3)
            if t == n:
                put(q, s, 2)
                for s2, t2 in e:
                    if t2 == s:
                        put(q, s2, 4)
    names = ("selected", "ancestor", "child", "sibling", "context")
    queries = spark.createDataFrame(asks, "query_id string, node bigint")
    got = rows(space.neighbourhood(queries, make(spark, edges).edges, 2)[0], "query_id", "id", "role")
    assert got == sorted((q, n, names[r]) for (q, n), r in want.items())


def test_neighbourhood_is_not_gathered(spark):
    """The siblings of many askers below one parent are neither shuffled nor sorted by query: only their few makers are."""
    edges = make(spark, [(i, 0) for i in range(1, 1001)]).edges
    asked = spark.range(1, 1001).select(F.col("id").alias("query_id"), F.col("id").alias("node"))
    tail = space.neighbourhood(asked, edges, 2)[0]._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert "Aggregate" not in tail and "Exchange" not in tail


def test_listed_siblings_places(spark):
    """Listings of nodes with one and several parents, equal and missing labels, an asker twice, and a parent with more children than a part holds."""
    edges = [(1, 0), (2, 0), (3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (6, 2), (7, 1), (7, 2), (7, 2), (8, 9), *((i, 6) for i in range(100, 2600))]
    labels = {3: "b", 4: "a", 5: "b", 6: "c", 7: None, 1: "x", 2: "x"} | {i: f"l{i % 7}" for i in range(100, 2600)}
    t = make(spark, edges, labels)
    asks = [("a", 3), ("b", 4), ("a", 7), ("c", 3), ("c", 3), ("d", 0), ("e", 8), ("f", 5), ("g", 1), ("h", 100), ("i", 2599), ("j", 77)]
    want = []
    for q, n in sorted(set(asks)):
        found = {s for s, p in edges if s != n and (n, p) in edges}
        ordered = sorted(found, key=lambda s: (labels.get(s, f"n{s}") is not None, labels.get(s, f"n{s}") or "", s))
        want += [(q, n, s, labels.get(s, f"n{s}"), i) for i, s in enumerate(ordered, 1)]
    listed = space.listed_siblings(spark.createDataFrame(asks, "query_id string, node bigint"), t.edges, t.nodes)
    key = lambda r: (r[0], r[1], r[4])
    assert sorted((tuple(r) for r in listed.select("query_id", "node", "sibling", "label", "place").collect()), key=key) == sorted(want, key=key)
    # each asker's listing is not sorted again
    assert "Window" not in listed._jdf.queryExecution().executedPlan().toString()

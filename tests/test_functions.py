import dataclasses
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taxograft.config import InsertionConfig, MoveConfig, from_dict, from_yaml, update
from taxograft.functions import lexical, models
from taxograft.functions.names import canonical_name
from taxograft.operators import vectors as vec
from taxograft.operators.closure import closure
from taxograft.plans import enrich, move, pipelines, taxonomy_queries, traindata
from tests.helpers import column, make, rows

WORDS = [(2, 1), (3, 1), (4, 2)]


def test_canonical_name():
    base = canonical_name("Léhuvu Fahaso Nuts, Bolts & Pins")
    for other in ("léhuvu fahaso NUTS; BOLTS & PINS", '"Lehuvu  Fahaso Nuts, Bolts &amp; Pins"', "Nuts, Bolts & Pins, Léhuvu Fahaso", "Léhuvu_Fahaso Nuts Bolts Pins (123)", "Nuts, Bolts & Pins (5), Léhuvu Fahaso", "LÃ©huvu Fahaso Nuts, Bolts & Pins"):
        assert canonical_name(other) == base
    assert canonical_name(None) is None and canonical_name(" -- ") == ""


def test_lexical(spark):
    df = spark.createDataFrame([("Tools (12) > Saws & Blades (7)",), ("Plain",), (None,)], "t string")
    c = F.col("t")
    got = [tuple(r) for r in df.select(lexical.normalise_breadcrumb(c, "symbol"), lexical.normalise_breadcrumb(c, "word"), lexical.normalise_breadcrumb(c, "id"), lexical.normalise_breadcrumb(c)).collect()]
    assert got[0] == ("Tools > Saws & Blades", "Tools contains Saws & Blades.", "12 7", "Tools (12) > Saws & Blades (7)")
    assert got[1] == ("Plain", "Plain.", None, "Plain") and got[2] == (None, None, None, None)
    t = spark.createDataFrame([("The Boxes of Cities > Glass",)], "t string").select(lexical.token_set(F.col("t")), lexical.tokenise(F.lit("It's a TV/DVD set.")), lexical.list_diff(F.array(F.lit(1), F.lit(2), F.lit(1)), F.array(F.lit(2)))).first()
    assert t[0] == ["box", "city", "glass"] and t[1] == ["It", "'s", "a", "TV", "/", "DVD", "set", "."] and t[2] == [1, 1]
    nodes = spark.createDataFrame([(1, "Golf Clubs"), (2, "club golf"), (3, "---")], "id bigint, label string")
    asked = spark.createDataFrame([("golf club",), ("...",)], "label string")
    assert dict(rows(lexical.lexical_match(asked, nodes))) == {"golf club": 1, "...": None}


def test_lexical_match_of_all_labels(spark, tmp_path):
    names = ["Golf Clubs", "Café, the Chairs", "Straw Hats (12)", "One Two Three Four", "Unknown"]
    spark.createDataFrame(list(enumerate(names)), "cat_id long, label string").write.parquet(f"{tmp_path}/cat_data.parquet")
    nodes = [(1, "club of golf"), (2, "golf club"), (3, "CAFÉ CHAIR"), (4, "straw hat 12"), (5, "one two three four"), (6, None)]
    spark.createDataFrame(nodes, "id long, label string").write.parquet(f"{tmp_path}/taxo_nodes.parquet")
    assert dict(rows(taxonomy_queries.QUERIES["lexical_match"](spark, str(tmp_path)), "label", "match")) == dict(zip(names, (2, 3, 4, 5, None)))


def test_hypernyms(spark):
    words = spark.createDataFrame([("dog", "animal"), ("dog", "mammal"), ("mammal", "animal")], "node string, anc string")
    p = spark.createDataFrame([("animal", "dog"), ("dog", "animal"), ("x", "x"), ("x", "y"), ("x", None), (None, "x")], "word1 string, word2 string")
    assert {(r[0], r[1]): r[2] for r in lexical.hypernym(p, words).select("word1", "word2", "hypernym").collect()} == {("animal", "dog"): True, ("dog", "animal"): False, ("x", "x"): True, ("x", "y"): False, ("x", None): True, (None, "x"): False}
    hh = {(r[0], r[1]): (r[2], r[3]) for r in lexical.hyper_hypo(p, words).collect()}
    assert hh[("dog", "animal")] == ("animal", "dog") and hh[("x", "y")] == (None, None) and hh[("x", None)] == ("x", None)
    tok = spark.createDataFrame([(1, 0, "animal"), (1, 1, "dog"), (1, 2, "red"), (2, 0, "mammal"), (2, 1, "red")], "row_id int, pos int, token string")
    assert rows(lexical.keyword_strings(tok, words)) == [(1, "dog, red"), (2, "mammal, red")]
    pair = spark.createDataFrame([(9, 1, 2)], "pair_id int, left int, right int")
    assert rows(lexical.breadcrumb_screening(pair, tok, words)) == [(9, True, False)]
    assert rows(lexical.common_parent(pair, tok, words)) == [(9, "animal"), (9, "mammal"), (9, "red")]


def test_vectors(spark):
    rng = np.random.default_rng(42)
    m = rng.random((120, 16)).astype(np.float32)
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(500, None), (501, [1.0])], "id bigint, embedding array<float>")
    store = vec.VectorStore(v, normalise=True)
    q = store.reconstruct(spark.createDataFrame([(0,), (7,)], "id bigint")).withColumnRenamed("id", "query_id")
    top = rows(store.search(q, 5), "query_id", "rank", "id")
    assert top[0] == (0, 1, 0) and len(top) == 10
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert [t[2] for t in top[:5]] == list(np.argsort(-(u @ u[0]), kind="stable")[:5])
    only = spark.createDataFrame([(i,) for i in range(5, 10)], "id bigint")
    assert {r[0] for r in rows(store.search(q, 9, subset=only), "id")} == {5, 6, 7, 8, 9}
    assert store.delete(only).ntotal == store.ntotal - 5 and store.add(v.limit(1)).ntotal == store.ntotal + 1
    l2 = rows(vec.top_k(q, store.vectors, 3, "l2"), "query_id", "rank", "id")
    assert l2[0] == (0, 1, 0)
    cells = vec.VectorStore(v.where("id < 200")).train_cells()
    exact = {(r[0], r[1]) for r in rows(vec.top_k(q, v.where("id < 200"), 10), "query_id", "id")}
    everything = {(r[0], r[1]) for r in rows(cells.search(q, 10, nprobe=11), "query_id", "id")}
    assert everything == exact
    asked = v.where("id < 120").select(F.col("id").alias("query_id"), "embedding")
    exact = {(r[0], r[1]) for r in rows(vec.top_k(asked, v.where("id < 120"), 10), "query_id", "id")}
    found = {(r[0], r[1]) for r in rows(cells.search(asked, 10, nprobe=cells.probes_for(0.95)), "query_id", "id")}
    assert len(exact & found) >= 0.9 * len(exact)
    assert vec.top_k(q.limit(0), v, 3).count() == 0


def test_hit_at_ratio(spark):
    knn = spark.createDataFrame([(1, i, r) for r, i in enumerate([1, 9, 2, 8], 1)], "query_id bigint, id bigint, rank int")
    cl = spark.createDataFrame([(0, 1), (0, 2)], "cluster_id int, id bigint")
    pr = spark.createDataFrame([(0, 1)], "probe_id int, id bigint")
    got = {round(r["ratio"], 1): r["recall"] for r in vec.hit_at_ratio(knn, cl, pr).collect()}
    assert got[0.5] == 0.5 and got[1.0] == 0.5 and got[1.5] == 1.0


def test_models(spark):
    df = spark.createDataFrame([("red wool sock", "wool"), ("sock", "red sock"), ("x", "")], "a string, b string")
    assert [r[0] for r in df.select(models.word_scorer(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, 0.0]
    assert spark.createDataFrame([(["b a c", "c b"],), (["x", "y"],)], "l array<string>").select(models.common_words(F.col("l"))).collect()[0][0] == "b c"
    py = models.sub_model(lambda a, b: np.array([float(len(x) > len(y)) for x, y in zip(a, b)]))
    assert [r[0] for r in df.select(py(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0]
    m = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1)], "label int, predicted int")
    assert tuple(models.classifier_metrics(m).first()) == (0.5, 0.5, 0.5, 0.5)
    g = spark.createDataFrame([("a b c", "a b c"), ("a b", "c d")], "x string, y string").select(models.ngram_overlap(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in g] == [1.0, 0.0]


def test_builders(spark):
    for n, cover, want in ((3, 2, [(0, 1), (0, 2), (1, 2)]), (4, 2, [(0, 1), (0, 3), (1, 2), (2, 3)]), (4, 3, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)])):
        e = spark.createDataFrame([(i + 1, 0) for i in range(n)], "src bigint, tgt bigint")
        assert rows(traindata.cluster_pairs(e, cover), "i", "j") == want
        assert spark.createDataFrame([(n,)], "n bigint").select(traindata.num_pairs(F.col("n"), cover)).first()[0] == len(want)
    t = make(spark, [(1, 0), (2, 0), *[(10 + i, 1) for i in range(4)], *[(20 + i, 2) for i in range(4)]])
    q = spark.createDataFrame([(10,), (21,)], "id bigint")
    neg = rows(traindata.negatives(t, q, 3))
    assert neg and all((a < 20) != (b < 20) or b in (1, 2) for a, b in neg)
    pos = set(rows(traindata.subsumption_positives(t)))
    bad = rows(traindata.subsumption_pairs(t), "subclass", "superclass", "labels")
    assert {(a, b) for a, b, y in bad if y} == {(f"n{a}", f"n{b}") for a, b in pos}
    anc = {(f"n{r['node']}", f"n{r['anc']}") for r in closure(t.edges).collect()}
    assert not {(a, b) for a, b, y in bad if not y} & anc
    trip = traindata.contrastive_triples(t, n_negatives=2).collect()
    assert trip and all(len(r["negatives_label"]) <= 2 for r in trip)
    gen = traindata.generation_prompts(t).collect()
    assert gen and all(r["text"].startswith("summarize: ") and r["summary"] for r in gen)
    held = traindata.hold_out(spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "cluster_id int, n int"), 5)
    assert held.count() == 2


LABELS = {0: "Root Concept", 1: "sock", 2: "wool sock", 3: "red sock", 4: "red wool sock", 5: "hat"}


def test_placement(spark):
    t = make(spark, [(1, 0), (2, 1), (3, 1), (4, 2), (5, 0)], LABELS)
    q = spark.createDataFrame([("a", "blue wool sock"), ("b", "hat"), ("c", "moon")], "query_id string, label string")
    log = {(r["query_id"], r["node"]): r["role"] for r in enrich.place(t, q, None, InsertionConfig(threshold=1.0)).log.collect()}
    assert log[("a", 2)] == "superclass" and ("a", 1) not in log
    assert log[("b", 5)] == "equivalent" and log[("c", 0)] == "superclass"
    based = enrich.place(t, q.where("query_id = 'a'"), spark.createDataFrame([("a", 2), ("a", 3)], "query_id string, node bigint"), InsertionConfig(threshold=1.0))
    assert rows(based.log, "node", "role") == [(2, "superclass")]
    grown, classes, links = enrich.enrich_manual(t, q, None, InsertionConfig(threshold=1.0), update=True)
    assert classes == 2 and links == 2 and set(dict(rows(grown.nodes, "label", "id"))) >= {"blue wool sock", "moon"}
    assert {(r["src"], r["tgt"]) for r in t.edges.collect()} <= {(r["src"], r["tgt"]) for r in grown.edges.collect()}


def test_tolerance(spark):
    t = make(spark, [(1, 0), (2, 1), (3, 2)], {0: "Root Concept", 1: "zzz", 2: "sock", 3: "deep"})
    q = spark.createDataFrame([("a", "blue sock")], "query_id string, label string")
    at = lambda n: {r["node"] for r in enrich.place(t, q, None, InsertionConfig(threshold=1.0, tolerance=n)).log.where("role = 'superclass'").collect()}
    assert at(0) == {0} and at(1) == {2}


def test_seeds(spark):
    t = make(spark, [(1, 0), (2, 1), (3, 1), (4, 1)], {0: "Root Concept", 1: "sock", 2: "red wool sock", 3: "blue wool sock", 4: "cap"})
    v = spark.createDataFrame([(2, [1.0, 0.1]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "id bigint, embedding array<float>")
    grown, classes, links = enrich.enrich_auto(t, v, models.common_words, InsertionConfig(retrieve_size=2, threshold=1.0))
    names = dict(rows(grown.nodes, "label", "id"))
    assert classes == 1 and "sock wool" in names
    assert {(2, names["sock wool"]), (3, names["sock wool"]), (names["sock wool"], 1)} <= set(rows(grown.edges, "src", "tgt"))


def test_moves(spark):
    t = make(spark, [(1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (6, 1)], {0: "Root Concept", 1: "sock", 2: "hat", 3: "straw hat", 4: "felt hat", 5: "sun hat", 6: "wool sock"})
    cfg = MoveConfig(selection_features=("parent",), weights=(1.0,), always_search_to_bottom=True)
    plan = move.predict_moves(t, spark.createDataFrame([(3,), (6,), (0,), (77,)], "id bigint"), None, cfg)
    got = {r["target"]: (list(r["new_parents"]), r["moved"]) for r in plan.collect()}
    assert got == {3: ([2], True), 6: ([1], False)}
    after, kept, moved = move.apply_moves(t, plan)
    assert (kept, moved) == (1, 1) and (3, 2) in rows(after.edges, "src", "tgt") and (3, 1) not in rows(after.edges, "src", "tgt")
    v = spark.createDataFrame([(i, [float(i in (1, 6)), float(i in (2, 3, 4, 5))]) for i in range(1, 7)], "id bigint, embedding array<float>")
    rag = move.predict_moves(t, spark.createDataFrame([(3,)], "id bigint"), v, MoveConfig(method="rag"))
    assert [list(r["new_parents"]) for r in rag.collect()] in ([[1]], [[2]])


def test_config():
    c = from_dict(InsertionConfig, {"sub_config": {"search": {"threshold": 0.8}}, "unknown": 1, "ignore_label": ["a"]})
    assert c.threshold == 0.8 and c.ignore_label == ("a",)
    assert update(c, tolerance=2).tolerance == 2
    try:
        update(c, nonsense=1)
        raise AssertionError
    except KeyError:
        pass


@pytest.mark.filterwarnings("error")
def test_settings_by_their_public_names(tmp_path):
    path = tmp_path / "settings.yml"
    path.write_text(
        "mode: manual\nrand_seed: 1\ntransitive_reduction: false\nlogging: [system, insert]\nauto_config: {max_outer_loop: 3}\nsemiauto_config: {semiauto_seeds: [4, sock]}\n"
        "manual_config: {input_concepts: [blue sock], manual_concept_bases: [[2, 3]], auto_bases: true}\nret_config: {retrieve_size: 5, restrict_combinations: false}\n"
        "gen_config: {ignore_label: [x], filter_subset: false}\nsub_config:\n  subgraph: {subgraph_crop: false, subgraph_force: [[a, b]], subgraph_strict: false}\n"
        "  search: {threshold: 0.7, tolerance: 2, force_base_subsumptions: true, force_prune: true}\nupdate_config: {do_update: false, do_lexical_check: false}\n"
    )
    c, d = from_yaml(InsertionConfig, str(path)), InsertionConfig()
    changed = {f.name for f in dataclasses.fields(c) if getattr(c, f.name) != getattr(d, f.name)}
    assert changed == {f.name for f in dataclasses.fields(c)} - {"batch_size", "eqv_score_func"}
    assert c.subgraph_force == (("a", "b"),) and c.logging == ("system", "insert") and c.manual_concept_bases == ((2, 3),)
    m = from_dict(MoveConfig, {"ret_config": {"ret_ignore": re.compile("Old")}, "gen_config": {"do_generate": True}, "sub_config": {"subgraph": {"sub_ignore": [3, 4]}}, "auto_config": {"ignore": "Test"}})
    assert m.ret_ignore == "Old" and m.do_generate and m.sub_ignore == (3, 4) and m.ignore == "Test"
    with pytest.warns(UserWarning, match="nonsense"):
        from_dict(InsertionConfig, {"nonsense": 1})


def _embed(label):
    """Two coordinates: sock and hat."""
    return F.array(*[(F.lower(label).contains(w)).cast("float") + F.lit(0.01).cast("float") for w in ("sock", "hat")])


def test_insertion_runs(spark, capsys):
    labels = {0: "Root Concept", 1: "sock", 2: "red wool sock", 3: "blue wool sock", 4: "cap", 5: "hat"}
    t = make(spark, [(1, 0), (2, 1), (3, 1), (4, 0), (5, 0)], labels)
    full = pipelines.Models(_embed, models.common_words, models.word_scorer)
    for mode, lacking in (("auto", dataclasses.replace(full, generator=None)), ("semiauto", dataclasses.replace(full, scorer=None)), ("manual", pipelines.Models(_embed)), ("auto", dataclasses.replace(full, embedder=None))):
        with pytest.raises(pipelines.MissingModel):
            pipelines.run_insertion(t, lacking, mode=mode, input_concepts=("x",), semiauto_seeds=(2,))
    with pytest.raises(pipelines.MissingModel, match="auto_bases"):
        pipelines.run_insertion(t, pipelines.Models(scorer=models.word_scorer), mode="manual", input_concepts=("x",), auto_bases=True)
    for wrong in ({"mode": "manual"}, {"mode": "semiauto"}, {"mode": "other"}, {"mode": "manual", "input_concepts": ("a",), "manual_concept_bases": ((1,), (2,))}):
        with pytest.raises(ValueError):
            pipelines.run_insertion(t, full, **wrong)
    auto = pipelines.run_insertion(t, full, retrieve_size=2, threshold=1.0)
    assert "sock wool" in dict(rows(auto.taxonomy.nodes, "label", "id")) and auto.counts["classes"] == 1
    assert "Added 1 new classes" in capsys.readouterr().out
    seeds = pipelines.run_insertion(t, full, mode="semiauto", semiauto_seeds=("red wool sock", 5), retrieve_size=3, threshold=1.0, do_update=False, logging=0)
    assert seeds.taxonomy is None and column(seeds.log, "label")[0] == "sock wool" and capsys.readouterr().out == ""
    manual = pipelines.run_insertion(t, full, mode="manual", input_concepts=("green wool sock", "straw hat"), manual_concept_bases=((2, "blue wool sock"), ()), threshold=1.0, logging=("inner_loop",))
    names = dict(rows(manual.taxonomy.nodes, "label", "id"))
    assert (names["green wool sock"], 1) in rows(manual.taxonomy.edges, "src", "tgt") and (names["straw hat"], 5) in rows(manual.taxonomy.edges, "src", "tgt")
    assert "superclass: " in capsys.readouterr().out
    based = pipelines.run_insertion(t, full, mode="manual", input_concepts=("green wool sock",), auto_bases=True, retrieve_size=3, threshold=1.0, do_update=False, logging=False)
    assert rows(based.log, "node", "role") == [(1, "superclass")]
    kept = pipelines.run_insertion(t, full, mode="manual", input_concepts=("wool sock",), manual_concept_bases=((2, 3),), threshold=1.0, transitive_reduction=False)
    assert {(2, 1), (3, 1)} <= set(rows(kept.taxonomy.edges, "src", "tgt"))


def test_move_runs(spark):
    t = make(spark, [(1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (6, 1)], {0: "Root Concept", 1: "sock", 2: "hat", 3: "straw hat", 4: "felt hat", 5: "sun hat", 6: "wool sock"})
    full = pipelines.Models(_embed, lambda labels: F.element_at(labels, 1), models.word_scorer)
    run = pipelines.run_moves(t, full, mode="manual", input_concepts=(3, 6, 77), logging=0)
    assert run.counts == {"kept": 1, "moved": 1} and (3, 2) in rows(run.taxonomy.edges, "src", "tgt")
    plan = pipelines.run_moves(t, full, do_update=False, logging=0, ignore=(3,))
    assert plan.taxonomy is None and column(plan.log, "target") == [4, 5, 6]
    assert column(pipelines.run_moves(t, full, do_update=False, logging=0, ignore="wool").log, "target") == [3, 4, 5]
    shut = pipelines.run_moves(t, full, mode="manual", input_concepts=(3,), sub_ignore=(2,), always_include_old=False, do_update=False, logging=0)
    assert [list(r["new_parents"]) for r in shut.log.collect()] == [[1]]
    rag = pipelines.run_moves(t, full, method="rag", do_generate=True, retrieve_size=1, always_include_old=False, mode="manual", input_concepts=(3,), do_update=False, logging=0)
    assert [list(r["new_parents"]) for r in rag.log.collect()] == [[2]]
    other = pipelines.run_moves(t, full, method="rag", do_generate=True, retrieve_size=1, always_include_old=False, ret_ignore=(2,), mode="manual", input_concepts=(3,), do_update=False, logging=0)
    assert [list(r["new_parents"]) for r in other.log.collect()] != [[2]]
    for lacking, wrong in ((pipelines.Models(_embed), {}), (pipelines.Models(scorer=models.word_scorer), {"method": "rag"}), (dataclasses.replace(full, generator=None), {"method": "rag", "do_generate": True})):
        with pytest.raises(pipelines.MissingModel):
            pipelines.run_moves(t, lacking, **wrong)
    for wrong in ({"mode": "manual"}, {"mode": "x"}, {"method": "x"}, {"threshold": 2.0}):
        with pytest.raises(ValueError):
            pipelines.run_moves(t, full, **wrong)


def test_entities_and_index_cache(spark):
    t = make(spark, [(1, 0), (2, 1)], {0: "Root Concept", 1: "sock", 2: "hat"})
    v = spark.createDataFrame([(1, [3.0, 4.0])], "id bigint, embedding array<double>")
    e = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("c", None, "sock")], "query_id string, id bigint, text string")
    got = {r["query_id"]: r["embedding"] for r in vec.entity_unit_vectors(e, v, t.nodes, _embed).collect()}
    assert np.allclose(got["a"], [0.6, 0.8]) and got["b"][1] > 0.99 and got["c"][0] > 0.99
    with pytest.raises(ValueError):
        vec.entity_unit_vectors(spark.createDataFrame([("d", 77, None)], e.schema), v, t.nodes, _embed)
    cache = pipelines.IndexCache(_embed)
    first = cache.store(t)
    assert first.ntotal == 3 and cache.store(t) is first
    assert cache.store(t.set_labels(spark.createDataFrame([(1, "boot")], "id bigint, label string"))) is first
    assert cache.store(t.add_nodes(spark.createDataFrame([(9, "cap")], "id bigint, label string"))[0]) is not first
    cache.clear(t)
    cache.clear()


def test_many_queries_and_uneven_stores(spark, monkeypatch):
    rng = np.random.default_rng(22)
    m = rng.standard_normal((300, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id bigint, embedding array<double>")
    q = v.select(F.col("id").alias("query_id"), "embedding")
    want = {m_: rows(vec.top_k(q, v, 5, m_), "query_id", "rank", "id") for m_ in ("ip", "l2")}
    monkeypatch.setattr(vec, "BLOCK_NUMBERS", 80)
    monkeypatch.setattr(vec, "SLICE", 70)
    assert {m_: rows(vec.top_k(q, v, 5, m_), "query_id", "rank", "id") for m_ in ("ip", "l2")} == want
    odd = v.unionByName(spark.createDataFrame([(900, [1.0]), (901, None), (902, [float("nan")] * 8)], "id bigint, embedding array<double>"))
    store = vec.VectorStore(odd).train_cells(sample_rows=200)
    assert len(store.centroids) <= 20
    found = store.search(q, 5, nprobe=len(store.centroids))
    assert rows(found, "query_id", "rank", "id") == want["ip"]
    assert vec.VectorStore(v.limit(0)).train_cells().search(q, 5, nprobe=1).count() == 0


def test_scores_are_asked_once(spark):
    cache = models.ScoreCache(spark, models.word_scorer)
    pairs = spark.createDataFrame([("red sock", "sock"), ("red sock", "sock"), (None, "sock")], "sub string, sup string")
    assert rows(cache.of(pairs).fillna("-"), "sub", "p") == [("-", 0.0), ("red sock", 1.0)]
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        calls.add(len(a))
        return pd.Series([0.5] * len(a))

    cache = models.ScoreCache(spark, lambda a, b: counted(a, b))
    for _ in range(12):
        assert cache.of(pairs).count() == 2
    assert calls.value == 2
    assert cache.of(pairs.unionByName(spark.createDataFrame([("x", "y")], "sub string, sup string"))).count() == 3 and calls.value == 3


def test_one_branch_of_nearly_all(spark):
    """Nothing is lost where nearly every draw would fall into the query's own branch."""
    edges = [(1, 0), (2, 0)] + [(i, 1) for i in range(10, 400)] + [(i, 2) for i in range(1000, 1004)]
    t = make(spark, edges)
    asked = spark.createDataFrame([(i,) for i in range(10, 60)], "id bigint")
    neg = rows(traindata.negatives(t, asked, 5), "query", "negative")
    per = {}
    for q, x in neg:
        per.setdefault(q, set()).add(x)
    assert set(per) == set(range(10, 60)) and all(len(v) == 5 and v <= {1, 2, *range(1000, 1004)} for v in per.values())
    # six nodes is all there is
    assert traindata.negatives(t, asked.limit(1), 50).count() == 6
    trip = traindata.contrastive_triples(t, n_negatives=2)
    assert trip.count() == traindata.cluster_pairs(t.edges, 2).count()
    # a chain: nearly all that is near a superclass are ancestors
    chain = make(spark, [(i + 1, i) for i in range(30)] + [(99, 30)])
    pos = traindata.subsumption_positives(chain)
    anc = {(r["node"], r["anc"]) for r in chain.closure().collect()}
    for found in (traindata.easy_negatives(chain, pos, 3), traindata.hard_negatives(chain, pos, 1)):
        assert not set(rows(found, "sub", "sup")) & anc
    n = {r["sub"]: r["count"] for r in traindata.easy_negatives(chain, pos, 3).groupBy("sub").count().collect()}
    own = {r["sub"]: r["count"] for r in pos.groupBy("sub").count().collect()}
    assert all(n.get(s, 0) == own[s] * min(3, 32 - 1 - sum(a == s for a, _ in anc)) for s in own)
    hard = {r["sub"]: r["count"] for r in traindata.hard_negatives(chain, pos, 1).groupBy("sub").count().collect()}
    assert hard == own


def test_edit_stream(spark, tmp_path):
    from taxograft.streaming import edit_log

    schema = edit_log.EDIT_SCHEMA
    inbox = str(tmp_path / "in")
    first = [(1, "add_node", 1, None, None, "A"), (2, "add_node", 2, None, None, "B"), (3, "add_edge", None, 2, 1, "original"), (4, "add_edge", None, 1, 2, "original"), (5, "set_label", 1, None, None, "A2")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(inbox)
    run = edit_log.follow(spark, spark.readStream.schema(schema).parquet(inbox), str(tmp_path / "t"), str(tmp_path / "c"))
    run.awaitTermination(120)
    t = edit_log.current(spark, str(tmp_path / "t"), 1)
    assert dict(rows(t.nodes, "id", "label")) == {1: "A2", 2: "B"} and t.edges.count() == 0
    assert rows(edit_log.current(spark, str(tmp_path / "t")).nodes, "id", "label") == rows(t.nodes, "id", "label")


def test_edits_go_by_their_order(spark):
    from taxograft.streaming import edit_log

    t = make(spark, [(2, 1), (3, 2)])
    batch = [(1, "add_edge", None, 4, 2, "new"), (2, "remove_node", 2, None, None, None), (3, "add_node", 5, None, None, "E"), (4, "remove_node", 3, None, None, None), (5, "add_node", 3, None, None, "again"), (6, "add_edge", None, 3, 1, "new")]
    after = edit_log.apply_batch(t, spark.createDataFrame(batch, edit_log.EDIT_SCHEMA))
    assert rows(after.edges, "src", "tgt") == [(3, 1)] and column(after.nodes, "id") == [1, 3, 5]


TURTLE = """@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . PREFIX ex: <http://x.example/t#>
@base <http://x.example/t> .
# a comment with a . and ;
ex:1 a <http://www.w3.org/2002/07/owl#Class> ; rdfs:label "Sock \\"S\\" \\u00e9"@en, '''long
one''' ; rdfs:subClassOf <http://www.w3.org/2002/07/owl#Thing> , [ a ex:r ; ex:on ( ex:1 2.5 true ) ] ; .
<#2> rdfs:subClassOf ex:1; rdfs:label "Wool sock"^^ex:string .
_:b rdfs:subClassOf ex:1 .
"""


def test_rdf_sources(spark, tmp_path):
    from taxograft.sources import rdf, taxonomies

    got = rdf.turtle(TURTLE)
    label, sub = "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2000/01/rdf-schema#subClassOf"
    assert {o for _, p, o, _ in got if p == label} == {'Sock "S" é', "long\none", "Wool sock"}
    assert ("http://x.example/t#2", sub, "http://x.example/t#1", False) in got and sum(p.endswith("#first") for _, p, _, _ in got) == 3
    with pytest.raises(rdf.TurtleError):
        rdf.turtle("ex:1 a ex:2 .")
    (tmp_path / "a.ttl").write_text(TURTLE)
    nt = "# comment\n\n<http://x#1> <%s> <http://www.w3.org/2002/07/owl#Thing> .\n<http://x#2> <%s> <http://x#1> . # x\n<http://x#2> <%s> \"Wool \\\"sock\\\" \\u00e9\"@en .\n_:b <%s> <http://x#1> .\n" % (sub, sub, label, sub)
    (tmp_path / "b.nt").write_text(nt)
    xml = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="http://x">
      <owl:Class rdf:ID="1"><rdfs:subClassOf rdf:resource="http://www.w3.org/2002/07/owl#Thing"/></owl:Class>
      <rdf:Description rdf:about="http://x#2" rdfs:label="Wool &amp; sock"><rdfs:subClassOf><owl:Class rdf:about="#1"/></rdfs:subClassOf></rdf:Description>
      <owl:Class rdf:about="#2"><rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf></owl:Class></rdf:RDF>"""
    (tmp_path / "c.owl").write_text(xml)
    names = {"a.ttl": 'Sock "S" é', "b.nt": "1", "c.owl": "1"}
    for name, first in names.items():
        t = taxonomies.from_owl(spark, str(tmp_path / name))
        assert rows(t.edges, "src", "tgt") == [(1, 0), (2, 1)] and dict(rows(t.nodes, "id", "label"))[1] == first
    assert dict(rows(taxonomies.from_owl(spark, str(tmp_path / "b.nt")).nodes, "id", "label"))[2] == 'Wool "sock" é'
    (tmp_path / "d.nt").write_text("this is no triple\n")
    with pytest.raises(Exception, match="no triple"):
        rdf.triples(spark, str(tmp_path / "d.nt")).collect()

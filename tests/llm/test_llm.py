"""The training-data operators against brute force, round trips and small cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxograft.llm import bpe, leaks, neighbours, overlap, same_name, splits, stuffed
from taxograft.llm.components import components
from tests.helpers import rows

VOCABULARY = bpe.DEFAULT_VOCABULARY


# -- neighbours


def _brute(ids, m, k, least):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if s[i, j] >= least}
    return out


def test_similar_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 64))
    m = np.vstack([c + 0.2 * rng.standard_normal((rng.integers(1, 20), 64)) for c in centres])
    ids = list(range(100, 100 + len(m)))
    data = [(i, [float(x) for x in v]) for i, v in zip(ids, m)]
    odd = [(1, None), (2, [1.0] * 10), (3, [0.0] * 64), (4, [float("nan")] + [1.0] * 63), data[0], data[5]]
    df = spark.createDataFrame([(i, v, "clash") for i, v in data + odd], "id long, embedding array<double>, cls string")
    found = set(rows(neighbours.similar_pairs(df), "a", "b"))
    want = _brute(ids, m, 10, 0.9)
    assert len(found & want) >= 0.97 * len(want) and not found - want
    assert neighbours.similar_pairs(df.limit(0)).count() == 0


def test_copies_of_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal(64)
    data = [(i, [float(x) * (1 + i % 3) for x in v]) for i in range(300)] + [(1000 + i, [float(x) for x in rng.standard_normal(64)]) for i in range(300)]
    found = rows(neighbours.similar_pairs(spark.createDataFrame(data, "id long, embedding array<double>")), "a", "b")
    want = {(min(i, j), max(i, j)) for i in range(300) for j in [x for x in range(11) if x != i][:10]}
    assert set(found) == want


def test_copies_at_float32_lengths(spark):
    rng = np.random.default_rng(11)
    v = rng.standard_normal(64).astype(np.float32)
    data = [(i, [float(x) for x in v * np.float32(f)]) for i, f in enumerate(rng.uniform(0.1, 10, 1000))] + [(5000 + i, [float(x) for x in rng.standard_normal(64)]) for i in range(200)]
    df = spark.createDataFrame(data, "id long, embedding array<float>")
    reps, members = neighbours.copy_classes(neighbours.unit_vectors(df))
    assert sorted(r["cls"] for r in reps.collect()) == [0, *range(5000, 5200)]
    assert members.where("cls = 0").count() == 1000
    want = {(min(i, j), max(i, j)) for i in range(1000) for j in [x for x in range(11) if x != i][:10]}
    assert set(rows(neighbours.similar_pairs(df), "a", "b")) == want


@pytest.mark.parametrize("noise", [0.001, 0.03])
def test_a_third_near_one_vector(spark, noise):
    rng = np.random.default_rng(12)
    m = rng.standard_normal((12_000, 64))
    m[::3] = m[0] + noise * np.linalg.norm(m[0]) / 8 * rng.standard_normal((4_000, 64))
    m = m.astype(np.float32).astype(np.float64)
    found = set(rows(neighbours.similar_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>")), "a", "b"))
    u = m[::3] / np.linalg.norm(m[::3], axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    near = np.argsort(-s, axis=1, kind="stable")[:, :10]
    want = {(3 * min(i, j), 3 * max(i, j)) for i, js in enumerate(near.tolist()) for j in js}
    assert len(found & want) >= 0.98 * len(want) and len(found & want) >= 0.98 * len(found)


def test_prefix_lengths_and_partitions(spark):
    rng = np.random.default_rng(20)
    centres = rng.standard_normal((300, 64))
    m = np.vstack([c + 0.25 * rng.standard_normal((rng.integers(1, 40), 64)) for c in centres])
    units = neighbours.unit_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>"))
    reps = units.select(F.col("id").alias("cls"), "unit").persist()
    trees, floor, bucket = 6, 2, 16
    got = dict(rows(neighbours.prefix_lengths(reps, trees, floor, bucket)))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sharers = np.zeros((len(m), neighbours.ABOVE + neighbours.BELOW + 1), np.int64)
    for t in range(trees):
        bits = (u.astype(np.float32) @ neighbours._planes(t, 64) > 0).astype(np.int64)
        for k in range(sharers.shape[1]):
            prefix = bits[:, : floor + k] @ (1 << np.arange(floor + k))
            _, at, n = np.unique(prefix, return_inverse=True, return_counts=True)
            sharers[:, k] += n[at] - 1
    want = {i: floor + max([0, *np.nonzero(sharers[i] >= trees * bucket)[0].tolist()]) for i in range(len(m))}
    assert got == want and len(set(got.values())) > 3
    # rows do not depend on the number of partitions
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("2", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows(neighbours.forest_pairs(reps, 0.9, 16), "x", "y"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    assert neighbours.forest_size(150_000, 0.9)[0] < neighbours.forest_size(1_500_000, 0.9)[0] < 60


# -- names, groups, splits


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(300, i) for i in range(301, 420)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "a long, b long")
    assert dict(rows(components(df))) == {x: find(x) for x in up}
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("n_words", [*range(1, 21), 60])
def test_signatures_are_complete(n_words):
    rnd = random.Random(n_words)
    letters = "abcdefghij"
    for trial in range(300):
        sizes = (3, 8) if trial % 3 else (1, 30)
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(*sizes))) for _ in range(n_words)]
        name, wrong = " ".join(sorted(words)), list(words)
        for _ in range(2):
            i = rnd.randrange(len(wrong))
            w, at = wrong[i], rnd.randrange(len(wrong[i]))
            wrong[i] = rnd.choice([w[:at] + w[at + 1 :] if len(w) > 1 else w, w[:at] + rnd.choice(letters) + w[at:], w[:at] + rnd.choice(letters) + w[at + 1 :]])
        assert set(same_name.signatures(name, False)) & set(same_name.signatures(" ".join(sorted(wrong)), True)), (name, wrong)


def test_reference_signatures():
    rnd = random.Random(23)
    names = [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 25))) for _ in range(n)) for n in [*range(1, 16)] * 3]
    at, codes = same_name.reference_signatures(names)
    for i, name in enumerate(names):
        want = set(same_name.signatures(name, False)) | ({same_name._whole(name)} if name.count(" ") < same_name.MAX_WORDS else set())
        assert set(codes[at == i].tolist()) == want
    assert len(same_name.reference_signatures([])[0]) == 0


def test_no_signature_is_shared_by_many():
    rnd = random.Random(18)
    seen = {}
    names = {"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(100_000)}
    for n, name in enumerate(sorted(names)[:20_000]):
        for s in same_name.signatures(name, False):
            seen[s] = seen.get(s, 0) + 1
        if n % 4 == 0:
            for s in same_name.signatures(f"shoes {name}", False):
                seen[s] = seen.get(s, 0) + 1
    assert max(seen.values()) < 20


def test_one_word_names(spark):
    rnd = random.Random(19)
    names = sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(9, 12))) for _ in range(10_000)})
    wrong = {n[:4] + "zq" + n[6:]: n for n in names[:100] if n[4:6] != "zq"}
    df = spark.createDataFrame([(x, 1) for x in [*names, *wrong]], "canon string, n long")
    got = dict(rows(same_name.aliases(df, df.select("canon").limit(0))))
    assert all(got[w] == got[n] for w, n in wrong.items()) and len(got) < 300


def test_aliases(spark):
    known = spark.createDataFrame([("alpha beta chairs golf",), ("gamma delta chairs golf",), ("12 frames omega sigma",), ("7 frames omega sigma",)], "canon string")
    foreign = spark.createDataFrame([("alpha beta chars golf", 1), ("alpha betta chairs gof", 1), ("all products", 50), ("al products", 1), ("quite other thing", 1), ("quite othr thing", 1)], "canon string, n long")
    got = dict(rows(same_name.aliases(foreign, known)))
    assert got["alpha beta chars golf"] == got["alpha betta chairs gof"] == got["alpha beta chairs golf"]
    assert got["al products"] == got["all products"] and got["quite othr thing"] == got["quite other thing"]
    assert "gamma delta chairs golf" not in got and "7 frames omega sigma" not in got
    assert same_name.aliases(foreign.limit(0), known).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_links_do_not_depend_on_counts(spark, n):
    known = spark.createDataFrame([("alpha beta chairs golf",)], "canon string")
    foreign = spark.createDataFrame([("alpha beta chaixz golf", n), ("alpha beta chyqxz golf", 1), ("alphabeta chairs golf", 1), ("al beta chairs golf pha", 1), ("alpha betaxchairs golf", 1)], "canon string, n long")
    got = dict(rows(same_name.aliases(foreign, known)))
    assert len(got) == 6 and set(got.values()) == {"alpha beta chairs golf"}


def test_record_groups(spark):
    cats = spark.createDataFrame([(5, "Red Wool Hat"), (3, "Blue Silk Tie"), (9, "Old Oak Desk"), (9, "old oak desk"), (7, "Raw Iron Nail")], "cat_id long, label string")
    sib = spark.createDataFrame([(1, 5), (1, 3), (2, 3), (2, 9), (4, 7), (None, 7), (5, None)], "cluster_id long, cat_id long")
    sub = spark.createDataFrame([(1, "wool hat, red"), (1, "wool hat, red"), (2, "Blue Slk Tye"), (3, None), (4, "Unknown Name Here"), (5, "Raw Iron Nail"), (6, "--")], "row_id long, subclass string")
    emb = spark.createDataFrame([(1, "Old Oak Desk (33)")], "row_id long, query_label string")
    got = rows(splits.record_groups(sub, emb, sib, cats), "rec_table", "rec_id", "group_id")
    assert got == [("emb_triples", 1, 3), ("siblings_data", 1, 3), ("siblings_data", 2, 3), ("siblings_data", 4, 7), ("sub_pairs", 1, 3), ("sub_pairs", 2, 3), ("sub_pairs", 5, 7)]
    share = dict(rows(spark.range(20_000).select(splits.split_of(F.col("id")).alias("s")).groupBy("s").count()))
    assert abs(share["train"] / 20_000 - 0.8) < 0.02 and abs(share["test"] / 20_000 - 0.1) < 0.01
    assert splits.record_groups(sub.limit(0), emb.limit(0), sib.limit(0), cats).count() == 0


def test_overlap(spark):
    cats = spark.createDataFrame([(1, "Red Wool Hat"), (2, "Blue Silk Tie")], "cat_id long, label string")
    pairs = [(1, "Red Wool Hat", "All Products", "train", "s"), (2, "red wool hat.", "ALL PRODUCTS", "eval", "s"), (2, "red wool hat.", "ALL PRODUCTS", "eval", "s"), (3, "Red Wol Hat", "All Prodcts", "test", "t"), (4, None, "x", "test", "t"), (5, "Red Wool Hat", "Blue Silk Tie", "test", "t"), (6, "Red Wool Hat", "All Products", None, "t")]
    sub = spark.createDataFrame(pairs, "row_id long, subclass string, superclass string, split string, source string")
    emb = spark.createDataFrame([(8, "Red Wool Hat", "Blue Silk Tie", "train", "s"), (7, "RED WOOL HAT", "Tie, Blue Silk", "eval", "s")], "row_id long, query_label string, positive_label string, split string, source string")
    gen = spark.createDataFrame(
        [(1, 'summarize: Red Wool Hat[SEP]"Blue Silk Tie"', "Root", "train", "s"), (2, "Blue Silk Tie | Red Wool Hat", "root", "test", "s"), (3, "Red Wool Hat", "root", "test", "s"), (4, "", "root", "test", "s"), (5, None, "root", "test", "s")],
        "row_id long, text string, summary string, split string, source string",
    )
    h = overlap.content_hashes(sub, emb, gen, cats)
    assert rows(overlap.cross_split_pairs(h), "rec_table", "id_a", "id_b") == [("emb_triples", 7, 8), ("gen_prompts", 1, 2), ("sub_pairs", 1, 2), ("sub_pairs", 1, 3)]
    rep = {(r["rec_table"], r["split"], r["source"]): (r["n_rows"], r["n_overlapping"], r["n_pairs"]) for r in overlap.overlap_report(h).collect()}
    assert rep[("sub_pairs", "eval", "s")] == (1, 1, 1) and rep[("sub_pairs", "test", "t")] == (2, 1, 1)
    assert overlap.cross_split_pairs(overlap.content_hashes(sub.limit(0), emb.limit(0), gen.limit(0), cats.limit(0))).count() == 0


# -- tokens


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    ref.encode_special_tokens = True
    rnd = random.Random(7)
    texts = ["", "Hello world", "<|endoftext|> is text", "don't we'll", "日本語 ünïcödé 🙂🙂", "a" * 3000, " " * 500 + "x", "\t\n \r\n", "x=1;y=[i**2]"]
    texts += ["".join(rnd.choice("abcdehilnorst  .,é0") for _ in range(rnd.randint(1, 80))) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df, VOCABULARY).collect()}
    want = [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want and got[len(texts)] == []
    assert bpe.encode_corpus(df.limit(0), VOCABULARY).count() == 0


# -- leaks

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki") for b in ("lor", "min", "nat", "pus", "rix", "sol", "tum")]


def _leak_case(seed):
    rnd = random.Random(seed)
    text = lambda n: [rnd.choice(WORDS) for _ in range(n)]
    items = {i: text(rnd.randint(34, 60)) for i in range(40)}
    docs, want = [], set()
    for d in range(400):
        body, item = text(rnd.randint(60, 300)), rnd.randrange(40)
        ws, kind = items[item], d % 8
        if kind in (0, 1, 2):
            part = ws if kind == 0 else ws[: len(ws) // 2 + 4] if kind == 1 else ws[len(ws) // 3 :]
            part = [rnd.choice(WORDS) if rnd.random() < 1 / 8 and kind else w for w in part]
            cut = len(part) // 2
            furniture = ["home", "login", "contact"] if kind == 2 else []
            body = body[:20] + part[:cut] + furniture + part[cut:] + body[20:]
            want.add((d, item))
        elif kind == 3:
            body = body[:20] + ws[5:13] + body[20:]
        elif kind == 4:
            chunks = [ws[i : i + 3] for i in range(0, len(ws), 3)]
            rnd.shuffle(chunks)
            body = body[:20] + [w for c in chunks for w in c] + body[20:]
        docs.append((d, " ".join(w.title() if rnd.random() < 0.2 else w for w in body)))
    return docs, items, want


def test_leaked_items(spark):
    docs, items, want = _leak_case(8)
    d = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "  ")], "doc_id long, text string").repartition(3)
    i = spark.createDataFrame([(k, " ".join(v), "s") for k, v in items.items()] + [(99, None, "s"), (98, "", "s")], "item_id long, text string, suite string")
    found = set(rows(leaks.leaked_items(d, i), "doc_id", "item_id"))
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 2
    assert leaks.leaked_items(d, i.limit(0)).count() == 0 and leaks.leaked_items(d.limit(0), i).count() == 0


@pytest.mark.parametrize("outside", [False, True])
def test_one_word_in_seven_replaced(spark, outside):
    rnd = random.Random(13)
    vocabulary, filler = [a + b for a in WORDS for b in WORDS[:20]], [f"x{w}{n}" for w in WORDS for n in "abcdefghij"]
    items = {i: [rnd.choice(vocabulary) for _ in range(rnd.randint(40, 60))] for i in range(100)}
    docs = []
    for i, ws in items.items():
        part = [rnd.choice(filler if outside else vocabulary) if n % 7 == 3 else w for n, w in enumerate(ws[: (3 * len(ws)) // 5])]
        docs.append((i, " ".join([rnd.choice(filler) for _ in range(80)] + part + [rnd.choice(filler) for _ in range(80)])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    found = set(rows(leaks.leaked_items(d, i), "doc_id", "item_id"))
    assert len(found & {(k, k) for k in items}) >= 98 and len(found) <= 100


def test_items_repeated_under_other_ids(spark):
    rnd = random.Random(14)
    ws = [rnd.choice(WORDS) for _ in range(45)]
    variant = [*ws[:20], "changed", *ws[21:]]
    items = [(1, ws), (2, ws), (3, ws), (4, variant), (4, [*ws[:-1], "end"])]
    i = spark.createDataFrame([(k, " ".join(v)) for k, v in items], "item_id long, text string")
    d = spark.createDataFrame([(7, "some words before " + " ".join(ws) + " and after")], "doc_id long, text string")
    assert rows(leaks.leaked_items(d, i), "doc_id", "item_id") == [(7, 1), (7, 2), (7, 3), (7, 4)]


def test_hamming_index_is_complete():
    rng = np.random.default_rng(9)
    items = [(k, [f"w{rng.integers(500)}" for _ in range(40)]) for k in range(30)]
    index = leaks.ItemIndex(items, {}, 100)
    block = index.blocks[leaks.WINDOW]
    queries = block["prints"][rng.integers(len(block["prints"]), size=200)].copy()
    for n in range(200):
        for b in rng.choice(64, rng.integers(0, leaks.RADIUS + 1), replace=False):
            queries[n] ^= np.uint64(1) << np.uint64(b)
    q, f = index.hits(queries, leaks.WINDOW)
    dist = np.bitwise_count(queries[:, None] ^ block["prints"][None, :])
    assert set(zip(q.tolist(), f.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(dist <= leaks.RADIUS))))


def test_damaged_letters():
    assert leaks.words("Für „Müller“ – f?r") == leaks.words("FÃ¼r MÃ¼ller f�r") == ["fr", "mller", "fr"]
    assert leaks.words(None) == leaks.words(" ") == []
    assert leaks.words("Привет, МИР! naïve 日本語 abc") == ["привет", "мир", "nave", "日", "本", "語", "abc"]
    russian = "Новый пекарь хранит каждый остров"
    assert leaks.words(russian.encode().decode("cp1252", "replace").replace("\ufffd", "")) != [] and leaks.words(russian.encode().decode("latin-1")) == leaks.words(russian)
    assert leaks.words("مرحبا يا عالم") == ["مرحبا", "يا", "عالم"]


@pytest.mark.parametrize("letters", ["абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπρσ", "ابتثجحخدذرزسشصضطظع", "日本語東京大学生先社会人民国家山川水火木金土月風空海花"])
def test_leaks_in_every_script(spark, letters):
    rnd = random.Random(16)
    joined = "" if letters[0] == "日" else " "
    vocabulary = list(letters) if joined == "" else ["".join(rnd.choice(letters) for _ in range(6)) for _ in range(300)]
    items = {i: [rnd.choice(vocabulary) for _ in range(50)] for i in range(6)}
    docs = [(i, joined.join(ws[: 34 if i % 2 else 50])) for i, ws in items.items()]
    docs += [(10 + i, joined.join(ws[:7]) + " " + joined.join(rnd.sample(vocabulary, 17))) for i, ws in items.items()]
    found = leaks.leaked_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, joined.join(ws)) for i, ws in items.items()], "item_id long, text string")
    )
    assert rows(found, "doc_id", "item_id") == [(i, i) for i in items]


def test_shingle_similarity():
    rng = np.random.default_rng(17)
    item, weights = np.arange(40, dtype=np.int32), rng.integers(1, 50, 40).astype(np.int32)
    core = np.ones(40, bool)
    assert leaks.shingle_similarity(item, item, weights, core) == (1.0, 1.0, 40)
    parted = np.concatenate([item[:20], np.full(30, 99, np.int32), item[20:]])
    assert leaks.shingle_similarity(item, parted, np.ones(40, np.int32), core) == (1.0, 1.0, 40)
    turned = np.concatenate([item[20:], item[:20]])
    similarity, order, _ = leaks.shingle_similarity(item, turned, weights, core)
    assert similarity <= max(weights[:20].sum(), weights[20:].sum()) / weights.sum() and order < 0.8
    # blocks of rows change nothing
    repeated = np.concatenate([parted] * 3)
    whole, cells = leaks.shingle_similarity(item, repeated, weights, core), leaks.CELLS
    try:
        leaks.CELLS = 200
        assert leaks.shingle_similarity(item, repeated, weights, core) == whole
    finally:
        leaks.CELLS = cells


# -- stuffed pages

ARTICLE = "\n".join(f"The {a} man sees {b} houses near the river, because every day his wife walks there." for a in ("old", "young", "tall", "small", "wise") for b in ("two", "ten", "red"))
LIST = ", ".join(f"{n} {b}" for n in ("cheap lamp", "table", "chair", "old mirror") for b in ("buy", "sale", "online", "price", "best"))


def _verses(words):
    """Lines of six words without capitals or stops, no two alike."""
    rnd, words = random.Random(15), words.split()
    return "\n".join(" ".join(rnd.sample(words, 6)) for _ in range(18))


LINKS = "\n".join(f"lamp shop {i} https://shop{i}.example/lamp" for i in range(20))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, False),
        ("", False),
        ("  \n ", False),
        (ARTICLE, False),
        (LIST, True),
        (LINKS, True),
        ("\n".join(f"#lamp{w}" for w in ("buy", "sale", "best", "price", "shop", "top") * 3), True),
        (" ".join(f"Every old lamp here is a {w} old lamp." for w in ("cheap", "best", "top", "new", "sale", "free")), True),
        (ARTICLE + "\nTags: lamp, table, chair, mirror, house", False),
        ("Not found\nSorry, this page does not exist.\nlamp\ntable\nchair\nmirror\nhouse", False),
        ("\n".join(f"{100 + i} g {w}" for i, w in enumerate(("flour", "sugar", "salt", "milk", "yeast", "oil") * 2)) + "\n" + ARTICLE, False),
        ("\n".join(f"{h}:{10 + h}  Bern – Basel  {h} min" for h in range(5, 23)), False),
        ((LIST + "\n") * 400, True),
        ("lamp review\n" + " ".join(f"old lamp K{i}{i % 7}3 brass table T{i}9" for i in range(30)), True),
        ("lamp review\n" + ", ".join(f"old lamp K{i}{i % 7}3, brass table T{i}9" for i in range(30)), True),
        ("\n".join(f"lamp {w} ({7 * i})\ntable {w} ({i})" for i, w in enumerate(("buy", "sale", "best", "price", "shop", "top"), 11)), True),
        ("shoes,bags,watches," * 30, True),
        ("靴、鞄、時計、安い靴、" * 12, True),
        (" ".join(f"Every teapot here is a {w} teapot." for w in ("cheap", "best", "good", "new", "nice", "free")), True),
        (_verses("نجوم رياح بحار قمر زهور طيور جبال رمال غيوم ليل نهار شمس سماء وردة قلب روح عين حلم نور ظل صمت صوت"), False),
        (_verses("तारे नदी पवन सागर फूल पंछी बादल धूप छाया चाँद रात दिन सूरज आकाश मन दिल आँख सपना रोशनी मौन गीत वन"), False),
        (_verses("lamp river stone house wind night door hand road tree bird song light shade rain hill boat star fire snow leaf moon").title(), False),
        (ARTICLE + "\n" + ARTICLE.lower() + "\n" + LIST[:60], False),
    ],
)
def test_stuffed(text, want):
    assert stuffed.stuffed(text, set()) is want


def test_stuffed_pages(spark):
    menu = "Home\nNews\nContact us now\nWe use cookies to improve your visit.\n"
    docs = [(i, menu + ARTICLE.replace("man", f"man{i}")) for i in range(40)] + [(100 + i, menu + LIST.replace("lamp", f"lamp{i}")) for i in range(8)] + [(200, None), (201, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert stuffed.unit_hash("Home") in stuffed.furniture_units(df).first()["units"]
    assert rows(stuffed.stuffed_pages(df), "doc_id") == [(100 + i,) for i in range(8)]
    assert stuffed.stuffed_pages(df.limit(0)).count() == 0
    # copies of one page do not make its content furniture
    copies = spark.createDataFrame([(i, LIST) for i in range(50)], "doc_id long, text string")
    assert stuffed.stuffed_pages(copies).count() == 50


def test_mirrors_of_a_stuffed_page(spark):
    spam = "\n".join(LIST.replace("lamp", f"lamp{n}") for n in range(6))
    menu = "Home\nNews\nContact us now\n"
    docs = [(i, menu + spam + f"\nMirror of host{i}.example") for i in range(30)]
    docs += [(100 + i, menu + ARTICLE.replace("man", f"man{i}")) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert stuffed.unit_hash("Home") in stuffed.furniture_units(df).first()["units"]
    assert rows(stuffed.stuffed_pages(df), "doc_id") == [(i,) for i in range(30)]


def test_furniture_belongs_to_its_host(spark):
    notice = "We use cookies and a very long notice " * 8 + "on this page."
    docs = [(i, notice + "\nHome\n" + ARTICLE.replace("man", f"man{i}"), "a.example", 1) for i in range(30)]
    docs += [(100 + i, "Home\nkeyword lamp\n" + ARTICLE.replace("man", f"boy{i}"), f"small{i}.example", 2) for i in range(30)] + [(200, "Home", None, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, units int")
    found = stuffed.furniture_units(df).collect()
    assert len(found) == 1 and set(found[0]["units"]) >= {stuffed.unit_hash("Home"), stuffed.unit_hash(notice)}
    # the same pages are judged alike in a larger corpus of other hosts
    more = df.unionByName(df.where("source = 'a.example'").withColumn("source", F.lit("b.example")).withColumn("doc_id", F.col("doc_id") + 1000))
    hosts = stuffed.furniture_units(more).select(F.sort_array("units").alias("u")).collect()
    assert len(hosts) == 2 and hosts[0]["u"] == hosts[1]["u"] == sorted(found[0]["units"])
    assert stuffed.stuffed_pages(df).count() == 0

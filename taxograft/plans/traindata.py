"""Training tables from a taxonomy: contrastive triples, generation prompts, subsumption pairs.

Random choices are orders by md5 of the row's keys and a seed, so a result depends on nothing but its input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxograft.model import ROOT_ID, Taxonomy
from taxograft.operators.numbering import dense_numbers, ordered_numbers, sum_before
from taxograft.session import Scratch


def hashed(seed: object, *columns: str | Column) -> Column:
    """A reproducible pseudo-random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def child_clusters(edges: DataFrame) -> DataFrame:
    """(cluster_id, member): the children of each node that has more than one, a row each."""
    kids = edges.select(F.col("tgt").alias("cluster_id"), F.col("src").alias("member")).distinct()
    many = kids.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("cluster_id")
    return kids.join(many, "cluster_id", "left_semi")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """(cluster_id, n, first, last): the number of members of each cluster, the smallest and the largest."""
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("first"), F.max("member").alias("last"))


def num_pairs(n: Column, cover: int) -> Column:
    """How many pairs :func:`cluster_pairs` gives for a cluster of n."""
    ratio, rest = F.floor(F.lit(cover) / (n - 1)), F.lit(cover) % (n - 1)
    odd = F.when((rest % 2 != 0) & (n % 2 == 0), F.floor(n / 2)).otherwise(0)
    return (F.floor(ratio * n * (n - 1) / 2) + n * F.floor(rest / 2) + odd).cast("bigint")


def cluster_pairs(edges: DataFrame, cover: int = 2) -> DataFrame:
    """(cluster_id, i, j, a, b): positions and members of the pairs sampled from each child cluster.

    All pairs as often as ``cover`` holds n - 1, and of the remainder those at a circular distance of at most half of it (and for an odd remainder
    and even n the opposite ones). Partners are computed from the position, so a cluster of n gives n * cover / 2 rows and no
    pair that is not wanted is ever built.
    """
    kids = edges.select("tgt", "src").distinct()
    order = ordered_numbers(kids, "src", "tgt", name="i").withColumn("i", F.col("i").cast("int"))
    size = kids.groupBy("tgt").agg(F.count(F.lit(1)).cast("int").alias("n"))
    m = order.join(size, "tgt").where(F.col("n") > 1).select(F.col("tgt").alias("cluster_id"), "i", "n", F.col("src").alias("a"))
    ratio, rest = F.floor(F.lit(cover) / (F.col("n") - 1)).cast("int"), (F.lit(cover) % (F.col("n") - 1)).cast("int")
    empty = F.array().cast("array<int>")
    # full rounds: every later position; only where cover >= n - 1, so n is at most cover + 1
    later = F.when(F.col("i") + 1 < F.col("n"), F.sequence(F.col("i") + 1, F.col("n") - 1)).otherwise(empty)
    full = F.when(ratio > 0, F.flatten(F.array_repeat(later, ratio))).otherwise(empty)
    half = F.floor(rest / 2).cast("int")
    around = F.when(half > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), half), lambda d: F.pmod(F.col("i") + d, F.col("n"))))).otherwise(empty)
    opposite = F.when((rest % 2 != 0) & (F.col("n") % 2 == 0) & (F.col("i") < F.col("n") / 2), F.array((F.col("i") + F.floor(F.col("n") / 2)).cast("int"))).otherwise(empty)
    pairs = m.select("cluster_id", "i", F.explode(F.concat(full, around, opposite)).alias("j"), "a")
    b = m.select("cluster_id", F.col("i").alias("j"), F.col("a").alias("b"))
    p = pairs.join(b, ["cluster_id", "j"])
    flip = F.col("i") > F.col("j")
    return p.select("cluster_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(flip, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("b"))


def top_branches(taxonomy: Taxonomy) -> DataFrame:
    """(node, branch): the strict ancestors of each node that have no strict ancestor but the root concept; nodes right under it have none. Two
    nodes share a strict ancestor besides the root concept if and only if they share a branch."""
    up = taxonomy.closure().where(F.col("anc") != ROOT_ID).select("node", F.col("anc").alias("branch"))
    return up.join(up.select(F.col("node").alias("branch")).distinct(), "branch", "left_anti").select("node", "branch")


#: Steps between the places of one row's draws; a step that doesn't divide the number of places visits each of them once.
_STEPS = (1_000_003, 999_983)


def _place(seed: int, draw: Column, places: Column, *key: str) -> Column:
    """The place of a row's n-th draw: a start by hash, then steps round all places, so no place is drawn twice before all were."""
    start = F.conv(F.substring(hashed(seed, *key), 1, 12), 16, 10).cast("bigint")
    step = F.when(places % _STEPS[0] != 0, F.lit(_STEPS[0])).otherwise(F.lit(_STEPS[1]))
    return F.pmod(start + draw.cast("bigint") * step, places)


def _draw_until(scratch: Scratch, rows: DataFrame, keys: list[str], n: int, tries: int, fits: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keys, t, id): of each row (keys, places) the first ``n`` draws that fit, in order of the draws.

    ``fits`` takes (keys, places, t) and gives (keys, t, id) of the draws that fit. Most rows are served by the first ``n * tries`` draws; those
    short of ``n`` draw on, four times as often a round, until they are served or have drawn every place: nothing is lost.
    """
    rows = scratch.keep(rows.where(F.col("places") > 0).select(*keys, "places"))
    found: list[DataFrame] = []
    low, high, now = 0, n * tries, rows
    while True:
        draws = now.withColumn("t", F.explode(F.sequence(F.lit(low).cast("bigint"), F.least(F.lit(high).cast("bigint"), F.col("places")) - 1)))
        found.append(scratch.keep(fits(draws)))
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        have = every.groupBy(*keys).agg(F.countDistinct("id").alias("_n"))
        left = now.where(F.col("places") > high).join(have, keys, "left").where(F.coalesce("_n", F.lit(0)) < n).select(*keys, "places")
        left = scratch.keep(left)
        if left.isEmpty():
            break
        now, low, high = left, high, high * 4
    once = every.groupBy(*keys, "id").agg(F.min("t").alias("t"))
    return once.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("t"))).where(F.col("_r") <= n).drop("_r")


def negatives(taxonomy: Taxonomy, queries: DataFrame, n: int, seed: int = 0, tries: int = 3) -> DataFrame:
    """(query, negative): ``n`` nodes per query (id) that share no strict ancestor with it but the root concept, by hash order; fewer only where
    there are no more.

    Nodes are numbered branch by branch, and a query draws from the places outside its own branches, so even in a taxonomy that is
    nearly all one branch draws fit. The work is linear in the queries whatever the taxonomy's size.
    """
    scratch = Scratch(taxonomy.spark, "negatives")
    under = taxonomy.closure().where(F.col("anc") == ROOT_ID).select(F.col("node").alias("id")).distinct()
    up = scratch.keep(top_branches(taxonomy).distinct())
    home = up.groupBy(F.col("node").alias("id")).agg(F.min("branch").alias("branch"))
    placed = under.join(home, "id", "left").select("id", F.coalesce("branch", F.lit(ROOT_ID).cast("bigint")).alias("branch"))
    inside = dense_numbers(placed, "id", "branch", name="within")
    sizes = placed.groupBy("branch").agg(F.count(F.lit(1)).alias("size")).withColumn("_h", F.md5(F.col("branch").cast("string")))
    starts = scratch.keep(sum_before(sizes, "size", "_h", "start").select("branch", "start", "size"))
    numbered = scratch.keep(inside.join(starts, "branch").select("id", (F.col("start") + F.col("within")).alias("place")))
    total = numbered.count()
    q = queries.select(F.col("id").alias("query")).distinct().join(under.withColumnRenamed("id", "query"), "query", "left_semi")
    if not total:
        return q.select("query", F.col("query").alias("negative")).limit(0)
    # a query right under the root concept shares nothing with anybody, and only has to leave itself out
    own = q.join(up.withColumnRenamed("node", "query"), "query").join(starts, "branch").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("own"))
    none = F.array().cast("array<struct<start:bigint,size:bigint>>")
    spans = scratch.keep(q.join(own, "query", "left").select("query", F.coalesce("own", none).alias("own")))
    free = spans.select("query", (F.lit(total) - F.aggregate("own", F.lit(0).cast("bigint"), lambda s, x: s + x["size"])).alias("places"))

    def fits(draws: DataFrame) -> DataFrame:
        at = draws.join(spans, "query").withColumn("place", _place(seed, F.col("t"), F.col("places"), "query"))
        # over the query's own branches
        at = at.withColumn("place", F.aggregate("own", F.col("place"), lambda p, x: F.when(p >= x["start"], p + x["size"]).otherwise(p)))
        cand = at.join(numbered, "place").where(F.col("id") != F.col("query")).select("query", "t", "id")
        shared = cand.join(up.select(F.col("node").alias("id"), "branch"), "id").join(up.select(F.col("node").alias("query"), "branch"), ["query", "branch"], "left_semi")
        return cand.join(shared.select("query", "id").distinct(), ["query", "id"], "left_anti")

    return _draw_until(scratch, free, ["query"], n, tries, fits).select("query", F.col("id").alias("negative"))


def hold_out(sizes: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """(cluster_id): clusters (cluster_id, n) in hash order until their sizes add up to the target."""
    keyed = sizes.select("cluster_id", "n").withColumn("_h", hashed(seed, "cluster_id"))
    return sum_before(keyed, "n", "_h").where(F.col("before") < target).select("cluster_id")


def contrastive_triples(taxonomy: Taxonomy, cover: int = 2, n_negatives: int = 9, eval_share: float = 0.1, seed: int = 0) -> DataFrame:
    """(query_label, positive_label, negatives_label, split): pairs of siblings with negatives (an empty list where the taxonomy holds none). Whole
    clusters go to ``eval``, about the share of all pairs; which sibling is the query depends on the pair's hash."""
    pairs = cluster_pairs(taxonomy.edges, cover)
    swap = F.substring(hashed(seed, "cluster_id", "a", "b"), 1, 1) < "8"
    p = Scratch(taxonomy.spark, "triples").keep(pairs.select("cluster_id", F.when(swap, F.col("a")).otherwise(F.col("b")).alias("query"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("positive")))
    neg = negatives(taxonomy, p.select(F.col("query").alias("id")), n_negatives, seed)
    label = taxonomy.nodes.select("id", "label")
    named = neg.join(label.withColumnRenamed("id", "negative"), "negative").groupBy("query").agg(F.sort_array(F.collect_list("label")).alias("negatives_label"))
    split = F.when(F.conv(F.substring(hashed(seed, "cluster_id"), 1, 8), 16, 10).cast("double") < eval_share * 16.0**8, "eval").otherwise("train")
    out = p.join(named, "query", "left").join(label.select(F.col("id").alias("query"), F.col("label").alias("query_label")), "query")
    out = out.join(label.select(F.col("id").alias("positive"), F.col("label").alias("positive_label")), "positive")
    return out.select("query_label", "positive_label", F.coalesce("negatives_label", F.array().cast("array<string>")).alias("negatives_label"), split.alias("split"))


def family_chunks(taxonomy: Taxonomy, max_size: int = 3, seed: int = 0) -> DataFrame:
    """(cluster_id, chunk, members): each node's descendants within two hops (more than one, the root concept's aside) in hash order, cut into
    consecutive chunks of ``max_size``."""
    d = taxonomy.closure().where((F.col("dist") <= 2) & (F.col("anc") != ROOT_ID)).select(F.col("anc").alias("cluster_id"), F.col("node").alias("member"))
    size = d.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    keyed = d.join(size.select("cluster_id"), "cluster_id", "left_semi").withColumn("_h", F.xxhash64("cluster_id", "member", F.lit(str(seed))))
    at = ordered_numbers(keyed, "_h", "cluster_id", name="i").drop("_h")
    chunked = at.groupBy("cluster_id", F.floor(F.col("i") / max_size).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("i", "member"))).alias("m"))
    return chunked.select("cluster_id", "chunk", F.transform("m", lambda x: x["member"]).alias("members"))


def prompts(taxonomy: Taxonomy, clusters: DataFrame, prefix: str = "summarize: ") -> DataFrame:
    """(cluster_key, text, summary): the members' labels joined by [SEP] after the prefix, and the label of their first lowest common ancestor.
    ``clusters`` has cluster_key and members; members without a common ancestor give a null summary."""
    m = clusters.select("cluster_key", F.posexplode("members").alias("pos", "node"))
    label = taxonomy.nodes.select(F.col("id").alias("node"), "label")
    text = m.join(label, "node").groupBy("cluster_key").agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("l"))
    text = text.select("cluster_key", F.concat(F.lit(prefix), F.array_join(F.transform("l", lambda x: x["label"]), "[SEP]")).alias("text"))
    top = taxonomy.lca(m.select(F.col("cluster_key").alias("query_id"), "node")).groupBy(F.col("query_id").alias("cluster_key")).agg(F.min("node").alias("node"))
    return text.join(top.join(label, "node").select("cluster_key", F.col("label").alias("summary")), "cluster_key", "left")


def foreign_clusters(taxonomy: Taxonomy, chunks: DataFrame, n_positive: int, n_foreign: int, n: int, seed: int = 0) -> DataFrame:
    """(cluster_key, members): up to ``n`` clusters of ``n_positive`` members of one chunk and ``n_foreign`` others that share only the root
    concept with the first."""
    base = chunks.where(F.size("members") >= max(1, n_positive)).select(F.concat_ws("_", "cluster_id", "chunk").alias("k"), "members")
    # the first n by hash, without sorting all in one place
    base = sum_before(base.withColumn("_h", hashed(seed, "k")).withColumn("_one", F.lit(1)), "_one", "_h").where(F.col("before") < n).select("k", "members")
    first = base.select("k", F.element_at("members", 1).alias("query"), F.slice("members", 1, max(1, n_positive)).alias("own"))
    neg = negatives(taxonomy, first.select(F.col("query").alias("id")), n_foreign if n_positive else n_foreign - 1, seed)
    extra = neg.groupBy("query").agg(F.sort_array(F.collect_list("negative")).alias("others"))
    return first.join(extra, "query").select(F.concat(F.lit(f"neg{n_positive}_{n_foreign}_"), "k").alias("cluster_key"), F.array_distinct(F.concat("own", "others")).alias("members"))


def generation_prompts(taxonomy: Taxonomy, chunk: int = 3, ratio: float = 0.4, patterns=((0, 2), (0, 3), (2, 1)), weights=(1, 1, 3), eval_share: float = 0.1, seed: int = 0) -> DataFrame:
    """(text, summary, split): prompts of family chunks, and per pattern a weighted share of prompts with foreign members."""
    scratch = Scratch(taxonomy.spark, "prompts")
    chunks = scratch.keep(family_chunks(taxonomy, chunk, seed))
    total = chunks.count()
    clusters = chunks.select(F.concat_ws("_", F.lit("pos"), "cluster_id", "chunk").alias("cluster_key"), "members")
    for (pos, neg), weight in zip(patterns, weights):
        n = -(-int(total * ratio * weight) // sum(weights))
        clusters = clusters.unionByName(foreign_clusters(taxonomy, chunks, pos, neg, n, seed))
    out = prompts(taxonomy, scratch.keep(clusters))
    split = F.when(F.conv(F.substring(hashed(seed, "cluster_key"), 1, 8), 16, 10).cast("double") < eval_share * 16.0**8, "eval").otherwise("train")
    return out.select("text", "summary", split.alias("split"))


def subsumption_positives(taxonomy: Taxonomy) -> DataFrame:
    """(sub, sup): every node with each of its ancestors within two hops."""
    return taxonomy.closure().where(F.col("dist") <= 2).select(F.col("node").alias("sub"), F.col("anc").alias("sup"))


def easy_negatives(taxonomy: Taxonomy, positives: DataFrame, rate: int = 1, seed: int = 0) -> DataFrame:
    """(sub, sup): for each positive ``rate`` drawn nodes, a drawn ancestor (or the node itself) being replaced by a later draw; fewer only where
    all other nodes are ancestors."""
    scratch = Scratch(taxonomy.spark, "easy")
    numbered = scratch.keep(dense_numbers(taxonomy.nodes.select("id").distinct(), "id"))
    total = numbered.count()
    up = taxonomy.closure().select(F.col("node").alias("sub"), F.col("anc").alias("id"))
    rows = positives.select("sub", F.col("sup").alias("of"), F.lit(total).cast("bigint").alias("places"))

    def fits(draws: DataFrame) -> DataFrame:
        cand = draws.withColumn("place", _place(seed, F.col("t"), F.col("places"), "sub", "of")).join(numbered, "place").select("sub", "of", "t", "id")
        return cand.where(F.col("sub") != F.col("id")).join(up, ["sub", "id"], "left_anti").select("sub", "of", "t", "id")

    return _draw_until(scratch, rows, ["sub", "of"], rate, 2, fits).select("sub", F.col("id").alias("sup"))


def hard_negatives(taxonomy: Taxonomy, positives: DataFrame, rate: int = 1, seed: int = 0, tries: int = 8, widest: int = 5) -> DataFrame:
    """(sub, sup): for each positive ``rate`` nodes one or two undirected steps from its superclass that are no ancestors of the
    subclass (the subclass itself may be among them); where there are fewer, the rings are widened step by step. Fewer than ``rate`` come out
    only where all that can be reached are ancestors.

    The steps are drawn by hash from numbered neighbour lists, ``rate * tries`` walks per positive, and up to ``widest`` of them for positives
    that stay short. Rings around a hub would hold all its neighbours for each of them; the walks stay linear in the positives. What even
    they leave short has little but ancestors around it, and its rings are walked whole.
    """
    scratch = Scratch(taxonomy.spark, "hard")
    e = taxonomy.edges.select("src", "tgt")
    both = scratch.keep(e.unionByName(e.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct())
    lists = scratch.keep(dense_numbers(both.select(F.col("tgt").alias("id"), F.col("src").alias("of")), "id", "of"))
    degree = scratch.keep(lists.groupBy("of").agg(F.count(F.lit(1)).alias("deg")))
    up = taxonomy.closure().select(F.col("node").alias("sub"), F.col("anc").alias("sup"))

    def step(df: DataFrame, salt: str) -> DataFrame:
        d = df.join(degree.withColumnRenamed("of", "at"), "at")
        place = F.conv(F.substring(hashed(seed, F.lit(salt), "sub", "of", "t"), 1, 12), 16, 10).cast("bigint") % F.col("deg")
        return d.withColumn("place", place).drop("deg").join(lists.withColumnRenamed("of", "at"), ["at", "place"]).select("sub", "of", "t", F.col("id").alias("at"))

    def fine(cand: DataFrame) -> DataFrame:
        ends = cand.where(F.col("at") != F.col("of")).groupBy("sub", "of", F.col("at").alias("sup")).agg(F.min("t").alias("t"))
        return ends.join(up, ["sub", "sup"], "left_anti").select("sub", "of", "sup", "t")

    wanted = scratch.keep(positives.select("sub", F.col("sup").alias("of")).distinct())

    def short_of(found: DataFrame) -> DataFrame:
        have = found.groupBy("sub", "of").agg(F.countDistinct("sup").alias("_n"))
        return scratch.keep(wanted.join(have, ["sub", "of"], "left").where(F.coalesce("_n", F.lit(0)) < rate).select("sub", "of"))

    draws = wanted.select("sub", "of", F.explode(F.sequence(F.lit(1), F.lit(rate * tries))).alias("t"), F.col("of").alias("at"))
    one = scratch.keep(step(draws, "first"))
    ends = one.where(F.col("t") % 2 == 1).unionByName(step(one.where(F.col("t") % 2 == 0), "second"))
    found = scratch.keep(fine(ends))
    left = short_of(found)
    for steps in range(2, widest + 1):
        if left.isEmpty():
            break
        base = rate * tries * steps
        walk = left.select("sub", "of", F.explode(F.sequence(F.lit(base + 1), F.lit(base + rate * tries))).alias("t"), F.col("of").alias("at"))
        for i in range(steps):
            walk = step(walk, f"step {i} of {steps}")
        found = scratch.keep(found.unionByName(fine(walk)))
        left = short_of(found)
    ring, depth = left.select("sub", "of", F.col("of").alias("at")), 0
    seen = scratch.keep(ring)
    while not left.isEmpty():
        depth += 1
        grown = ring.join(both.select(F.col("src").alias("at"), F.col("tgt").alias("next")), "at").select("sub", "of", F.col("next").alias("at")).distinct()
        ring = scratch.keep(grown.join(seen, ["sub", "of", "at"], "left_anti"))
        if ring.isEmpty():
            break
        seen = scratch.keep(seen.unionByName(ring))
        if depth >= 2:
            every = fine(seen.withColumn("t", F.lit(1_000_000 + depth)))
            found = scratch.keep(found.unionByName(every))
            left = short_of(found)
            ring = ring.join(left, ["sub", "of"], "left_semi")
    once = found.groupBy("sub", "of", "sup").agg(F.min("t").alias("t"))
    w = Window.partitionBy("sub", "of").orderBy("t", hashed(seed, "sub", "of", "sup"), "sup")
    return once.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rate).select("sub", "sup")


def subsumption_pairs(taxonomy: Taxonomy, easy: int = 1, hard: int = 1, eval_share: float = 0.05, seed: int = 0) -> DataFrame:
    """(subclass, superclass, labels, split): positives with label 1, easy and hard negatives with label 0, split by hash per part."""
    pos = Scratch(taxonomy.spark, "pairs").keep(subsumption_positives(taxonomy))
    part = lambda df, y, k: df.select("sub", "sup", F.lit(y).alias("labels"), F.lit(k).alias("kind"))
    rows = part(pos, 1, "pos").unionByName(part(easy_negatives(taxonomy, pos, easy, seed), 0, "easy")).unionByName(part(hard_negatives(taxonomy, pos, hard, seed), 0, "hard"))
    names = taxonomy.nodes.select("id", "label")
    named = rows.join(names.select(F.col("id").alias("sub"), F.col("label").alias("subclass")), "sub").join(names.select(F.col("id").alias("sup"), F.col("label").alias("superclass")), "sup")
    u = F.conv(F.substring(hashed(seed, "kind", "sub", "sup"), 1, 8), 16, 10).cast("double")
    return named.select("subclass", "superclass", "labels", F.when(u < eval_share * 16.0**8, "eval").otherwise("train").alias("split"))

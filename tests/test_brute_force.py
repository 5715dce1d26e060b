"""Random graphs against plain Python."""

import random

import pytest

from taxograft.operators import closure as cl
from tests.helpers import make, rows


def reach(edges, labels=None):
    up = {}
    for s, t, lab in edges:
        if labels is None or lab in labels:
            up.setdefault(s, set()).add(t)
    out = {}
    for s in {e[0] for e in edges} | {e[1] for e in edges}:
        seen, front, d = {}, {s}, 0
        while front:
            d += 1
            front = {t for x in front for t in up.get(x, ())} - set(seen)
            seen.update(dict.fromkeys(front, d))
        out[s] = seen
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_dag(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(5, 40)
    edges = sorted({(a, rnd.randrange(a), rnd.choice(["original", "auto", "new"])) for a in range(1, n) for _ in range(rnd.randint(0, 2))})
    edges = [e for i, e in enumerate(edges) if i == 0 or e[:2] != edges[i - 1][:2]]
    t = make(spark, edges, extra=range(n))
    for labels in (None, ["original", "new"]):
        want = sorted((s, a, d) for s, anc in reach(edges, labels).items() for a, d in anc.items())
        assert rows(t.closure(labels), "node", "anc", "dist") == want
    r = {**{i: {} for i in range(n)}, **reach(edges)}
    star = {k: set(v) | {k} for k, v in r.items()}
    sets = {f"q{i}": set(rnd.sample(range(n), rnd.randint(1, 4))) for i in range(12)}
    q = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "query_id string, node bigint")
    lca, gcd, low, high = [], [], [], []
    for k, s in sets.items():
        common = set.intersection(*[star[x] for x in s])
        lca += [(k, c) for c in common if not any(c in r[d] for d in common)]
        down = {x for x in range(n) if all(y in star[x] for y in s)}
        gcd += [(k, c) for c in down if not any(d in r[c] for d in down)]
        low += [(k, x) for x in s if not any(x in r[y] for y in s)]
        high += [(k, x) for x in s if not any(y in r[x] for y in s)]
    assert rows(t.lca(q), "query_id", "node") == sorted(lca)
    assert rows(t.gcd(q), "query_id", "node") == sorted(gcd)
    assert rows(t.reduce_subset(q), "query_id", "node") == sorted(low)
    assert rows(t.reduce_subset(q, True), "query_id", "node") == sorted(high)
    kept = [(s, a) for s, a, _ in edges if not any(a in r[w] for w in {x[1] for x in edges if x[0] == s})]
    assert rows(t.transitive_reduction().edges, "src", "tgt") == sorted(kept)
    assert cl.is_acyclic(t.edges)

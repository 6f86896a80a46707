from __future__ import annotations

from collections import Counter

import numpy as np

from quillsift.llm.rpforest import embedding_groups, linked, links


def planted(n, dim=32, seed=0):
    """n unit vectors in families of up to 6 within a cosine of about 0.97, the rest unrelated."""
    rng = np.random.default_rng(seed)
    out, family = [], []
    while len(out) < n:
        base = rng.standard_normal(dim)
        for _ in range(rng.choice([1, 1, 2, 6])):
            v = base / np.linalg.norm(base) + rng.standard_normal(dim) * 0.17 / np.sqrt(dim)
            out.append(v / np.linalg.norm(v))
            family.append(len(family))
    return np.array(out[:n], np.float32)


def brute_pairs(v, t):
    s = v.astype(np.float64) @ v.T.astype(np.float64)
    i, j = np.nonzero(np.triu(s >= t, 1))
    return set(zip(i.tolist(), j.tolist()))


def roots(n, pairs):
    r = list(range(n))
    def find(x):
        while r[x] != x:
            x = r[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        r[b] = a
    return [find(i) for i in range(n)]


def test_recall_against_brute_force(spark):
    v = planted(3000)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    # small nodes, so that the distributed cuts are passed through more than once
    out = embedding_groups(df, leaf=60, local_bytes=250 * 128, cuts=2).collect()
    got = {r.vec_id: r.class_id for r in out}
    sizes = Counter(got.values())
    assert len(out) == len(v) and all(r.n_links == sizes[r.class_id] - 1 for r in out)
    pairs = brute_pairs(v / np.linalg.norm(v, axis=1, keepdims=True), 0.95)
    want = roots(len(v), pairs)
    assert len(got) == len(v) and len(pairs) > 1000
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert all(want[d] == want[g] for d, g in got.items())  # nothing united that brute force keeps apart


def test_links_against_brute_force():
    v = planted(900, seed=3)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = roots(len(v), brute_pairs(v, 0.95))
    assert linked(v, 0.95).tolist() == want
    got = roots(len(v), links(v, 0.95, 6, 50, 0.05, np.random.default_rng(1)))
    assert all(want[i] == want[r] for i, r in enumerate(got)) and sum(a == b for a, b in zip(got, want)) >= 0.98 * len(v)
    # one leaf, compared in blocks
    assert roots(len(v), links(v, 0.95, 1, 1000, 0.05, np.random.default_rng(1), step=100)) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (10, None), (11, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "c", "c", 1) for r in rows], "vec_id long, embedding array<double>, node string, root string, n int")
    got = sorted(((g.vec_id, g.class_id, g.n_links) for g in embedding_groups(df).collect()), key=str)
    alone = [(i, i, 0) for i in (3, 5, 6, 7, 8, 9, 11)]
    assert got == sorted([(1, 1, 3), (2, 1, 3), (2, 1, 3), (None, 1, 3), (4, 4, 1), (10, 4, 1), *alone], key=str)
    assert embedding_groups(df.limit(0)).count() == 0


def test_many_equal_and_collinear_vectors(spark):
    rows = [(i, [1.0, 0.001 * i, 0.0]) for i in range(400)] + [(1000 + i, [0.0, 0.0, 1.0 + i]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(r.class_id for r in embedding_groups(df, leaf=20, local_bytes=600).collect())
    assert got == {0: 400, 1000: 300}


def test_vectors_that_no_cut_parts(spark):
    """Distinct vectors of the same projections: the cut leaves them together, so they are dealt out, and others that lie
    beside them are found all the same."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.standard_normal(16) * 3e-8).tolist()) for i in range(500)] + [(1000 + i, rng.standard_normal(16).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.class_id for r in embedding_groups(df, leaf=20, local_bytes=16 * 4 * 40).collect()}
    assert {got[i] for i in range(500)} == {0} and all(got[1000 + i] == 1000 + i for i in range(300))

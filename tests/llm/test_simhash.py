from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm.components import components
from quillsift.llm.dedup import simhash_dedup, simhash_groups
from quillsift.llm.common import join_hot, written
from quillsift.llm.simhash import Balls, Tables, fingerprint, fingerprint_search, near_edges, near_pairs

from .conftest import docs_frame


def plain(text):
    """The fingerprint by its definition, a bit at a time."""
    words = {w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡") for w in text.lower().split()} - {""}
    if not words:
        return None
    votes = [0] * 128
    for w in words:
        h = int.from_bytes(hashlib.md5(w.encode()).digest(), "big")
        for i in range(128):
            votes[i] += min(len(w), 8) * (1 if h >> (127 - i) & 1 else -1)
    return sum((v > 0) << (127 - i) for i, v in enumerate(votes)).to_bytes(16, "big")


@pytest.mark.parametrize("text", ["a", "One two, two THREE.", "Größe ñandú 漢字 é", "", "  ", "?!", "word " * 3000 + " ".join(map(str, range(20_000)))])
def test_fingerprint_is_its_definition(text):
    assert fingerprint(text) == plain(text)


def near_set(n, bits, seed, most):
    rng = random.Random(seed)
    out = []
    for _ in range(n // 4):
        base = rng.getrandbits(bits)
        for _ in range(4):
            x = base
            for b in rng.sample(range(bits), rng.randint(0, most)):
                x ^= 1 << b
            out.append(x.to_bytes(bits // 8, "big"))
    return sorted(set(out))


def distance(a, b):
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()


def brute(fps, radius):
    return {(a, b, distance(a, b)) for k, a in enumerate(fps) for b in fps[k + 1 :] if distance(a, b) <= radius}


def ordered(rows):
    return [(*sorted((bytes(r.u), bytes(r.v))), r.distance) for r in rows]


@pytest.mark.parametrize("most", [4096, 60, 12])
def test_all_pairs_within_the_radius_once(spark, most):
    """With most below the size of a key, keys are split: those of many fingerprints with equal leading bits too."""
    fps = near_set(600, 64, 1, 5)
    fps = sorted({*fps, *(b"\1\2\3\4" + f[4:] for f in fps[:150]), *(bytes(7) + bytes([i]) for i in range(40))})
    df = spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary")
    got = ordered(near_pairs(df, Tables(8, 8, 2, 6, most)).collect())
    assert len(got) == len(set(got))
    assert set(got) == brute(fps, 6)


@pytest.mark.parametrize("most", [4096, 20])
def test_pairs_of_the_asked(spark, most):
    fps = near_set(600, 64, 4, 5)
    fps = sorted({*fps, *(b"\1\2\3\4" + f[4:] for f in fps[:150])})
    asked = set(fps[::7])
    df = spark.createDataFrame([(bytearray(f), f in asked) for f in fps], "fp binary, asked boolean")
    got = [(bytes(r.u), bytes(r.v), r.distance) for r in near_pairs(df, Tables(8, 8, 2, 6, most)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {p for a, b, d in brute(fps, 6) for p in ((a, b, d), (b, a, d)) if p[0] in asked}


@pytest.mark.parametrize("most", [4096, 20])
def test_recall_at_the_dedup_radius(spark, most):
    fps = near_set(800, 128, 2, 11)
    df = spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary")
    got = set(ordered(near_pairs(df, Tables(16, 16, 2, 20, most)).collect()))
    want = brute(fps, 20)
    assert got <= want
    assert {p for p in want if p[2] <= 14} <= got
    edge = {p for p in want if p[2] >= 18}
    assert len(edge) > 50 and len(edge & got) >= 0.9 * len(edge)


def test_tables_find_the_same_whatever_is_split(spark):
    """Pairs of 15 differing bits, dealt out evenly, in a key that is split if most is 20."""
    rng = random.Random(9)
    fps = []
    for _ in range(30):
        a = 0x0102 << 112 | rng.getrandbits(112)
        b = a ^ sum(1 << 127 - int(rng.choice(at)) for at in np.array_split(np.arange(16, 128), 15))
        fps += [a.to_bytes(16, "big"), b.to_bytes(16, "big")]
    df = spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary")
    for most in (4096, 20):
        assert set(ordered(near_pairs(df, Tables(16, 16, 2, 20, most)).collect())) == brute(sorted(fps), 20), most


@pytest.mark.parametrize("bits, radius, most", [(128, 20, 4096), (128, 20, 20), (64, 7, 20)])
def test_balls_find_all_pairs_within_the_radius_once(spark, bits, radius, most):
    """Keys dealt into chunks, too."""
    fps = near_set(400, bits, 7, max(1, radius * 11 // 20))
    fps = sorted({*fps, *(bytes(bits // 8 - 1) + bytes([i]) for i in range(40))})
    df = spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary")
    got = ordered(near_pairs(df, Balls(bits // 8, radius, most)).collect())
    assert len(got) == len(set(got))
    assert set(got) == brute(fps, radius)


def far_pairs():
    """Rows of texts two by two, each two within 15 to 20 bits and equal in fewer than 2 of 16 bytes."""
    rng = random.Random(8)
    rows = []
    while len(rows) < 16:
        a = [f"{rng.randrange(10**6)}w" for _ in range(60)]
        b = mutate(rng, a, 0.1)
        u, v = fingerprint(" ".join(a)), fingerprint(" ".join(b))
        if distance(u, v) <= 20 and sum(x == y for x, y in zip(u, v)) < 2:
            rows += [(len(rows), " ".join(a), "s"), (len(rows) + 1, " ".join(b), "s")]
    return rows


def test_groups_link_pairs_of_few_equal_blocks(spark):
    got = {r.doc_id: (r.class_id, r.n_links) for r in simhash_groups(docs_frame(spark, far_pairs())).collect()}
    assert got == {i: (i // 2 * 2, 1) for i in range(16)}


def test_copies_of_few_equal_blocks_go(spark):
    assert sorted(r.doc_id for r in simhash_dedup(docs_frame(spark, far_pairs())).collect()) == list(range(0, 16, 2))


@pytest.mark.parametrize("most", [4096, 20])
def test_edges_join_what_pairs_join(spark, most):
    fps = near_set(400, 128, 3, 7)
    df = spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary")
    def groups(rows):
        root = {f: f for f in fps}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for u, v in rows:
            a, b = sorted((find(u), find(v)))
            root[b] = a
        return {f: find(f) for f in fps}
    a = groups((bytes(r.u), bytes(r.v)) for r in near_edges(df, Tables(16, 16, 2, 20, most)).collect())
    b = groups((bytes(r.u), bytes(r.v)) for r in near_pairs(df, Tables(16, 16, 2, 20, most)).collect())
    assert a == b


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (5, 4), (None, 1), (7, None), *((i, i + 1) for i in range(100, 160)), (160, 100), (200, 300), (300, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 200: 200, 300: 200} | {i: 100 for i in range(100, 161)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def mutate(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def test_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    rows, family = [], {}
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(30, 400))]
        rows.append((len(rows), " ".join(w), f"s{d % 5}"))
        family[rows[-1][0]] = d
        for c in range(rng.choice([0, 0, 1, 3])):
            rows.append((len(rows), " ".join(w if c == 0 else mutate(rng, w, 0.03)), f"s{c}"))
            family[rows[-1][0]] = d
    out = simhash_dedup(docs_frame(spark, rows))
    kept = [r.doc_id for r in out.collect()]
    assert len({family[k] for k in kept}) == 120
    assert len(kept) <= 122
    members = simhash_groups(docs_frame(spark, rows)).collect()
    assert sorted(m.doc_id for m in members) == [r[0] for r in rows]
    assert {m.class_id for m in members} == set(kept)
    assert all(family[m.doc_id] == family[m.class_id] for m in members)
    sizes = Counter(m.class_id for m in members)
    assert all(m.n_links == sizes[m.class_id] - 1 for m in members)


def test_odd_documents(odd_docs, no_docs):
    got = sorted(((r.doc_id, r.text) for r in simhash_dedup(odd_docs).collect()), key=str)
    ids = [i for i, _ in got]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(8) == 1 and 6 in ids and 7 not in ids
    assert {3, 4, 5, 9} <= set(ids) and ids.count(None) == 2  # the text without id; the equal null rows are one... by text
    assert simhash_dedup(odd_docs).columns == odd_docs.columns
    assert simhash_dedup(no_docs).count() == 0 and simhash_groups(no_docs).count() == 0
    rows = simhash_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    g = {r.doc_id: (r.class_id, r.n_links) for r in rows if r.doc_id is not None}
    assert g[1] == g[2] == (1, 2) and g[6] == g[7] == (6, 1) and g[4] == (4, 0) and g[8] == (8, 0)
    assert {(r.class_id, r.n_links) for r in rows if r.doc_id is None} == {(None, 0)}


def test_join_hot(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(600)] + [(1000, None), (1001, "none")], "i long, k string")
    info = written(rows.where("k is not null and k <> 'none'").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")), "info")
    want = {r.k: r.top for r in info.collect()}
    got = {r.i: r.top for r in join_hot(rows, info, "k", "n").collect()}
    assert got == {r.i: want.get(r.k) for r in rows.collect()}


def test_search_against_brute_force(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    rows = []
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(200)]
        rows += [(len(rows) + k, " ".join(w if k < 2 else mutate(rng, w, 0.01)), "s") for k in range(4)]
    fps = {i: plain(t)[:8] for i, t, _ in rows}
    least = {}
    for i, f in fps.items():
        least.setdefault(f, i)
    for asked, is_asked in ((F.lit(True), lambda i: True), (F.col("doc_id") % 100 == 0, lambda i: i % 100 == 0)):
        got = [(r.doc_id, r.fingerprint, r.same_id, r.near_id, r.distance) for r in fingerprint_search(docs_frame(spark, rows), asked).collect()]
        want = [(i, f.hex(), least[f], None, None) for i, f in fps.items()]
        queries = {f for i, f in fps.items() if is_asked(i)}
        want += [(least[f], f.hex(), least[f], least[g], distance(f, g)) for f in queries for g in least if f != g and distance(f, g) <= 6]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert len(want) > len(rows)


def test_search_odd_documents(odd_docs, no_docs):
    rows = fingerprint_search(odd_docs, F.col("doc_id") > 0).collect()
    members = [r for r in rows if r.near_id is None]
    assert len(members) == odd_docs.count()
    by = {r.doc_id: r for r in members if r.doc_id is not None}
    assert by[2].same_id == 1 and by[3].fingerprint is None and by[8].same_id is None
    assert fingerprint_search(no_docs, F.lit(True)).count() == 0


def test_radius_beyond_the_tables(odd_docs):
    with pytest.raises(ValueError):
        fingerprint_search(odd_docs, F.lit(True), radius=7)

from __future__ import annotations

import random

import pandas as pd
import pytest

from quillsift.llm.packing import pack, pack_shard
from quillsift.llm.registry import QUERIES

from .conftest import docs_frame


def brute(d: pd.DataFrame, cap: int) -> list[tuple]:
    """Looks at every bin for every document."""
    d = d.sort_values(["doc_id", "src", "cluster"], kind="stable", na_position="last")
    d = d.iloc[(-(d.n_tokens % cap)).argsort(kind="stable")]
    bins, out = [], []
    for i, s, c, t in zip(d.doc_id, d.src, d.cluster, d.n_tokens):
        n = t % cap
        if n:
            fits = [(room, k) for k, (room, srcs, cls) in enumerate(bins) if room >= n and s not in srcs and (c is None or c not in cls)]
            if fits:
                k = min(fits)[1]
            else:
                k = len(bins)
                bins.append([cap, set(), set()])
            out.append((i, t // cap, k, cap - bins[k][0], n))
            bins[k][0] -= n
            bins[k][1].add(s)
            bins[k][2].add(c)
    return sorted(out)


@pytest.mark.parametrize("seed", range(25))
def test_against_brute_force(seed):
    r = random.Random(seed)
    n, cap = r.choice([1, 5, 50, 400]), r.choice([8, 50, 400])
    d = pd.DataFrame({"doc_id": [f"{i:05d}" for i in range(n)], "src": [r.choice("aaaabcde") for _ in range(n)], "cluster": [r.choice([None, "1", "2", "3", *map(str, range(10, 200))]) for _ in range(n)], "n_tokens": [r.randint(1, 3 * cap) if r.random() < 0.1 else r.randint(1, cap) for _ in range(n)]})
    o = pack_shard(d, cap)
    tails = o[o.piece == (o.doc_id.map(d.set_index("doc_id").n_tokens) // cap)]
    assert sorted(tails[["doc_id", "piece", "bin", "bin_offset", "n_tokens"]].itertuples(index=False, name=None)) == brute(d, cap)
    assert o.groupby("doc_id").n_tokens.sum().to_dict() == d.set_index("doc_id").n_tokens.to_dict()


def test_conflicts_and_room(spark):
    r = random.Random(9)
    texts = ["t" * r.randint(1, 400) for _ in range(40)]
    rows = [(i, r.choice(texts) if r.random() < 0.5 else f"{i} " + "y" * r.randint(1, 3000), r.choice("aaabcdef")) for i in range(600)]
    docs = docs_frame(spark, rows)
    out = pack(docs, capacity=128, shard_docs=200).toPandas()
    source, text = {i: s for i, _, s in rows}, {i: t for i, t, _ in rows}
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == {i: -(-len(t) // 4) for i, t, _ in rows}
    assert out.shard.nunique() > 1
    for _, b in out.groupby(["shard", "bin"]):
        b = b.sort_values("bin_offset")
        assert b.n_tokens.sum() <= 128 and (b.bin_offset == b.n_tokens.cumsum() - b.n_tokens).all()
        assert len({source[i] for i in b.doc_id}) == len(b) == len({text[i] for i in b.doc_id})


def test_odd_documents(odd_docs, no_docs):
    out = pack(odd_docs).toPandas()
    assert set(out.doc_id.dropna()) == {1, 2, 5, 6, 7, 8, 9}
    assert len(out[out.doc_id == 1]) == 2 and len(out[out.doc_id == 1].drop_duplicates(["shard", "bin"])) == 2
    long = odd_docs.where("doc_id = 6").first().text
    six = out[out.doc_id == 6].sort_values("piece")
    assert six.n_tokens.sum() == -(-len(long) // 4) and list(six.first_token) == [4096 * i for i in range(len(six))]
    assert pack(no_docs).count() == 0


def test_given_lengths_and_clusters(spark):
    d = spark.createDataFrame([(1, "a", "s", 5, "c"), (2, "b", "t", 5, "c"), (3, "d", "u", 3, None), (4, "e", "v", None, "c")], "doc_id long, text string, source string, len int, c string")
    out = {r.doc_id: r.bin for r in pack(d, capacity=10, cluster_col="c", tokens_col="len").collect()}
    assert out[1] != out[2] and out[3] in (out[1], out[2]) and 4 not in out


def test_near_copies_never_share_a_bin(spark, tmp_path):
    """The registered query, over copies that differ by one character and come from different sources."""
    r = random.Random(4)
    rows, base = [], {}
    for k in range(30):
        text = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(300))
        for c in range(r.choice([1, 2, 6])):
            at = r.randrange(len(text))
            base[len(rows)] = k
            rows.append((len(rows), text[:at] + "q" + text[at + 1 :], f"s{c}"))
    rows += [(1000, "!!!", "s0"), (1001, "!!!", "s1"), (None, rows[0][1], "s8"), (1002, None, "s9")]
    docs_frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op2_best_fit_packing"](spark, str(tmp_path)).toPandas()
    assert len(out) == len(rows) - 1
    name = {**base, 1000: "!", 1001: "!"}
    of = [base[0] if i != i else name[int(i)] for i in out.doc_id]
    assert not out.assign(of=of).duplicated(["shard", "bin", "of"]).any()
    assert out.bin.nunique() < len(out)


def test_rows_that_differ_in_length_alone():
    rows = [("1", "=a", "c", n) for n in (40, 140, 240, 340)]
    want = pack_shard(pd.DataFrame(rows, columns=["doc_id", "src", "cluster", "n_tokens"]), 100)
    for order in ([3, 1, 0, 2], [2, 3, 1, 0]):
        got = pack_shard(pd.DataFrame([rows[i] for i in order], columns=["doc_id", "src", "cluster", "n_tokens"]), 100)
        assert got.equals(want)

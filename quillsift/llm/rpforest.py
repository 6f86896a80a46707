"""Operator 10, embedding near-dedup with a forest of random-projection trees.

Each tree cuts the vectors by random hyperplanes at the median; vectors within a band about the cut go to both sides
(spill). While a node holds more vectors than one task should, a cut is a distributed step over ids: projections, one
aggregation for the quantiles, and a join that sends each id on. Below that size the vectors of a node are brought to a
task, which grows several trees there. Vectors that meet in a leaf of any tree are compared; pairs that pass are united.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import discard, join_hot, maybe_broadcast, written
from quillsift.llm.components import components

THRESHOLD = 0.95
#: Trees of the whole table, and trees within each of their nodes that one task holds: 12 ways to meet. Only the
#: former cost copies of the vectors.
TREES, LOCAL_TREES, LEAF, SPILL = 3, 4, 200, 0.05
#: Bytes of vectors that one task may hold, and the most cuts of one distributed step.
LOCAL_BYTES, CUTS = 8 << 20, 3
#: A child with more than this share of its parent's vectors was not parted: they are dealt out by a hash, and the
#: first PIVOTS by it go to every hand.
STUCK, PIVOTS = 0.8, 16


def _directions(seed: int, tree: int, path: str, n: int, dim: int) -> np.ndarray:
    rng = np.random.default_rng([seed, tree, zlib.crc32(path.encode())])
    return rng.standard_normal((n, dim)).astype(np.float32)


def linked(v: np.ndarray, threshold: float) -> np.ndarray:
    """For each of the unit rows v, the least row that a chain of pairs with a dot product of at least threshold links
    it to; pairs near the threshold are checked in double precision."""
    s = v @ v.T
    close = s >= threshold + 1e-4
    i, j = np.nonzero((s >= threshold - 1e-4) & ~close)
    if len(i):
        close[i, j] = np.einsum("ij,ij->i", v[i].astype(np.float64), v[j].astype(np.float64)) >= threshold
    np.fill_diagonal(close, True)
    label = np.arange(len(v))
    some = np.flatnonzero(close.sum(axis=1) > 1)
    if not len(some):
        return label
    near = close[np.ix_(some, some)]
    at = np.arange(len(some))
    while True:
        new = np.where(near, at, len(some)).min(axis=1)
        new = new[new]
        if (new == at).all():
            label[some] = some[at]
            return label
        at = new


def leaves(v: np.ndarray, leaf: int, spill: float, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Index sets of the leaves of one tree. A cut that would not part the vectors makes a leaf of them."""
    todo = [np.arange(len(v))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            yield at
            continue
        p = v[at] @ rng.standard_normal(v.shape[1]).astype(v.dtype)
        k = int((0.5 - spill) * (len(p) - 1)), int((0.5 + spill) * (len(p) - 1)) + 1
        lo, hi = np.partition(p, k)[list(k)]
        left, right = at[p <= hi], at[p >= lo]
        if max(len(left), len(right)) > (0.75 + spill) * len(at):
            yield at
        else:
            todo += [left, right]


def links(v: np.ndarray, threshold: float, trees: int, leaf: int, spill: float, rng: np.random.Generator, step: int = 2048) -> list[tuple[int, int]]:
    """A spanning forest (i, j) of what the leaves of some trees over v link. Leaves that could not be cut are compared
    in blocks of step rows."""
    root, out = np.arange(len(v)), []
    for _ in range(trees):
        for at in leaves(v, leaf, spill, rng):
            blocks = [at[i : i + step] for i in range(0, len(at), step)]
            pairs = [at] if len(blocks) < 2 else [np.concatenate([blocks[i], blocks[j]]) for i in range(len(blocks)) for j in range(i)]
            for part in pairs:
                label = linked(v[part], threshold)
                for i in np.flatnonzero(label != np.arange(len(part))).tolist():
                    a, b = int(part[i]), int(part[label[i]])
                    i, j = a, b
                    while root[i] != i:
                        root[i] = i = root[root[i]]
                    while root[j] != j:
                        root[j] = j = root[root[j]]
                    if i != j:
                        root[max(i, j)] = min(i, j)
                        out.append((a, b))
    return out


def _units(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key, vec) of each row: vec is the vector at unit length, packed as float32, null if it has no direction; key
    is an MD5 of it, or of the vector as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            sizes = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0, int)
            if len(col) and not col.null_count and not col.values.null_count and sizes.min() == sizes.max() > 0:
                m = col.flatten().to_numpy().reshape(len(col), -1)
                top = np.abs(m).max(axis=1)
                if ((top > 1e-30) & (top < 1e30)).all():
                    units = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
                    vecs = [x.tobytes() for x in units]
                    keys = [hashlib.md5(x).digest() for x in vecs]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "key", "vec"])
                    continue
            rows = [None if x is None else np.array(x, np.float64) for x in col.to_pylist()]
            keys, vecs = [], []
            for x in rows:
                top = 0.0 if x is None or not len(x) else float(np.abs(x).max())  # null parts are NaN here
                if 1e-30 < top < 1e30:
                    vecs.append((x / np.linalg.norm(x)).astype(np.float32).tobytes())
                    keys.append(hashlib.md5(vecs[-1]).digest())
                else:
                    vecs.append(None)
                    keys.append(hashlib.md5(b"none" if x is None else b"raw" + (x + 0.0).tobytes()).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "key", "vec"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(run, f"id {kind}, key binary, vec binary")


def _cut(rows: DataFrame, nodes: DataFrame, n_nodes: int, cuts: int, spill: float, seed: int) -> DataFrame:
    """One distributed step over rows (node, tree, path, vec) of the nodes (tree, path, n, cuts): (node, tree, path, was),
    each id sent to its child or, within a band, to several. A node gets as many cuts as its size calls for."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, str], np.ndarray] = {}
        for b in batches:
            p = np.empty((len(b), cuts), np.float32)
            for (tree, path), at in b.groupby(["tree", "path"]).indices.items():
                v = np.frombuffer(b"".join(b["vec"].iloc[at]), np.float32).reshape(len(at), -1)
                if len(known) > 10_000:
                    known.clear()
                if (tree, path) not in known:
                    known[tree, path] = _directions(seed, tree, path, cuts, v.shape[1])
                p[at] = v @ known[tree, path].T
            yield b.drop(columns="vec").assign(**{f"p{i}": p[:, i] for i in range(cuts)})

    ps = ", ".join(f"p{i} float" for i in range(cuts))
    rows = written(rows.select("node", "tree", "path", "vec").mapInPandas(project, f"node long, tree int, path string, {ps}"), "projections")
    ends = F.array(F.lit(0.5 - spill), F.lit(0.5 + spill))
    q = rows.groupBy("tree", "path").agg(*(F.percentile_approx(f"p{i}", ends, 1000).alias(f"q{i}") for i in range(cuts)))
    q = q.join(maybe_broadcast(nodes, n_nodes, 128), ["tree", "path"])
    out = rows.join(maybe_broadcast(q, n_nodes, 256), ["tree", "path"])
    for i in range(cuts):
        p, lo, hi = F.col(f"p{i}"), F.col(f"q{i}")[0], F.col(f"q{i}")[1]
        side = F.array_compact(F.array(F.when(p <= hi, F.lit("0")), F.when(p >= lo, F.lit("1"))))
        out = out.withColumn(f"s{i}", F.explode(F.when(F.col("cuts") > i, side).otherwise(F.array(F.lit("")))))
    out = written(out.select("node", "tree", F.concat("path", *(f"s{i}" for i in range(cuts))).alias("path"), F.col("n").alias("was")), "forest")
    discard(rows)
    return out


def _dealt(state: DataFrame, stuck: DataFrame, n_stuck: int) -> DataFrame:
    """The rows of nodes (tree, path, n, hands) that cuts do not part, dealt into hands by a hash."""
    rows = state.join(maybe_broadcast(stuck, n_stuck, 128), ["tree", "path"])
    order = F.xxhash64("node", "tree", "path")
    # the hash is even, so that PIVOTS rows or so lie below the bound; they go to every hand
    bound = F.lit(-(2.0**63)) + F.lit(2.0**64) * PIVOTS / F.col("n")
    hands = F.when(order < bound, F.sequence(F.lit(0), F.col("hands") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(1)), F.col("hands")).cast("int")))
    dealt = rows.select("node", "tree", "path", F.explode(hands).alias("hand"))
    return dealt.select("node", "tree", F.concat("path", F.lit("/"), F.col("hand").cast("string")).alias("path"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, local_trees: int = LOCAL_TREES, leaf: int = LEAF, spill: float = SPILL, local_bytes: int = LOCAL_BYTES, cuts: int = CUTS, seed: int = 20) -> DataFrame:
    """Edges (u, v) between nodes that unite all pairs found of vectors (node, vec: a unit vector as packed float32).
    Nodes must be distinct and vectors written."""
    every = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    dim = F.length("vec") / 4
    start = vectors.select("node", every, F.concat(dim.cast("int").cast("string"), F.lit(":")).alias("path"), "vec")
    state, ready = None, []
    while True:
        rows = start if state is None else state
        sizes = rows.groupBy("tree", "path").agg(F.count("*").alias("n"), (F.lit(None).cast("long") if state is None else F.max("was")).alias("was"))
        bytes_ = F.col("n") * F.substring_index("path", ":", 1).cast("long") * 4
        sizes = sizes.withColumn("over", bytes_ / F.lit(local_bytes)).where("over > 1")
        sizes = written(sizes.withColumn("stuck", F.coalesce(F.col("n") > STUCK * F.col("was"), F.lit(False))), "large-nodes")
        n_large = sizes.count()
        if not n_large:
            ready.append(rows.select("node", "tree", "path"))
            break
        ready.append(rows.join(maybe_broadcast(sizes.select("tree", "path"), n_large, 64), ["tree", "path"], "left_anti").select("node", "tree", "path"))
        stuck = sizes.where("stuck").select("tree", "path", "n", F.ceil("over").cast("int").alias("hands"))
        n_stuck = stuck.count()
        if n_stuck:
            ready.append(_dealt(rows.select("node", "tree", "path"), stuck, n_stuck))
        if n_stuck == n_large:
            break
        large = sizes.where("not stuck").select("tree", "path", "n", F.least(F.lit(cuts), F.ceil(F.log2("over"))).cast("int").alias("cuts"))
        rows = rows.join(maybe_broadcast(large.select("tree", "path"), n_large, 64), ["tree", "path"], "left_semi")
        state = _cut(rows if state is None else rows.join(vectors, "node"), large, n_large, cuts, spill, seed)
    nodes = ready[0]
    for r in ready[1:]:
        nodes = nodes.union(r)
    # nodes of different sizes are even tasks of vectors' bytes at most
    nodes = nodes.join(vectors, "node")

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree, path = key
        v = np.frombuffer(b"".join(part["vec"]), np.float32).reshape(len(part), -1)
        edges = links(v, threshold, local_trees, leaf, spill, np.random.default_rng([seed + 1, tree, zlib.crc32(path.encode())]))
        name = part["node"].to_numpy()
        at = np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": name[at[:, 0]], "v": name[at[:, 1]]})

    return nodes.groupBy("tree", "path").applyInPandas(compare, "u long, v long")


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", **forest: float) -> DataFrame:
    """Operator 10. One row for each row of vectors, repeated rows included: id_col, class_id (the least id of its
    group), n_links (the other rows of the group). Vectors are in one group if a chain of pairs of at least threshold
    cosine, found in some leaf, links them; those of one direction always are. Null ids count as rows; class_id is
    null if the group has no other.

    Null, empty and zero vectors, and those with a null or non-finite part, have no direction: equal ones are one
    group and are compared with no other. Vectors of different lengths are never compared.
    """
    rows = _units(vectors, id_col, vec_col)
    same = rows.groupBy("key", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    same = written(same.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    root = components(near_vectors(same.where("vec is not null").select("node", "vec"), threshold, **forest), "near-vectors")
    of = same.select("key", "node", "least", "n").join(root, "node", "left").select("key", F.coalesce("root", "node").alias("root"), "least", "n")
    of = written(of, "vector-groups")
    groups = written(of.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("rows"), F.count("*").alias("keys")), "vector-classes")
    classes = written(join_hot(of.select("key", "root", "n"), groups, "root", "keys").select("key", "class_id", "rows", "n"), "key-classes")
    return join_hot(rows.select("id", "key"), classes, "key", "n").select(F.col("id").alias(id_col), "class_id", (F.col("rows") - 1).alias("n_links"))

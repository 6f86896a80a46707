"""Operator 2, conflict-constrained best-fit packing of documents into fixed-size training sequences.

Best fit is a sequential algorithm, so the corpus is cut into shards of a bounded number of documents by a hash, and
each shard is packed on its own: only ids, sources, clusters and lengths travel, never texts. Within a shard the
longest document comes first. Open bins are ordered by what room they have left; each carries a bitmap of the sources
and one of the duplicate clusters it holds, and a document goes to the tightest bin that has neither its source nor
its cluster.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import est_tokens, free, text_key, written

CAPACITY = 4096
#: Documents packed together; a constant, so that the size of a shard does not follow the corpus.
SHARD_DOCS = 20_000


class Bins:
    """Open bins of one shard. For each room (tokens left) the bins by their source bitmap, in order of age.

    open_ has bit r set if a bin has room r; full[s] has it set if all those bins hold source s. The rooms to look at
    for a document of source s and n tokens are the bits of open_ & ~full[s] from n up: the successor search jumps
    over every room where the source alone rules all bins out.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.rooms: dict[int, dict[int, list[int]]] = {}
        self.count: dict[int, int] = {}
        self.holding: dict[int, Counter] = {}  # room -> source -> bins that hold it
        self.open_ = 0
        self.full: dict[int, int] = {}
        self.sources: list[int] = []  # bitmaps by bin
        self.clusters: list[int] = []

    def _settle(self, room: int, sources: Iterable[int]) -> None:
        bit = 1 << room
        n = self.count.get(room, 0)
        self.open_ = self.open_ | bit if n else self.open_ & ~bit
        held = self.holding.get(room, {})
        for s in sources:
            f = self.full.get(s, 0)
            if n and held.get(s, 0) == n:
                self.full[s] = f | bit
            elif f & bit:
                self.full[s] = f & ~bit

    @staticmethod
    def _bits(mask: int) -> list[int]:
        out = []
        while mask:
            low = mask & -mask
            out.append(low.bit_length() - 1)
            mask ^= low
        return out

    def _move(self, b: int, room: int, by: int) -> None:
        """Puts bin b in (by 1) or takes it from (by -1) the bins with that room."""
        mask = self.sources[b]
        held = self.holding.setdefault(room, Counter())
        ages = self.rooms.setdefault(room, {}).setdefault(mask, [])
        if by > 0:
            bisect.insort(ages, b)
        else:
            del ages[bisect.bisect_left(ages, b)]
            if not ages:
                del self.rooms[room][mask]
        self.count[room] = self.count.get(room, 0) + by
        own = self._bits(mask)
        before = list(held)
        for s in own:
            held[s] += by
            if not held[s]:
                del held[s]
        self._settle(room, {*before, *own})

    def find(self, n: int, source: int, cluster: int | None) -> tuple[int, int] | None:
        """(bin, room) of the tightest bin that fits; the oldest of equally tight ones."""
        rooms = (self.open_ & ~self.full.get(source, 0)) >> n << n
        while rooms:
            low = rooms & -rooms
            room = low.bit_length() - 1
            best = None
            for mask, ages in self.rooms[room].items():
                if not mask >> source & 1:
                    b = ages[0] if cluster is None else next((b for b in ages if not self.clusters[b] >> cluster & 1), None)
                    if b is not None and (best is None or b < best):
                        best = b
            if best is not None:
                return best, room
            rooms ^= low
        return None

    def put(self, n: int, source: int, cluster: int | None) -> tuple[int, int]:
        """(bin, offset) that the document gets."""
        found = self.find(n, source, cluster)
        if found:
            b, room = found
            self._move(b, room, -1)
        else:
            b, room = len(self.sources), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= 1 << source
        if cluster is not None:
            self.clusters[b] |= 1 << cluster
        if room > n:  # a full bin is closed
            self._move(b, room - n, 1)
        return b, self.capacity - room


def pack_shard(docs: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Packs rows (doc_id, src, cluster, n_tokens). A document of more than capacity tokens fills bins of its own with
    its full pieces; the rest is packed like a document."""
    # rows that are equal in all of these are interchangeable
    d = docs.sort_values(["doc_id", "src", "cluster", "n_tokens"], kind="stable", na_position="last")
    rest = d["n_tokens"] % capacity
    d = d.iloc[(-rest).argsort(kind="stable")]
    source = {s: i for i, s in enumerate(pd.unique(d["src"]))}
    often = d["cluster"].value_counts()
    cluster = {c: i for i, c in enumerate(often.index[often > 1])}  # a cluster of one never conflicts
    bins, out, whole = Bins(capacity), [], []
    for i, (src, c, total) in enumerate(zip(d["src"], d["cluster"], d["n_tokens"])):
        pieces, left = divmod(total, capacity)
        whole += [(i, p, capacity) for p in range(pieces)]
        if left:
            b, offset = bins.put(left, source[src], cluster.get(c))
            out.append((i, pieces, b, offset, left))
    first = len(bins.sources)
    out += [(i, p, first + k, 0, n) for k, (i, p, n) in enumerate(whole)]
    o = pd.DataFrame(out, columns=["at", "piece", "bin", "bin_offset", "n_tokens"])
    o.insert(0, "doc_id", d["doc_id"].to_numpy()[o["at"]] if len(o) else pd.Series(dtype=object))
    return o.drop(columns="at")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, cluster_col: str | None = None, tokens_col: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Operator 2. One row for each piece of each row of docs: doc_id, piece (from 0), first_token, n_tokens, shard,
    bin (within the shard), bin_offset.

    cluster_col names the duplicate cluster; by default it is the text itself, so that equal texts never share a
    bin. groups instead gives the cluster of each (doc_id, text) as (doc_id, key, root), key being its text_key, at most
    once each; where root is null or missing it is the text itself. A null cluster conflicts with nothing, a
    null source is a source of its own. tokens_col names exact lengths; by default they are estimated from the text. Rows of no tokens (null and empty texts) get no piece. Repeated rows
    are packed as often as they occur. An empty table gives no rows.
    """
    if groups is not None and cluster_col is not None:
        raise ValueError("clusters come from cluster_col or from groups, not from both")
    text = F.col("text")
    n = est_tokens(text) if tokens_col is None else F.coalesce(F.col(tokens_col).cast("long"), F.lit(0))
    cluster = text_key(text) if cluster_col is None else F.when(F.col(cluster_col).isNotNull(), F.xxhash64(F.col(cluster_col).cast("string")))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("?")).alias("src"), cluster.alias("cluster"), n.alias("n_tokens"), F.xxhash64("doc_id", text).alias("h")).where("n_tokens > 0")
    if groups is not None:  # only keys and lengths are joined, no texts
        g = groups.where("root is not null").select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key"), F.xxhash64("root").alias("g_root"))
        rows = rows.join(g, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("cluster") == F.col("g_key")), "left")
        rows = rows.select("doc_id", "src", F.coalesce("g_root", "cluster").alias("cluster"), "n_tokens", "h")
    rows = written(rows, "lengths")
    shards = max(1, -(-rows.count() // shard_docs))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        o = pack_shard(part, capacity)
        o.insert(0, "shard", key[0])
        return o

    sharded = rows.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.col("doc_id").cast("string").alias("doc_id"), "src", F.col("cluster").cast("string").alias("cluster"), "n_tokens")
    out = sharded.groupBy("shard").applyInPandas(run, "shard int, doc_id string, piece long, bin long, bin_offset long, n_tokens long")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "piece", (F.col("piece") * capacity).alias("first_token"), "n_tokens", "shard", "bin", "bin_offset")

"""Operator 3, document fingerprints: SimHash with permuted block tables. Operator 6 builds on the same pieces.

A document's terms are its distinct lower-cased words, cut at white space and stripped of punctuation. A term's hash
is its MD5, read as signed bits; its weight is its length clamped to 1..8, so that short function words, which
unrelated documents share, count little. Bit i of the fingerprint is 1 where the weighted votes for it are positive. A
document without a word has no fingerprint.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import free, join_hot, maybe_broadcast, written

#: Cut from both ends of a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡"
MAX_WEIGHT = 8
#: Term hashes that a worker keeps; the table is emptied when full (a matter of speed alone).
CACHED_TERMS = 400_000
#: Terms expanded to bits at a time.
CHUNK = 1 << 13


class Terms(dict):
    """By token, as it stands in a text, the MD5 of its term and the term's weight; b"" where no term is left. Worked
    out when first asked for."""

    def __missing__(self, token: str) -> bytes:
        term = token.strip(EDGES)
        if term != token:
            r = self[term]
        else:
            r = hashlib.md5(term.encode("utf-8", "surrogatepass")).digest() + bytes([min(len(term), MAX_WEIGHT)]) if term else b""
        self[token] = r
        return r


def _votes(rows: np.ndarray) -> np.ndarray:
    total = np.zeros(128)
    for at in range(0, len(rows), CHUNK):  # sums below 2 ** 24 are exact
        part = rows[at : at + CHUNK]
        total += part[:, 16].astype(np.float32) @ np.unpackbits(part[:, :16], axis=1).astype(np.float32)
    return 2 * total - rows[:, 16].sum(dtype=np.float64)


def fingerprint(text: str | None, known: Terms | None = None) -> bytes | None:
    """The 128 bits of a text as 16 bytes; None without a word. The first 64 are a fingerprint of their own."""
    if not text:
        return None
    known = Terms() if known is None else known
    if len(known) > CACHED_TERMS:
        known.clear()
    terms = set(map(known.__getitem__, set(text.lower().split())))
    terms.discard(b"")
    if not terms:
        return None
    return np.packbits(_votes(np.frombuffer(b"".join(terms), np.uint8).reshape(-1, 17)) > 0).tobytes()


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """carry columns and fp (binary of 16) of every row; fp is null where the text is null or has no word."""
    fields = docs.select(*carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), known) for t in b.column(len(carry))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], fps], names=[*carry, "fp"])

    schema = ", ".join(f"`{n}` {t}" for n, t in fields.dtypes) + ", fp binary"
    return docs.select(*carry, F.col(text_col).alias("_body")).mapInArrow(run, schema)


def combos(blocks: int, match: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(blocks), match))


def block_values(fps: np.ndarray, blocks: int) -> np.ndarray:
    """(n, blocks) numbers from (n, bytes) fingerprints; every block has bytes * 8 / blocks bits: 4, 8 or 16."""
    width = fps.shape[1] * 8 // blocks
    if width == 8:
        return fps
    if width == 16:
        return fps.reshape(len(fps), -1, 2)[:, :, 0].astype(np.uint16) << 8 | fps.reshape(len(fps), -1, 2)[:, :, 1]
    if width == 4:
        return np.stack([fps >> 4, fps & 15], axis=2).reshape(len(fps), -1)
    raise ValueError("blocks of 4, 8 or 16 bits only")


@dataclass(frozen=True)
class Tables:
    """The permuted tables of fingerprints of nbytes: one for each choice of match of the blocks, which are its key.

    Two fingerprints that differ in at most sure = blocks - match bits share the key of some table (pigeonhole). A key
    with more than most fingerprints is not compared as it is: the bits that are not in the key are cut into radius + 1
    parts, of which a pair within the radius shares one, and each part makes a longer key. So keys grow with the corpus
    and hot ones are split. A longer key that is still too large belongs to fingerprints that are close to each other:
    its rows are dealt into chunks of most rows, and every two chunks are compared somewhere. No pair within the radius
    that shares a key gets lost by either, so what is found does not depend on most.
    """

    nbytes: int
    blocks: int
    match: int
    radius: int
    most: int = 4096

    @property
    def sure(self) -> int:
        return self.blocks - self.match

    def keys(self, raw: np.ndarray) -> np.ndarray:
        """(tables, n): the keys of n fingerprints; a key holds the table and the match blocks in front."""
        width, choices = self.nbytes * 8 // self.blocks, combos(self.blocks, self.match)
        if len(choices) > 256:
            raise ValueError("at most 256 tables")
        v = block_values(raw, self.blocks).astype(np.int64)
        keys = np.empty((len(choices), len(raw)), np.int64)
        for t, c in enumerate(choices):
            k = np.full(len(raw), t, np.int64)
            for j in c:
                k = k << width | v[:, j]
            keys[t] = k
        return keys

    def table(self, key: np.ndarray) -> np.ndarray:
        return key >> (self.match * (self.nbytes * 8 // self.blocks))

    def own(self, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the table is the first of those that the fingerprints a and b share."""
        same = block_values(a ^ b, self.blocks) == 0
        lead = np.array(combos(self.blocks, self.match), np.int64)
        return (np.argsort(~same, axis=1, kind="stable")[:, : self.match] == lead[table]).all(axis=1)

    def longer(self, key: int, raw: np.ndarray) -> Iterator[np.ndarray]:
        """For each part, the longer keys of the fingerprints of one key. They are mixed to 64 bits; if two should meet,
        strangers are compared, no more."""
        width = self.nbytes * 8 // self.blocks
        used = combos(self.blocks, self.match)[key >> (self.match * width)]
        rest = np.array([b for b in range(self.nbytes * 8) if b // width not in used])
        bits = np.unpackbits(raw, axis=1)
        for j, at in enumerate(np.array_split(rest, self.radius + 1)):
            value = bits[:, at].astype(np.uint64) @ (np.uint64(1) << np.arange(len(at), dtype=np.uint64))
            x = value + np.uint64((key * 0x9E3779B97F4A7C15 + (j + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            yield (x ^ x >> np.uint64(31)).view(np.int64)


@dataclass(frozen=True)
class Balls:
    """Keys that any two fingerprints of nbytes within radius bits share, however far the radius.

    The bits are cut into radius // 3 + 1 blocks or more, so such a pair differs in at most 2 bits of some block, and
    some value is within 1 bit of both its values there. The keys of a fingerprint are its blocks' values and those at 1
    bit from them, with the number of the block: nbytes * 8 + blocks keys. A key with more than most fingerprints is
    dealt into chunks, every two of which are compared somewhere.
    """

    nbytes: int
    radius: int
    most: int = 4096

    #: The number of a block stands above its value.
    SHIFT = 32

    @property
    def cuts(self) -> np.ndarray:
        """The first bit of each block, and the end."""
        bits = self.nbytes * 8
        blocks = min(bits, max(self.radius // 3 + 1, -(-bits // self.SHIFT)))
        return np.arange(blocks + 1) * bits // blocks

    def _shifts(self) -> np.ndarray:
        """(words, 3, blocks): how far right, then left, a word is shifted to give its part of a block, and that part's mask."""
        found = np.zeros((self.nbytes // 8, 3, len(self.cuts) - 1), np.uint64)
        for k, (begin, end) in enumerate(itertools.pairwise(self.cuts.tolist())):
            for i in range(len(found)):
                lo, hi = max(begin, 64 * i), min(end, 64 * i + 64)
                if lo < hi:
                    found[i, :, k] = 64 * i + 64 - hi, end - hi, ((1 << (hi - lo)) - 1) << (end - hi)
        return found

    @staticmethod
    def _words(raw: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(raw).view(">u8").astype(np.uint64).T

    def keys(self, raw: np.ndarray) -> np.ndarray:
        """(keys, n): the keys of n fingerprints."""
        words, found, shifts = self._words(raw), [], self._shifts()
        for k, width in enumerate(np.diff(self.cuts)):
            value = sum((w >> s[0] << s[1]) & s[2] for w, s in zip(words, shifts[:, :, k])).view(np.int64)
            own = k << self.SHIFT | value
            found += [own, *(own ^ (1 << j) for j in range(width))]
        return np.stack(found)

    def table(self, key: np.ndarray) -> np.ndarray:
        return key

    def own(self, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the key is the one to tell of the fingerprints a and b: in their first block with at most 2 bits of
        difference, what both values have, with the lower of the bits that one value has more, if it has two."""
        block, shifts = table >> self.SHIFT, self._shifts()
        differ = self._words(a ^ b)
        found = np.ones(len(a), bool)
        for k in range(len(self.cuts) - 2):
            apart = sum(np.bitwise_count(w & (s[2] >> s[1] << s[0])) for w, s in zip(differ, shifts[:, :, k]))
            found &= (block <= k) | (apart > 2)
        at = np.flatnonzero(found)
        block = block[at]
        x, y = (sum((w >> s[0, block] << s[1, block]) & s[2, block] for w, s in zip(self._words(r[at]), shifts)).view(np.int64) for r in (a, b))
        e = x ^ y
        two = (np.bitwise_count(x & e) == 2) | (np.bitwise_count(y & e) == 2)
        found[at] = table[at] == (block << self.SHIFT | x & y | np.where(two, e & -e, 0))
        return found

    def longer(self, key: int, raw: np.ndarray) -> Iterator[np.ndarray]:
        """The key itself: its rows are dealt into chunks."""
        yield np.full(len(raw), key, np.int64)


def packed(raw: np.ndarray) -> pa.Array:
    """(n, bytes) fingerprints as a binary column."""
    ends = np.arange(len(raw) + 1, dtype=np.int32) * np.int32(raw.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])


def unpacked(col: pa.Array, nbytes: int) -> np.ndarray:
    """(n, nbytes) fingerprints from a binary column without nulls."""
    if not len(col):
        return np.empty((0, nbytes), np.uint8)
    _, ends, data = (col := col.cast(pa.binary())).buffers()
    begin = int(np.frombuffer(ends, np.int32)[col.offset])
    return np.frombuffer(data, np.uint8)[begin : begin + len(col) * nbytes].reshape(-1, nbytes)


def block_tables(fps: DataFrame, tables: Tables | Balls) -> DataFrame:
    """For each row of fps (fp, and asked if it is there), one row for each of its keys."""
    more = ["asked"] if "asked" in fps.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 2048) for i in range(0, b.num_rows, 2048)):
                raw = unpacked(part.column(0), tables.nbytes)
                keys = tables.keys(raw)
                cols = [pa.array(keys.ravel()), packed(np.tile(raw, (len(keys), 1)))]
                cols += [pa.array(np.tile(part.column(1).to_numpy(zero_copy_only=False), len(keys)), pa.bool_())] if more else []
                yield pa.RecordBatch.from_arrays(cols, names=["key", "fp", *more])

    return fps.select("fp", *more).mapInArrow(run, "key long, fp binary" + ", asked boolean" * len(more))


@dataclass
class _Piece:
    """Rows sorted by key. table is None at first, where the key tells it."""

    key: np.ndarray
    raw: np.ndarray
    table: np.ndarray | None
    asked: np.ndarray | None

    def take(self, at: slice | np.ndarray) -> _Piece:
        return _Piece(self.key[at], self.raw[at], None if self.table is None else self.table[at], None if self.asked is None else self.asked[at])

    @staticmethod
    def joined(pieces: list[_Piece]) -> _Piece:
        def cat(of: str) -> np.ndarray | None:
            found = [getattr(p, of) for p in pieces]
            return None if found[0] is None else np.concatenate(found)

        return _Piece(cat("key"), cat("raw"), cat("table"), cat("asked"))

    @staticmethod
    def read(b: pa.RecordBatch, nbytes: int) -> _Piece:
        raw = unpacked(b.column("fp"), nbytes)
        table = b.column("tab").to_numpy() if "tab" in b.schema.names else None
        asked = b.column("asked").to_numpy(zero_copy_only=False).astype(bool) if "asked" in b.schema.names else None
        return _Piece(b.column("key").to_numpy(), raw, table, asked)


def _pieces(batches: Iterator[pa.RecordBatch], nbytes: int, most: int) -> Iterator[tuple[_Piece, bool]]:
    """From batches sorted by key, pieces that cut no key in two, and those of keys with more than most rows (True), one
    key at a time and bit by bit. No more than most rows and a batch are held at a time."""
    open_: list[_Piece] = []
    hot = None
    for b in batches:
        if not b.num_rows:
            continue
        p = _Piece.read(b, nbytes)
        if hot is not None:
            n = int(np.searchsorted(p.key, hot, side="right"))
            if n:
                yield p.take(slice(0, n)), True
            if n == len(p.key):
                continue
            p, hot = p.take(slice(n, None)), None
        p = _Piece.joined([*open_, p])
        starts = np.flatnonzero(np.r_[True, p.key[1:] != p.key[:-1]])
        ends = np.r_[starts[1:], len(p.key)]
        open_ = [p.take(slice(starts[-1], None))]
        large = np.flatnonzero(ends - starts > most)
        for i in large:
            yield p.take(slice(starts[i], ends[i])), True
        if len(large) and large[-1] == len(starts) - 1:
            hot, open_ = p.key[-1], []
        small = np.repeat(ends - starts <= most, ends - starts) & (np.arange(len(p.key)) < starts[-1])
        if small.any():
            yield p.take(small), False
    if open_:
        yield open_[0], False


def close_in_tables(p: _Piece, tables: Tables | Balls, step: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of rows with equal key, each pair in one only of the keys that it shares. If rows are marked as
    asked, i is such a row and j any other; else i < j."""
    words = np.ascontiguousarray(np.ascontiguousarray(p.raw).view(np.uint64).reshape(len(p.raw), -1).T)
    table = tables.table(p.key) if p.table is None else p.table
    starts = np.flatnonzero(np.r_[True, p.key[1:] != p.key[:-1]])
    sizes = np.diff(np.r_[starts, len(p.key)])

    # row by row, the rows that it is compared with: size of them from begin on
    if p.asked is None:
        ask = np.arange(len(p.key))
        begin = ask + 1
        size = np.repeat(starts + sizes, sizes) - begin
    else:
        ask = np.flatnonzero(p.asked)
        begin, size = np.repeat(starts, sizes)[ask], np.repeat(sizes, sizes)[ask]
    upto = np.cumsum(size)
    at = 0
    while at < len(ask):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, side="right")))
        n = size[at:to]
        b = np.arange(n.sum()) + np.repeat(begin[at:to] - np.cumsum(n) + n, n)
        d = np.bitwise_count(words[0][b] ^ np.repeat(words[0][ask[at:to]], n))
        near = np.flatnonzero(d <= tables.radius)
        a, b, d = ask[at + np.searchsorted(np.cumsum(n), near, side="right")], b[near], d[near]
        for w in words[1:]:
            d = d + np.bitwise_count(w[a] ^ w[b])
        near = (d <= tables.radius) & (a != b)
        a, b, d = a[near], b[near], d[near]
        own = tables.own(table[a], p.raw[a], p.raw[b])
        if own.any():
            yield a[own], b[own], d[own]
        at = to


#: What a task finds: pairs, and rows that go on: their next key, table, and chunk of a key that is dealt out.
FOUND = "u binary, v binary, distance int, key long, tab long, fp binary, asked boolean, chunk int"


def _matched(fps: DataFrame, tables: Tables | Balls, forest: bool) -> DataFrame:
    """(u, v, distance) of the close pairs of all tables. With forest, only so many as join the same fingerprints within
    each piece."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int32()]

    def batch(**cols: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([cols[c].cast(k) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

    def thinned(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        root = np.arange(n)
        for a, b, d in pairs:
            kept = []
            for at, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
                while root[i] != i:
                    root[i] = i = root[root[i]]
                while root[j] != j:
                    root[j] = j = root[root[j]]
                if i != j:
                    root[max(i, j)] = min(i, j)
                    kept.append(at)
            yield a[kept], b[kept], d[kept]

    def hot_rows(p: _Piece, seen: int) -> Iterator[pa.RecordBatch]:
        """Rows of one too large key, of which seen rows came before."""
        cols = {"fp": packed(p.raw)} | ({} if p.asked is None else {"asked": pa.array(p.asked)})
        if p.table is not None:
            yield batch(key=pa.array(p.key), tab=pa.array(p.table), chunk=pa.array((np.arange(len(p.key)) + seen) // tables.most), **cols)
            return
        key = int(p.key[0])
        tab = pa.array(tables.table(p.key))
        for keys in tables.longer(key, p.raw):
            yield batch(key=pa.array(keys), tab=tab, **cols)

    def level(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, seen = None, 0
            for p, hot in _pieces(batches, tables.nbytes, most):
                if hot:
                    seen = seen if p.key[0] == last else 0
                    yield from hot_rows(p, seen)
                    last, seen = p.key[0], seen + len(p.key)
                    continue
                pairs = close_in_tables(p, tables)
                for a, b, d in thinned(pairs, len(p.key)) if forest else pairs:
                    if len(a):
                        yield batch(u=packed(p.raw[a]), v=packed(p.raw[b]), distance=pa.array(d.astype(np.int32)))

        done = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND), "near-in-tables")
        return done.where("u is not null").select("u", "v", "distance"), done.where("key is not null")

    more = [c for c in ("asked",) if c in fps.columns]
    first, large = level(block_tables(fps, tables), tables.most)
    if large.isEmpty():
        return first
    second, large = level(large.select("key", "tab", "fp", *more), tables.most)
    if not large.isEmpty():
        chunks = written(large.groupBy("key").agg(F.max("chunk").alias("end")), "hot-keys")
        dealt = large.join(maybe_broadcast(chunks, chunks.count(), 32), "key").select("*", F.explode(F.sequence(F.lit(0), F.col("end"))).alias("other"))
        both = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
        second = second.union(level(dealt.select(both.alias("key"), "tab", "fp", *more), 2 * tables.most)[0])
    # a pair may share several parts of a key that was split, and several pairs of chunks
    return first.union(second.distinct())


def near_pairs(fps: DataFrame, tables: Tables | Balls) -> DataFrame:
    """(u, v, distance): all pairs of the distinct fps that share a key and differ in at most radius bits: with Balls all
    within the radius; with Tables too, if that is no more than tables.sure. With a column asked in fps, u is a fingerprint that is
    asked for and v any other; else every pair comes once, in either order."""
    return _matched(fps, tables, forest=False)


def near_edges(fps: DataFrame, tables: Tables | Balls) -> DataFrame:
    """(u, v) that join the same fps as near_pairs does, thinned to a spanning forest within each piece of a table:
    a group of m close fingerprints gives at most m - 1 edges there and not m * (m - 1) / 2."""
    return _matched(fps.select("fp"), tables, forest=True).select("u", "v")


def fingerprint_search(docs: DataFrame, asked: Column, radius: int = 6, blocks: int = 8, match: int = 2, text_col: str = "text") -> DataFrame:
    """Operator 3. docs: doc_id, text; other columns are ignored. asked: which rows are queries, searched for among all
    rows. doc_id, fingerprint (16 hex digits), same_id, near_id, distance:

    Membership: one row for each row of docs, repeated rows included, with the least doc_id of that fingerprint in
    same_id, and null in near_id and distance. Answers: for each fingerprint of a query and each other fingerprint
    within radius bits, one row from representative to representative: doc_id = same_id, near_id the same_id of the
    other, distance in bits. So all documents near a query are those whose same_id is a near_id of its same_id, or its
    same_id itself.
    A null or wordless text has null in all but doc_id; a null doc_id stands for no document in same_id and near_id.
    The 64-bit fingerprint is cut into 8-bit blocks; any two within radius 6 agree in 2 of the 8, so 28 tables sorted
    by two leading blocks find every pair. Documents with equal fingerprints are searched once.
    """
    tables = Tables(8, blocks, match, radius)
    if tables.sure < radius:
        raise ValueError("radius is beyond what these tables are sure to find: it must be at most blocks - match")
    flag, = free(docs, "asked")
    marked = docs.withColumn(flag, F.coalesce(asked, F.lit(False)))
    rows = fingerprints(marked, ["doc_id", flag], text_col).select("doc_id", F.col(flag).alias("asked"), F.substring("fp", 1, 8).alias("fp"))
    rows = written(rows, "fingerprints")
    same = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("same_id"), F.count("*").alias("n"), F.max("asked").alias("asked"))
    same = written(same, "distinct-fingerprints")
    hexed = F.lower(F.hex("fp")).alias("fingerprint")
    none = (F.lit(None).cast(docs.schema["doc_id"].dataType).alias("near_id"), F.lit(None).cast("int").alias("distance"))
    members = join_hot(rows.select("doc_id", "fp"), same.select("fp", "same_id", "n"), "fp", "n").select("doc_id", hexed, "same_id", *none)
    near = near_pairs(same.select("fp", "asked"), tables)
    ids = same.where("same_id is not null").select("fp", "same_id")
    near = near.join(ids.select(F.col("fp").alias("v"), F.col("same_id").alias("near_id")), "v").join(ids.select(F.col("fp").alias("u"), "same_id"), "u")
    return members.unionByName(near.select(F.col("same_id").alias("doc_id"), F.lower(F.hex("u")).alias("fingerprint"), "same_id", "near_id", "distance"))


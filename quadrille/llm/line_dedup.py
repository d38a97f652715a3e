"""Line dedup with sharded cuckoo filters over exact reference-count tables.

The index holds, for each line key, in how many documents it stands (the exact reference counts), and for each shard of
keys a cuckoo filter of those that reach ``min_docs``.  Both take insertions and deletions of documents, so that taking a
batch out again restores the earlier state.  To clean documents, the keys of their lines are sent to their shards, the
shard's filter passes those that may be repeated, the exact table confirms them, and the documents drop them.  That is
the way of every key; a shard with a very common key is worked on in several parts.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case; a key is counted once for
each document (row).  Empty keys are never dropped.

Defined cases: a null or empty text is one empty line.  Rows with the same doc_id are documents of their own; as a
repeated key leaves every document, they can't disturb one another.  A null doc_id is a document like others.  An empty
table gives an empty result.  Other columns are carried; input columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import materialise, short_batches

MIN_DOCS = 10
#: Aimed at number of (document, key) pairs in a shard, and the least number of shards.
SHARD_ROWS, LEAST_SHARDS = 100_000, 64
#: Of a key in at least one of HOT_SHARE pairs, and in more than an average shard holds, the rows are dealt out over parts
#: of its shard, each with the shard's filter.  There are HOT_SHARE such keys at most.
HOT_SHARE = 16384
#: Partial counts that a task holds before it sends them on.
HELD_COUNTS = 200_000
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """16 bytes for a line; empty for a line without a key."""
    key = line.strip(SPACE_BYTES).lower()
    return blake2b(key, digest_size=16).digest() if key else b""


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _halves(keys: pa.Array) -> np.ndarray:
    """(n, 2) unsigned halves of 16-byte keys."""
    return np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2)


class CuckooFilter:
    """A set of 16-byte keys with 16-bit fingerprints in buckets of four; supports deletion of keys that are in it."""

    SLOTS = 4

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * cls.SLOTS * 0.85 < keys:
            buckets *= 2
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def build(cls, halves: np.ndarray) -> CuckooFilter:
        room = max(4, len(halves))
        while True:
            made = cls.sized(room)
            if made.insert(halves):
                return made
            room *= 2

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _marks(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (halves[:, 0] >> np.uint64(48)).astype(np.uint16)
        return np.where(prints == 0, np.uint16(1), prints), (halves[:, 1] & self.mask)

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ ((prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & self.mask)

    def _settle(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; which of them found no room."""
        left = np.ones(len(prints), bool)
        for slot in range(self.SLOTS):
            free = np.flatnonzero(left & (self.table[at, slot] == 0))
            if len(free):
                _, first = np.unique(at[free], return_index=True)
                chosen = free[first]
                self.table[at[chosen], slot] = prints[chosen]
                left[chosen] = False
        return left

    def insert(self, halves: np.ndarray, rounds: int = 500) -> bool:
        """Add keys, each of which must not be in the set; False if there is no room, after which the filter is void."""
        prints, at = self._marks(halves)
        for k in range(rounds):
            left = self._settle(prints, at)
            prints, at = prints[left], at[left]
            if not len(prints):
                return True
            at = self._other(prints, at)
            left = self._settle(prints, at)
            prints, at = prints[left], at[left]
            if not len(prints):
                return True
            _, first = np.unique(at, return_index=True)  # one eviction a bucket and round
            slot = (first + k) % self.SLOTS
            evicted = self.table[at[first], slot].copy()
            self.table[at[first], slot] = prints[first]
            prints[first] = evicted
            at[first] = self._other(evicted, at[first])
        return False

    def delete(self, halves: np.ndarray) -> None:
        prints, at = self._marks(halves)
        for mark, one, two in zip(prints, at, self._other(prints, at), strict=True):
            for bucket in (one, two):
                if len(found := np.flatnonzero(self.table[bucket] == mark)):
                    self.table[bucket, found[0]] = 0
                    break

    def contains(self, halves: np.ndarray) -> np.ndarray:
        prints, at = self._marks(halves)
        return (self.table[at] == prints[:, None]).any(1) | (self.table[self._other(prints, at)] == prints[:, None]).any(1)


def reference_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key, n: the number of documents in which each line key stands.  Tasks send partial sums, so no key is hot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["key", "n"])
            held.clear()
            return out

        for batch in short_batches(batches):
            for text in _texts(batch, text_col):
                held.update({line_key(x) for x in text.split(b"\n")} - {b""})
                if len(held) >= HELD_COUNTS:
                    yield sent()
        if held:
            yield sent()

    return docs.select(text_col).mapInArrow(count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def changed(refs: DataFrame, docs: DataFrame, sign: int, text_col: str = "text") -> DataFrame:
    """The reference counts after inserting (sign 1) or deleting (sign -1) documents."""
    delta = reference_counts(docs, text_col).withColumn("n", F.col("n") * sign)
    return refs.unionByName(delta).groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


def build_filters(refs: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """shard, filter: a cuckoo filter of each shard's repeated keys."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        made = CuckooFilter.build(_halves(table["key"]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.dump()], pa.binary())})

    return refs.where(F.col("n") >= min_docs).select(_shard(shards), "key").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def changed_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """The filters after a change of the reference counts: keys that crossed ``min_docs`` are inserted or deleted.

    A filter that gets too full is built anew, at twice the size, from the exact table.
    """
    old = before.where(F.col("n") >= min_docs).select("key", F.lit(True).alias("was"))
    new = after.where(F.col("n") >= min_docs).select("key", F.lit(True).alias("is"))
    moves = old.join(new, "key", "full").select(_shard(shards), "key", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("is", F.lit(False)).alias("is"))

    def change(key: tuple[pa.Scalar, ...], have: pa.Table, moved: pa.Table) -> pa.Table:
        halves = _halves(moved["key"])
        was, now = moved["was"].to_numpy(), moved["is"].to_numpy()
        held = CuckooFilter.load(have["filter"][0].as_py()) if len(have) else CuckooFilter.sized(4)
        held.delete(halves[was & ~now])
        if not held.insert(halves[now & ~was]):
            held = CuckooFilter.build(halves[now])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([held.dump()], pa.binary())})

    return filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(change, "shard int, filter binary")


def _hot_keys(refs: DataFrame, pairs: int, shards: int, min_docs: int) -> dict[bytes, int]:
    """The number of parts for each key of which a shard would get too many rows; HOT_SHARE keys at most."""
    average = max(1, pairs // shards)
    bar = max(min_docs, average, pairs // HOT_SHARE)
    return {bytes(r.key): -(-r.n // average) for r in refs.where(F.col("n") > bar).select("key", "n").collect()}


def repeated_keys(docs: DataFrame, refs: DataFrame, filters: DataFrame, shards: int, hot: dict[bytes, int], min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """id, keys: for each document the keys that it has to drop.  hot: keys whose rows are dealt out, with the number of parts."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short_batches(batches):
            found = [sorted({line_key(x) for x in text.split(b"\n")} - {b""}) for text in _texts(batch, text_col)]
            ids = np.repeat(np.arange(len(found)), [len(x) for x in found])
            dealt = [crc32(repr(i).encode()) for i in batch.column(id_col).to_pylist()] if hot else [0] * len(found)
            parts = [dealt[k] % hot[x] if x in hot else 0 for k, line in enumerate(found) for x in line]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(ids)), pa.array([k for x in found for k in x], pa.binary()), pa.array(parts, pa.int32())], ["id", "key", "part"])

    def probe(key: tuple[pa.Scalar, ...], lines: pa.Table, have: pa.Table) -> pa.Table:
        lines = lines.select(["id", "key", "part"])
        if not len(have) or not len(lines):
            return lines.slice(0, 0)
        return lines.filter(pa.array(CuckooFilter.load(have["filter"][0].as_py()).contains(_halves(lines["key"]))))

    kind = docs.schema[id_col].dataType.simpleString()
    parts = F.broadcast(docs.sparkSession.createDataFrame([(bytearray(k), n) for k, n in hot.items()], "key binary, parts int"))  # HOT_SHARE rows at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)).alias("part")
    shared = filters.join(parts.select(_shard(shards), "parts").groupBy("shard").agg(F.max("parts").alias("parts")), "shard", "left").select("shard", "filter", every(F.col("parts")))
    lines = docs.select(id_col, text_col).mapInArrow(keys, f"id {kind}, key binary, part int").select("id", "key", "part", _shard(shards))
    passed = lines.groupBy("shard", "part").cogroup(shared.groupBy("shard", "part")).applyInArrow(probe, f"id {kind}, key binary, part int")
    exact = refs.where(F.col("n") >= min_docs).select("key").join(parts, "key", "left").select("key", every(F.col("parts")))
    sure = passed.join(exact, ["key", "part"], "left_semi")
    return sure.groupBy("id").agg(F.collect_set("key").alias("keys"))


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", index: tuple[DataFrame, DataFrame, int] | None = None) -> DataFrame:
    """The documents without repeated lines, with n_lines (before) and n_dropped.

    ``index`` is (reference counts, filters, shards) of an index kept elsewhere; else it is made from these documents.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    if index:
        refs, filters, shards = index
        pairs = refs.agg(F.sum("n")).first()[0] or 0
    else:
        refs = materialise(reference_counts(docs, text_col), "line-refs")
        pairs = refs.agg(F.sum("n")).first()[0] or 0
        shards = max(LEAST_SHARDS, -(-pairs // SHARD_ROWS))
        filters = build_filters(refs, shards, min_docs)
    drops = repeated_keys(docs, refs, filters, shards, _hot_keys(refs, pairs, shards, min_docs), min_docs, id_col, text_col)
    names = docs.columns
    drops = drops.select(F.col("id").alias("__dropped_from"), F.col("keys").alias("__dropped"))
    joined = docs.join(drops, F.col(f"`{id_col}`").eqNullSafe(F.col("__dropped_from")), "left").drop("__dropped_from")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short_batches(batches):
            kept, n_lines, n_dropped = [], [], []
            for text, keys in zip(_texts(batch, text_col), batch.column("__dropped").to_pylist(), strict=True):
                gone = set(keys or ())
                lines = text.split(b"\n")
                stay = [x for x in lines if line_key(x) not in gone]
                kept.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            columns = [pa.array(kept, pa.binary()).cast(pa.string()) if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(drop, T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))

"""Helpers the corpus operators share: staged tables, words and shingles of Arrow batches, linked groups."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from karavel.session import shared_folder
from karavel.sources.files import delete

CHUNK = 1 << 20  # bytes of text that numpy code works on at a time; a longer text is a chunk of its own
SPACES = b" \t\n\v\f\r"  # fixed values: the separators of words, \x20 and \x09-\x0D
IS_SPACE = np.isin(np.arange(256), list(SPACES))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


ROWS_PER_FILE = 50_000


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and survives executors.

    ``most`` is a number of narrow rows that the table is known not to exceed; few go to few files.
    Shuffle files of the write go when it ends; else they would stay on the executors' disks until the driver collects garbage.
    """
    conf = df.sparkSession.conf
    path, before = shared_folder(df.sparkSession, name), conf.get(CLEANUP, "false")
    df = df if most is None else df.coalesce(most // ROWS_PER_FILE + 1)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made of them is staged itself."""
    for df in staged:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def freed(run: Run) -> Run:
    """``run``, a function for mapInArrow, after which its worker gives back the memory that it doesn't use any more.

    Workers live on after a task, beside those of other stages, and else keep the most that they ever needed.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    global _powers, _inverse
    _powers, _inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def with_column(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of ``df`` with one column more."""
    return StructType([*df.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])


def sized(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A staged table, marked for broadcast only if it was counted to have few rows."""
    return F.broadcast(df) if df.count() <= limit else df


def text_key(text: str = "text") -> Column:
    """Tells texts of one doc_id apart. Rows that agree in doc_id and text count as one document."""
    return F.xxhash64(F.col(text))


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on salt only."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) * _ODD) | np.uint64(1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, and where each text begins and ends; null counts as empty."""
    if texts.type not in (pa.string(), pa.large_string()):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if texts.type == pa.large_string() else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, width, len(texts) + 1, texts.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``limit`` bytes."""
    _, off = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, CHUNK + 1)
        base, back = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        _powers, _inverse = np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _powers, _inverse


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end], which depends on the bytes only."""
    powers, inverse = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


class Words:
    """The words of some texts: ``starts`` and ``ends`` in ``buf``, ``first`` word of each text, ``hashes``."""

    def __init__(self, texts: pa.Array | tuple[np.ndarray, np.ndarray], lower: bool = False):
        self.buf, self.off = texts if isinstance(texts, tuple) else text_bytes(texts)
        if lower:
            self.buf = LOWER[self.buf]
        n = len(self.buf)
        word = ~IS_SPACE[self.buf]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        before = np.ones(n, bool)
        before[1:] = ~word[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~word[1:]
        self.starts = np.flatnonzero(word & (before | edge[:-1]))
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.off)
        self.hashes = span_hashes(self.buf, self.starts, self.ends)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a per-word array by text."""
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def windows(self, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words and the bounds of each text's part. ``short``: a text with fewer words has one run, all of them."""
        n = np.diff(self.first)
        runs = np.where(n >= k, n - k + 1, (n > 0) if short else 0)
        bounds = np.concatenate([[0], np.cumsum(runs)])
        at = np.arange(bounds[-1]) + np.repeat(self.first[:-1] - bounds[:-1], runs)
        end = np.repeat(self.first[1:], runs)
        h, odd = np.zeros(len(at), np.uint64), seeds(k, 77)
        padded = np.concatenate([self.hashes, np.zeros(k, np.uint64)])
        for i in range(k):
            part = padded[at + i] * odd[i]
            if short:
                part[at + i >= end] = 0
            h = mix(h + part)
        return h, bounds


def sorted_parts(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sort each part in place; returns where a value differs from the one before it in its part."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return new


def part_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of an edge list (a, b) of longs, as (id, root); ids without an edge are absent.

    Each round points every node at the neighbour (or itself) with the least hash, follows two pointers,
    and goes on with the edges between different ends. Hashes are in random order, so chains are short
    and the rounds grow with the logarithm of the number of nodes.
    """
    e = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    steps, n = [], e.count()
    while n:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        up = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select("a", F.least("least", rank("a"))["x"].alias("r"))
        up = sized(stage(up, name, 2 * n))
        second, third = up.select(F.col("a").alias("r"), F.col("r").alias("r2")), up.select(F.col("a").alias("r2"), F.col("r").alias("r3"))
        up = sized(stage(up.join(second, "r").join(third, "r2").select("a", F.col("r3").alias("r")), name, 2 * n))
        steps.append(up)
        left = up.select("a", F.col("r").alias("ra"))
        right = up.select(F.col("a").alias("b"), F.col("r").alias("rb"))
        ends = e.join(left, "a").join(right, "b").where("ra <> rb")
        e = stage(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), name, n)
        n = e.count()
    if not steps:
        return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    found = steps[0].select(F.col("a").alias("id"), F.col("r").alias("root"))
    for up in steps[1:]:
        found = found.join(up, found["root"] == up["a"], "left").select("id", F.coalesce("r", "root").alias("root"))
    return sized(stage(found, name) if len(steps) > 1 else found)


def merge_components(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``components`` of a graph after it got more edges; only those between different components are worked on."""
    left = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    right = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    ends = links.join(left, "a", "left").join(right, "b", "left")
    top = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), name)
    known = roots.join(top.select(F.col("id").alias("root"), F.col("root").alias("up")), "root", "left").select("id", F.coalesce("up", "root").alias("root"))
    new = top.join(roots.select("id"), "id", "left_anti").select("id", "root")
    return sized(stage(known.unionByName(new), name))


BLOCK = 4096  # members of a bucket that are compared in one piece once all pairs are tried
Side = Callable[[str], Column]  # gives a column of one of the two items of a pair
BIN = 1.05  # sizes up to so many times as large count as one


def linked_groups(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], name: str, bound: Callable[[DataFrame], DataFrame] | None = None, fits: Callable[[Side, Side], Column] | None = None, roots: DataFrame | None = None) -> DataFrame:
    """Groups of items linked through pairs that share a bucket and pass ``verify``, as (id, root).

    ``buckets``: bucket, id. ``verify`` takes distinct pairs (a, b) and returns those that are linked. Members are
    first tried against one member of their bucket, so a group of any size costs one pair a member. Buckets
    whose members all got into one group are finished. The others are tried against other members as long
    as that links many; in the end every pair between different groups is tried, so no link is lost.
    ``bound`` keeps these few: from (id, root) it makes (id, size, low, reach) of the items that may be linked with
    another group at all, which is only so if the size of each is from ``low`` to ``reach`` of the other, and if
    ``fits`` holds for the further columns of both. ``roots``: groups that are known; then members were tried against one already.
    """
    rows = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1").select("bucket", "pivot")
    members = stage(buckets.join(sized(stage(rows, name)), "bucket"), name)
    most = members.count()
    turn, last = 0 if roots is None else 1, False
    while True:
        if turn == 0:
            pairs = members.where("id <> pivot").select("id", F.col("pivot").alias("to"))
        else:
            named = stage(members.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root")), name, most)
            mixed = named.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
            mixed = sized(stage(mixed.where("low <> high").select("bucket", "n"), name, most))
            if mixed.isEmpty():
                return roots
            members = stage(named.join(mixed, "bucket"), name, most)
            if last:
                pairs = _pairs_between_groups(members, bound, fits, name)
            else:
                order = F.struct(F.xxhash64("id", "bucket", F.lit(turn)).alias("h"), F.col("id").alias("to"), F.col("root").alias("to_root"))
                pivots = sized(stage(members.groupBy("bucket").agg(F.min(order).alias("p")).select("bucket", "p.to", "p.to_root"), name, most))
                pairs = members.join(pivots, "bucket").where("root <> to_root").select("id", "to")
            members = members.select("bucket", "id")
        pairs = stage(pairs.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct(), name)
        more = stage(verify(pairs), name)
        found = more.count()
        if turn == 0:
            roots = components(more, name)
        elif found:
            roots = merge_components(roots, more, name)
        if last:
            return roots
        last = turn > 0 and 50 * found <= pairs.count()
        turn += 1


def _pairs_between_groups(members: DataFrame, bound: Callable[[DataFrame], DataFrame] | None, fits: Callable[[Side, Side], Column] | None, name: str) -> DataFrame:
    """All pairs (id, to) of a bucket whose groups differ and whose sizes allow a link, each once.

    Members meet by bucket, class of size and block of at most about BLOCK members, so one large bucket is many tasks' work.
    Those of a bucket's largest group (``main``) are only met, by all classes and blocks that the few others look in.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    if bound is None:
        members = members.withColumn("size", F.lit(1)).withColumn("low", F.lit(1)).withColumn("reach", F.lit(1))
    else:
        members = members.join(sized(stage(bound(members.select("id", "root").distinct()), name)), "id").where("low <= reach")
    bin_ = lambda c: F.floor(F.log(BIN, F.greatest(F.col(c), F.lit(1)))).cast("int")
    kept = [c for c in members.columns if c not in ("bucket", "id", "n")]
    groups = members.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("top"))
    main = sized(stage(groups.select("bucket", F.col("top.root").alias("main")), name))
    left = members.join(main, "bucket").where("root <> main").select("bucket", "id", "main", *kept, F.explode(F.sequence(bin_("low"), bin_("reach"))).alias("bin"), blocks.alias("blocks"))
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    to = [F.col(c).alias(f"to_{c}") for c in kept]
    right = members.select("bucket", F.col("id").alias("to"), *to, bin_("size").alias("bin"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    pairs = left.join(right, ["bucket", "bin", "block"]).where("root <> to_root and (to_root = main or id < to) and to_size between low and reach and size between to_low and to_reach")
    if fits is not None:
        pairs = pairs.where(fits(F.col, lambda c: F.col(f"to_{c}")))
    return pairs.select("id", "to")

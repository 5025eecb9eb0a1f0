"""Near copies of documents: SetSketch registers in bands, a joint likelihood estimate, then the full sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from karavel.llm.common import Side, Words, chunks, freed, linked_groups, mix, part_sums, seeds, sized, sorted_parts, stage, text_key

PARITY_WORDS = 16  # 64-bit words of parity bits by which sets are compared before their texts are
CACHE_ROWS = 1 << 14  # shingles hashed at a time, so that they stay in the processor's cache


@dataclass(frozen=True)
class SetSketch:
    """Registers floor(1 - log_base(least exponential value)), cut to 0..limit+1.

    Registers of a union are the larger ones of its parts. The chance that two sets agree in a register is
    about their Jaccard similarity for a base near 1. With the defaults, sets of similarity 0.8 share no band
    with a chance of 5e-8.
    """

    registers: int = 128
    rows: int = 4  # registers in a band
    base: float = 1.001
    rate: float = 20.0
    limit: int = 65534

    def of(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Registers (sets x registers, uint16) of parts of shingle hashes; those of an empty part are 0."""
        least = np.full((len(bounds) - 1, self.registers), np.iinfo(np.uint64).max, np.uint64)
        odd = seeds(self.registers, 6)
        cuts = [0]
        while cuts[-1] < len(bounds) - 1:  # whole parts up to the cache's size; a longer part alone
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + CACHE_ROWS, "right")) - 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            for x in range(int(bounds[a]), int(bounds[b]), CACHE_ROWS * 4):
                part = h[x : min(x + CACHE_ROWS * 4, int(bounds[b]))]
                full = np.flatnonzero((bounds[a + 1 : b + 1] > bounds[a:b])) + a
                full = full[(bounds[full + 1] > x) & (bounds[full] < x + len(part))]
                starts = np.maximum(bounds[full] - x, 0)
                for i in range(self.registers):
                    least[full, i] = np.minimum(least[full, i], np.minimum.reduceat(part * odd[i], starts))
        u = (least.astype(np.float64) + 1.0) / 2.0**64
        with np.errstate(divide="ignore"):
            value = np.floor(1.0 - np.log(-np.log1p(-np.minimum(u, 1 - 2.0**-53)) / self.rate) / np.log(self.base))
        return np.clip(value, 0, self.limit + 1).astype(np.uint16)

    def bands(self, registers: np.ndarray) -> np.ndarray:
        """Bucket (int64) of each set and band."""
        n = self.registers // self.rows
        parts = registers[:, : n * self.rows].reshape(len(registers), n, self.rows).astype(np.uint64)
        h, odd = np.tile(np.arange(1, n + 1, dtype=np.uint64), (len(registers), 1)), seeds(self.rows, 61)
        for k in range(self.rows):
            h = mix(h + (parts[:, :, k] + np.uint64(1)) * odd[k])
        return h.view(np.int64)

    def log_likelihood(self, higher, lower, equal, size_a, size_b, j):
        """Of similarity ``j``, given how many registers of a are higher than, lower than, equal to those of b."""
        u = size_a / (size_a + size_b)
        v = 1 - u
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (self.base - 1) / self.base) / np.log(self.base)
        up, down = p(u - v * j), p(v - u * j)
        log = lambda n, x: np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0)
        return log(higher, up) + log(lower, down) + log(equal, 1 - up - down)

    def may_reach(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: float, slack: float = 20.0) -> np.ndarray:
        """Pairs whose likelihood for some similarity of ``least`` or more is within exp(-slack) of the best one."""
        size_a, size_b = size_a.astype(float)[:, None], size_b.astype(float)[:, None]
        most = np.minimum(size_a, size_b) / np.maximum(size_a, size_b)
        higher, lower = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
        equal = a.shape[1] - higher - lower
        grid = np.linspace(0, 1, 101)[None, :]
        at = lambda j: self.log_likelihood(higher, lower, equal, size_a, size_b, j).max(1)
        best = at(grid * most)
        return (most[:, 0] >= least) & (at(np.minimum(least, most) + grid * np.maximum(most - least, 0)) >= best - slack)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text (words of A-Z in small letters), and the bounds of each part."""
    h, bounds = Words(texts, lower=True).windows(k, short=True)
    new = sorted_parts(h, bounds)
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def sketch_documents(docs: DataFrame, k: int, sketch: SetSketch) -> DataFrame:
    """doc_id, th, n_shingles, s1 and s2 (a 128-bit hash of the set), registers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, bounds = shingle_sets(part.column("text"), k)
                registers = sketch.of(h, bounds)
                sums = [part_sums(mix(h * odd), bounds).view(np.int64) for odd in seeds(2, 62)]
                arrays = [part.column("doc_id"), part.column("th"), pa.array(np.diff(bounds)), *(pa.array(x) for x in sums), pa.array([x.tobytes() for x in registers], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "n_shingles", "s1", "s2", "registers"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_key().alias("th"), "text").mapInArrow(freed(make), f"doc_id {kind}, th long, n_shingles long, s1 long, s2 long, registers binary")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, sketch: SetSketch = SetSketch()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, then th (hash of the text) and group (null without shingles).

    A text is the set of its distinct k-word shingles, with fewer words all of them as one. Documents are linked if
    100 * shared >= percent * all; component_id is the smallest doc_id that links lead to, its own included, and
    kept tells that it is the row's own. Null texts and texts without words have no shingles and no links. Documents
    with equal sets are one set from the start. Rows without a doc_id take part; a component of such rows only has a
    null component_id, and its rows are kept. Rows with the same doc_id stay or go together. Other columns are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = stage(sketch_documents(docs, k, sketch), "near_documents")
    key = ["s1", "s2", "n_shingles"]
    sets = rows.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("least_doc"), F.min(F.struct("doc_id", "th")).alias("one"), F.first("registers").alias("registers"))
    # numbered while it is written, so the numbers stay what they are
    sets = stage(sets.select(F.monotonically_increasing_id().alias("id"), *key, "least_doc", "one", "registers"), "near_sets")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bands = sketch.bands(_registers(batch.column("registers"), sketch))
                ids = np.repeat(batch.column("id").to_numpy(), bands.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(ids)], ["bucket", "id"])

    buckets = stage(sets.select("id", "registers").mapInArrow(freed(bucket), "bucket long, id long"), "near_buckets")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ra, rb = _registers(part.column("ra"), sketch), _registers(part.column("rb"), sketch)
                keep = sketch.may_reach(ra, rb, part.column("na").to_numpy(), part.column("nb").to_numpy(), percent / 100)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "ta"):
                left, la = shingle_sets(part.column("ta"), k)
                right, lb = shingle_sets(part.column("tb"), k)
                keep = []
                for i in range(part.num_rows):
                    x, y = left[la[i] : la[i + 1]], right[lb[i] : lb[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    source = docs.withColumn("th", text_key())
    repeated = _repeated(rows)

    def texts_of(ids: DataFrame) -> DataFrame:
        """id, text for (id)."""
        wanted = sized(stage(ids.join(sets, "id").select("id", "one.doc_id", "one.th"), "near_wanted"))
        found = source.join(wanted, source["doc_id"].eqNullSafe(wanted["doc_id"]) & (source["th"] == wanted["th"])).select("id", "text")
        return stage(found.groupBy("id").agg(F.first("text").alias("text")) if repeated else found, "near_texts")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, bounds = shingle_sets(part.column("text"), k)
                owner = pa.array(np.repeat(np.arange(part.num_rows), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays([part.column("id").take(owner), part.column("root").take(owner), pa.array(h.view(np.int64))], ["id", "root", "h"])

    def bound(named: DataFrame) -> DataFrame:
        """At most the ``c`` shingles that also occur in another group can be shared with one: sizes n and m allow a link only if 100 c >= percent (n + m - c)."""
        named = stage(named, "near_open")
        shingles = stage(texts_of(named.select("id")).join(sized(named), "id").mapInArrow(freed(spread), "id long, root long, h long"), "near_shingles")
        both = shingles.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
        common = shingles.join(stage(both, "near_common"), "h").groupBy("id").agg(F.count("*").alias("c"))
        size = F.col("n_shingles")
        reach = F.floor(100 * F.col("c") / percent) + F.col("c") - size
        common = common.join(sets, "id").select("id", size.alias("size"), F.ceil(percent * size / 100).alias("low"), reach.alias("reach")).where("low <= reach")
        bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
        word = F.pmod(F.shiftright("h", 6), F.lit(PARITY_WORDS))
        parity = shingles.groupBy("id").agg(*(F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{i}") for i in range(PARITY_WORDS)))
        return common.join(parity, "id")

    def fits(x: Side, y: Side) -> Column:
        """Each shingle that only one set has changes one parity bit, so at least as many shingles differ as bits do."""
        differ = sum((F.bit_count(x(f"b{i}").bitwiseXOR(y(f"b{i}"))) for i in range(PARITY_WORDS)), F.lit(0))
        return (100 + percent) * differ <= (100 - percent) * (x("size") + y("size"))

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
        b = sets.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
        pairs = stage(pairs.join(a, "a").join(b, "b").mapInArrow(freed(likely), "a long, b long"), "near_likely")
        texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        return pairs.join(a, "a").join(b, "b").mapInArrow(freed(linked), "a long, b long")

    roots = linked_groups(buckets, verify, "near_links", bound, fits)
    named = sets.join(roots, "id", "left").select(*key, "least_doc", F.coalesce("root", "id").alias("root"))
    named = stage(named, "near_named")
    least = sized(stage(named.groupBy("root").agg(F.min("least_doc").alias("component_id")), "near_components"))
    named = stage(named.join(least, "root").select(*key, "component_id", F.col("root").alias("group")), "near_named_sets")
    out = rows.select("doc_id", "th", *key).join(named, key, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "th", "group")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Documents (all columns) without near copies: of each group the one with the smallest doc_id stays (null comes last, then by hash of the text).

    Documents without shingles stay. Rows that agree in doc_id and text are one document, of which one row stays.
    """
    found = stage(near_duplicates(docs, **options).select("doc_id", "th", "group"), "near_found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = stage(found.where("group is not null").groupBy("group").agg(F.min(order).alias("first")), "near_first")
    gone = found.join(first, "group").where(order != F.col("first")).select(F.struct("doc_id", "th").alias("copy")).distinct()
    gone = sized(stage(gone, "near_gone"))
    left = docs.join(gone, F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("th")).eqNullSafe(gone["copy"]), "left_anti")
    if not _repeated(found):
        return left
    left = left.withColumn("__th", text_key()).dropDuplicates(["doc_id", "__th"])
    return left.drop("__th")


def _repeated(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id", "th").count().where("count > 1").isEmpty()


def _registers(column: pa.Array, sketch: SetSketch) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, sketch.registers)

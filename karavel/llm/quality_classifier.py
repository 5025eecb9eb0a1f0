"""Quality of texts by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from karavel.llm.common import Words, chunks, part_sums, sized, sorted_parts, stage, text_key

TRAIN_ROWS = 20_000  # labelled documents, at most about so many, that the trees learn from: this bounds what the driver holds
BINS = 64  # bins of a statistic's histogram
TREES, DEPTH = 120, 4
RATE = 0.1  # share of each tree's step that is taken
LEAST_WEIGHT = 1.0  # sum of second derivatives in a leaf, at least
PENALTY = 1.0  # on squared leaf values
STOP_AFTER = 15  # trees in a row without gain on the documents set aside
ACCEPT = 0.7  # scores from here on are predicted 1

# fixed values: classes of bytes whose shares are statistics
BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digits": b"0123456789",
    "stops": b".,;:",
    "shouts": b"!?",
    "symbols": b"#*$%&|<>@^~=+_/\\{}[]",
    "quotes": b"\"'()-",
    "breaks": b"\n",
}
_CLASS = np.zeros(256, np.uint8)
for _i, _members in enumerate(BYTE_CLASSES.values()):
    _CLASS[list(_members)] = _i + 1
_CLASS[128:192] = len(BYTE_CLASSES) + 1  # bytes that go on with a character
_CLASS[192:] = len(BYTE_CLASSES) + 2  # and that begin one which is not ASCII
N_CLASSES = len(BYTE_CLASSES) + 3
WORD_STATISTICS = (
    "log_words", "word_chars", "word_chars_spread", "longest_word", "distinct_words", "top_word", "repeated_triples", "repeated_eights",
    "capital_words", "loud_words", "stop_ends", "symbol_ends", "wordless", "log_lines", "line_words", "repeated_lines", "sentence_words",
)
STATISTICS = (*BYTE_CLASSES, "inner_bytes", "wide_chars", *WORD_STATISTICS)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _repeats(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part of values: how many differ, and how often the most frequent one occurs. Sorts ``h``."""
    new = sorted_parts(h, bounds)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    part = np.searchsorted(bounds, np.flatnonzero(new), "right") - 1
    top = np.zeros(len(bounds) - 1, np.int64)
    np.maximum.at(top, part, runs)
    return part_sums(new.astype(np.int64), bounds), top


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; null and empty texts have zeros."""
    words = Words(texts)
    buf, off, n, first = words.buf, words.off, len(texts), words.first
    kinds = _CLASS[buf]
    counts = np.stack([part_sums((kinds == i).astype(np.int64), off) for i in range(1, N_CLASSES)], axis=1)
    chars = np.diff(off) - counts[:, -2]
    n_words = np.diff(first)
    # characters of words: bytes that do not go on with one
    inner = np.concatenate([[0], np.cumsum(kinds == N_CLASSES - 2)])
    size = words.ends - words.starts - (inner[words.ends] - inner[words.starts])
    mean = _share(words.per_text(size), n_words)
    spread = np.sqrt(np.maximum(_share(words.per_text(size * size), n_words) - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, np.repeat(np.arange(n), n_words), size)
    distinct, top = _repeats(words.hashes.copy(), first)
    out = [np.log1p(n_words), mean, spread, np.minimum(longest, 100), _share(distinct, n_words), _share(top, n_words)]
    for k in (3, 8):
        h, bounds = words.windows(k, short=False)
        out.append(1 - _share(_repeats(h, bounds)[0], np.diff(bounds)))
        out[-1][np.diff(bounds) == 0] = 0
    head, tail = kinds[words.starts], kinds[np.maximum(words.ends - 1, 0)]
    upper = np.concatenate([[0], np.cumsum(kinds == 1)])
    lower = np.concatenate([[0], np.cumsum((kinds == 2) | (kinds == N_CLASSES - 1))])
    has_upper, has_lower = upper[words.ends] > upper[words.starts], lower[words.ends] > lower[words.starts]
    flags = [head == 1, has_upper & ~has_lower, tail == 4, (tail == 5) | (tail == 6), ~has_upper & ~has_lower]
    out += [_share(words.per_text(x.astype(np.int64)), n_words) for x in flags]
    lines, repeated = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        found = [x for x in buf[off[i] : off[i + 1]].tobytes().split(b"\n") if x and not x.isspace()]
        lines[i], repeated[i] = len(found), len(found) - len(set(found))
    ends = words.per_text((tail == 4).astype(np.int64))
    out += [np.log1p(lines), _share(n_words, lines), _share(repeated, lines), np.minimum(_share(n_words, ends), 200)]
    return np.concatenate([counts / np.maximum(chars, 1)[:, None], np.stack(out, axis=1)], axis=1) * (n_words > 0)[:, None]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth as arrays: node i has the children 2 i + 1 and 2 i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # a value above goes to the second child
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of statistics; all rows go down a tree together."""
        out, inner, rows = np.full(len(x), self.base), self.feature.shape[1], np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - inner]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def bin_limits(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Ascending limits between bins of about equal weight, for each column."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf")) for c in x.T]


def grow(binned: np.ndarray, limits: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree level by level: feature, limit and leaf arrays, and the leaf of each row."""
    rows, columns = binned.shape
    inner = (1 << depth) - 1
    feature, limit, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(rows, np.int64)
    for level in range(depth):
        first, n = (1 << level) - 1, 1 << level
        at = node - first
        best_gain, best = np.zeros(n), [(0, -1)] * n
        g_all, h_all = np.bincount(at, grad, n), np.bincount(at, hess, n)
        score = g_all**2 / (h_all + PENALTY)
        for c in range(columns):
            size = len(limits[c]) + 1
            if size < 2:
                continue
            cell = at * size + binned[:, c]
            g = np.bincount(cell, grad, n * size).reshape(n, size).cumsum(axis=1)[:, :-1]
            h = np.bincount(cell, hess, n * size).reshape(n, size).cumsum(axis=1)[:, :-1]
            g2, h2 = g_all[:, None] - g, h_all[:, None] - h
            gain = g**2 / (h + PENALTY) + g2**2 / (h2 + PENALTY) - score[:, None]
            gain[(h < LEAST_WEIGHT) | (h2 < LEAST_WEIGHT)] = 0
            cut = gain.argmax(axis=1)
            for i in np.flatnonzero(gain[np.arange(n), cut] > best_gain + 1e-9):
                best_gain[i], best[i] = gain[i, cut[i]], (c, int(cut[i]))
        above = np.zeros(rows, np.int64)
        for i, (c, cut) in enumerate(best):
            if cut >= 0:
                feature[first + i], limit[first + i] = c, limits[c][cut]
                own = at == i
                above[own] = binned[own, c] > cut
        node = 2 * node + 1 + above
    at = node - inner
    leaf = -np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + PENALTY)
    return feature, limit, leaf, at


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, aside: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for log loss. Rows set ``aside`` teach nothing but end the growth when they gain no more."""
    learn = ~aside
    total, ones = weight[learn].sum(), (weight * y)[learn].sum()
    base = float(np.log((ones + 1) / (total - ones + 1)))  # one more of each, so that one label alone stays finite
    inner = (1 << depth) - 1
    features, cuts, leaves = [], [], []
    if learn.any() and 0 < ones < total:
        limits = bin_limits(x[learn])
        binned = np.stack([np.searchsorted(limits[c], x[learn, c]) for c in range(x.shape[1])], axis=1)
        f, rest = np.full(learn.sum(), base), np.full(aside.sum(), base)
        w, t = weight[learn], y[learn]
        best, kept = np.inf, 0
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            feature, limit, leaf, at = grow(binned, limits, w * (p - t), w * p * (1 - p), depth)
            f += RATE * leaf[at]
            features.append(feature)
            cuts.append(limit)
            leaves.append(RATE * leaf)
            if aside.any():
                rest += Trees(0.0, feature[None], limit[None], RATE * leaf[None]).raw(x[aside])
                loss = float(np.average(np.logaddexp(0, np.where(y[aside] > 0, -rest, rest)), weights=weight[aside]))
                if loss < best - 1e-6:
                    best, kept = loss, len(leaves)
                elif len(leaves) - kept >= STOP_AFTER:
                    break
            else:
                kept = len(leaves)
        features, cuts, leaves = features[:kept], cuts[:kept], leaves[:kept]
    shape = lambda rows, n: np.array(rows).reshape(-1, n)
    return Trees(base, shape(features, inner).astype(np.int64), shape(cuts, inner).astype(float), shape(leaves, inner + 1).astype(float))


def is_held_out() -> Column:
    """crc32 of doc_id as text leaves 2 when divided by 4; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _dice(*columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(1 << 30)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees from whole texts of documents with a quality of 0 or 1 that are not held out.

    A classifier may learn from a bounded sample: labels are taken by a hash of doc_id so that about ``train_rows`` are
    left, and texts of them by a hash, if a doc_id has many. A document with several labels teaches each. A
    fifth of the sample is set aside and decides how many trees there are.
    """
    known = labels.where("quality in (0, 1)").where(F.col("doc_id").isNotNull() & ~is_held_out())
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = min(1.0, train_rows / max(known.count(), 1))
    known = sized(stage(known.where(_dice("doc_id") < share).groupBy("doc_id", "quality").agg(F.count("*").alias("n")), "quality_labels"))
    rows = docs.where(_dice("doc_id") < share).select("doc_id", text_key().alias("th"), F.col("text").cast("string").alias("text"))
    rows = rows.join(known.select("doc_id").distinct(), "doc_id", "left_semi")
    found = stage(_with_statistics(rows, "th").groupBy("doc_id", "th").agg(F.first("x").alias("x"), F.count("*").alias("copies")), "quality_sample")
    found = found.join(known, "doc_id").select("doc_id", "th", "x", "quality", (F.col("n") * F.col("copies")).alias("n"))
    many = found.count()
    if many > train_rows:
        found = found.where(_dice("doc_id", "th", F.lit(1)) < train_rows / many)
    sample = found.withColumn("aside", _dice("doc_id", F.lit(2)) < 0.2).orderBy("doc_id", "th", "quality").toArrow()
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float64).reshape(-1, len(STATISTICS))
    y, n, aside = (sample.column(c).to_numpy().astype(float) for c in ("quality", "n", "aside"))
    return fit(x, y, n, aside > 0)


def _with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep`` and x, the statistics of the text as bytes of doubles."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x = [row.tobytes() for row in statistics(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in keep), pa.array(x, pa.binary())], ["doc_id", *keep, "x"])

    kinds = dict(docs.dtypes)
    lead = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *keep))
    return docs.select("doc_id", *keep, "text").mapInArrow(measure, f"{lead}, x binary")


def score_quality(docs: DataFrame, trees: Trees, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``accept`` on) of every whole text.

    Null and empty texts are scored by zeros for all statistics, repeated rows alike. Without labels every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                score = shared.value.scores(statistics(part.column("text")))
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= accept).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``score_quality`` by trees that are trained on the same documents' labels."""
    return score_quality(docs, train(docs, labels, **options))

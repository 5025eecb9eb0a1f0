"""Periodic runs of words inside a text: seeds from k-grams that any run must repeat, extended along their diagonal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from karavel.llm.common import Words, chunks, mix, seeds

LEAST_WORDS = 12  # a run has so many words, and its period twice, at least


def lag_classes(longest: int, least: int = LEAST_WORDS) -> Iterator[tuple[int, int, int]]:
    """(first lag, lag after the last, k): words k in a row that a run with such a period shares with itself at that lag.

    A run of period q and length n >= max(least, 2 q) equals itself q further on over n - q words, which is at
    least max(least - q, q). The classes after the first double, so k is never less than half of the lag.
    """
    low, high = 1, max(2, 1 << (least // 2).bit_length())
    k = max(1, min(max(least - q, q) for q in range(low, high)))
    while low <= longest:
        yield low, high, k
        low, high = high, 2 * high
        k = low


class GramHashes:
    """Hashes of the k words from each place on, for k that only grows; longer ones are put together from shorter ones."""

    def __init__(self, words: np.ndarray):
        self.levels, self.n = [words], len(words)  # the i-th has grams of 2**i words

    def of(self, at: np.ndarray, k: int) -> np.ndarray:
        """``at`` + k must not go beyond the end."""
        while 1 << len(self.levels) <= k:
            h, half = self.levels[-1], 1 << (len(self.levels) - 1)
            odd = seeds(2, 130 + len(self.levels))
            more = h.copy()
            more[: self.n - half] = mix(h[: self.n - half] * odd[0] + h[half:] * odd[1])
            self.levels.append(more)
        level = k.bit_length() - 1
        h, odd = self.levels[level], seeds(2, 177)
        return h[at] if 1 << level == k else mix(h[at] * odd[0] + h[at + k - (1 << level)] * odd[1])


def seed_pairs(gram: np.ndarray, at: np.ndarray, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and lags of equal grams (i, i + lag) with low <= lag < high, enough of them to hit every run of such a period.

    ``gram`` has to tell texts apart. Equal grams at most k/2 words apart overlap in a stretch of a shorter period; a
    run of a longer period begins at the first such gram on one of its two sides, and both sides never
    lie in one stretch. So only pairs with a first gram are taken, between different stretches.
    """
    order = np.lexsort((at, gram))
    g, p = gram[order], at[order]
    n = len(p)
    same = np.zeros(n, bool)
    same[1:] = g[1:] == g[:-1]
    close = same & (np.diff(p, prepend=0) <= (k // 2 if k // 2 < low else 0))
    head = np.flatnonzero(~close)
    stretch = np.cumsum(~close) - 1
    end = np.append(head[1:], n)  # of each stretch
    begins, lags = [], []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        lag = p[j] - p[i]
        fits = lag >= low
        begins.append(p[i[fits]])
        lags.append(lag[fits])

    i, j = head, end.copy()  # forward from first grams: every later gram outside their own stretch
    while len(i):
        alive = j < n
        i, j = i[alive], j[alive]
        alive = (g[i] == g[j]) & (p[j] - p[i] < high)
        i, j = i[alive], j[alive]
        take(i, j)
        j = j + 1
    j, i = head, head - 1  # backward from first grams, to grams that are not first
    while len(j):
        alive = i >= 0
        i, j = i[alive], j[alive]
        alive = (g[i] == g[j]) & (p[j] - p[i] < high)
        i, j = i[alive], j[alive]
        other = head[stretch[i]] != i
        take(i[other], j[other])
        i = i - 1
    return np.concatenate(begins) if begins else p[:0], np.concatenate(lags) if lags else p[:0]


def _match(x: np.ndarray, y: np.ndarray) -> int:
    """How many words at the beginning are equal."""
    size, step = min(len(x), len(y)), 64
    done = 0
    while done < size:
        differ = np.flatnonzero(x[done : min(done + step, size)] != y[done : min(done + step, size)])
        if len(differ):
            return done + int(differ[0])
        done, step = min(done + step, size), step * 2
    return size


def periodic_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    ``words``: a hash for each word of all texts; ``first``: where each text begins, and the end. Starts count from
    the text's first word.
    """
    n_words = np.diff(first)
    found: list[tuple[int, int, int, int]] = []
    known: dict[tuple[int, int], int] = {}  # (begin, end) -> least period
    owner = np.repeat(np.arange(len(n_words)), n_words)
    limit = first[1:][owner] if len(owner) else owner
    hashes, at = GramHashes(mix(words.copy())), np.arange(len(words))
    of_text = mix(owner.astype(np.uint64) + np.uint64(1))
    for low, high, k in lag_classes(int(n_words.max(initial=0)) // 2, least):
        at = at[at + k <= limit[at]]
        if not len(at):
            break
        gram = hashes.of(at, k) ^ of_text[at]
        _, inverse, count = np.unique(gram, return_inverse=True, return_counts=True)
        again = count[inverse] > 1  # what does not come again has no longer gram that does
        at, gram = at[again], gram[again]
        if not len(at):
            break
        begin, lag = seed_pairs(gram, at, low, high, k)
        order = np.lexsort((begin, lag))
        begin, lag = begin[order], lag[order]
        reached: dict[int, int] = {}  # by lag: how far the diagonal is covered
        edges = np.flatnonzero(np.diff(lag, prepend=-1))
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(lag)).tolist()):
            q, t = int(lag[a]), a
            while t < b:
                i = int(begin[t])
                lo, hi = int(first[owner[i]]), int(limit[i])
                floor = max(lo, reached.get(q, 0))  # places up to there are judged already
                left = i - _match(words[floor:i][::-1], words[floor + q : i + q][::-1])
                right = i + k + _match(words[i + k : hi - q], words[i + k + q : hi])
                reached[q] = right + 1
                if right - left >= max(q, least - q):
                    p = known.get((left, right + q))
                    if p is None or q % p:
                        known.setdefault((left, right + q), q)
                        found.append((int(owner[i]), left - lo, right + q - left, q))
                t = t + int(np.searchsorted(begin[t:b], right))
    return np.array(sorted(found, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)


def find_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed, the text without the repeats, of every document.

    Words are what stands between blanks (\\x20, \\x09-\\x0D). A run is a stretch of words with smallest period q that has
    at least max(least, 2 q) words and that no neighbouring word extends. ``collapsed`` has the words that no run contains after its
    first q, joined by one blank. Null and empty texts have no runs and an empty collapsed text; repeated rows give repeated results; of
    other columns none is read. Every text is looked at whole, in the task that reads it.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                rows = periodic_runs(words.hashes, words.first, least)
                bounds = np.searchsorted(rows[:, 0], np.arange(part.num_rows + 1))
                flat = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat).cast(kind)
                texts = []
                for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    raw = words.buf[words.off[d] : words.off[d + 1]].tobytes().split()
                    if b > a:
                        depth = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(depth, rows[a:b, 1] + rows[a:b, 3], 1)
                        np.add.at(depth, rows[a:b, 1] + rows[a:b, 2], -1)
                        raw = [raw[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
                    texts.append(b" ".join(raw))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(look, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text where about a tenth of the texts, by crc32 of doc_id, repeat a part of themselves to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"))
    wide = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"))
    wide = wide.withColumn("ws", F.when(F.coalesce(F.col("h") % 10 == 0, F.lit(False)), words))  # only these are split
    n, g = F.size("ws"), F.floor(F.col("h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))

    def word(w: Column, i: Column) -> Column:
        return F.when(i >= F.col("a"), F.get("ws", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w)

    some = F.col("ws").isNotNull() & (n > 0)
    wide = wide.withColumn("a", F.when(some, a)).withColumn("p", F.when(some, p))
    text = F.when(some, F.array_join(F.transform("ws", word), " ")).otherwise(F.col("text"))
    return wide.select("doc_id", text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; the first of equals, null without runs), runs_sha256, collapsed_sha256."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    wide = found.withColumn("best", best)
    length, period = F.col("best.l"), -F.col("best.p")
    return wide.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


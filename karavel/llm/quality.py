"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from karavel.llm.common import IS_SPACE, Words, chunks, freed, sorted_parts, with_column

SAMPLE_ROWS = 400  # documents, about, that cost and selectivity are estimated on; they decide the order only, never a verdict
SAMPLE_BYTES = 1 << 16  # of them each has at most so many, so that the sample is bounded in bytes too
REPEAT_WINDOW = 8
IS_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))  # fixed values


class Texts:
    """Texts of a chunk; what several rules need is worked out once, when first asked for."""

    def __init__(self, texts: pa.Array):
        self.texts, self._known = texts, {}

    def get(self, name: str, make: Callable[[], np.ndarray]):
        if name not in self._known:
            self._known[name] = make()
        return self._known[name]

    @property
    def words(self) -> Words:
        return self.get("words", lambda: Words(self.texts))

    def n_words(self) -> np.ndarray:
        return self.get("n_words", lambda: np.diff(self.words.first))

    def word_chars(self) -> np.ndarray:
        return self.get("word_chars", lambda: self._bytes(~IS_SPACE & ((np.arange(256) & 0xC0) != 0x80)))

    def n_symbols(self) -> np.ndarray:
        return self.get("n_symbols", lambda: self._bytes(IS_SYMBOL))

    def _bytes(self, table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.words.buf) + 1, np.int64)
        np.cumsum(table[self.words.buf], out=sums[1:])
        return sums[self.words.off[1:]] - sums[self.words.off[:-1]]

    def n_dup_lines(self) -> np.ndarray:
        def make() -> np.ndarray:
            out = np.zeros(len(self.texts), np.int64)
            for i, text in enumerate(self.texts.to_pylist()):
                lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
                out[i] = len(lines) - len(set(lines))
            return out

        return self.get("n_dup_lines", make)

    def n_lines(self) -> np.ndarray:
        def make() -> np.ndarray:
            return np.array([sum(1 for x in (t or "").encode().split(b"\n") if x.split()) for t in self.texts.to_pylist()], np.int64)

        return self.get("n_lines", make)

    def n_repeat_words(self) -> np.ndarray:
        def make() -> np.ndarray:
            words, k = self.words, REPEAT_WINDOW
            h, bounds = words.windows(k, short=False)
            in_order = h.copy()
            new = sorted_parts(h, bounds)
            again = np.zeros(len(h), bool)  # of sorted values: found twice or more in their text
            again[1:] |= ~new[1:]
            again[:-1] |= ~new[1:]
            out = np.zeros(len(self.texts), np.int64)
            counts = np.concatenate([[0], np.cumsum(again)])
            for i in np.flatnonzero(counts[bounds[1:]] > counts[bounds[:-1]]):
                a, b = bounds[i], bounds[i + 1]
                twice = h[a:b][again[a:b]]
                at = np.flatnonzero(np.isin(in_order[a:b], twice))
                cover = np.zeros(b - a + k, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + k, -1)
                out[i] = np.count_nonzero(np.cumsum(cover) > 0)
            return out

        return self.get("n_repeat_words", make)


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a truth value for each text; it must depend on that text alone."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


BASE_RULES = (
    Rule("few_words", lambda t: t.n_words() < 20),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words() > 30 * t.n_words()),
)
RULES = (
    Rule("word_length", lambda t: (t.word_chars() < 2 * t.n_words()) | (t.word_chars() > 20 * t.n_words())),
    Rule("symbols", lambda t: 10 * t.n_symbols() > t.n_words()),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines() > 3 * t.n_lines()),
)


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules with their cost (seconds) and share of rejections on a sample, most rejections per cost first.

    The sample goes to the driver: about ``sample_rows`` documents of at most SAMPLE_BYTES bytes, drawn from all
    of them row by row. The order changes how much
    work is done, not which documents are rejected. Without rows the rules keep their order.
    """
    rows = []
    if sample_rows and (total := docs.count()):
        few = docs.select(F.col("text").cast("string")).sample(fraction=min(1.0, sample_rows / total), seed=10)
        rows = few.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).toArrow().column("text").combine_chunks()
    if not len(rows):
        return [(r, 0.0, 0.0) for r in rules]
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    known = []
    for rule in rules:
        began = time.perf_counter()
        share = float(np.mean(rule.rejects(Texts(rows))))
        known.append((rule, time.perf_counter() - began, share))
    return sorted(known, key=lambda x: -x[2] / max(x[1], 1e-9))


def failed_rule(texts: pa.Array, rules: tuple[Rule, ...]) -> np.ndarray:
    """Index of the first rule that rejects each text, or -1. Each rule sees only what passed the earlier ones."""
    out, left, seen = np.full(len(texts), -1), np.arange(len(texts)), Texts(texts)
    for k, rule in enumerate(rules):
        bad = np.asarray(rule.rejects(seen), bool)
        out[left[bad]] = k
        if bad.any():
            left = left[~bad]
            seen = Texts(texts.take(pa.array(left)))
        if not len(left):
            break
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns of ``docs`` and ``failed_rule``, the name of the rule that stopped the cascade, null if kept.

    Which of several failing rules is named depends on the measured order; whether one is named does not.
    A null or empty text has no words and fails ``few_words``. Repeated rows are judged alike. A column
    that is called failed_rule already is replaced.
    """
    order = tuple(r for r, _, _ in cascade_order(docs, rules, sample_rows))
    docs = docs.drop("failed_rule")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = failed_rule(part.column("text"), order)
                names = pa.array([order[k].name if k >= 0 else None for k in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, names], [*part.schema.names, "failed_rule"])

    return docs.mapInArrow(freed(judge), with_column(docs, "failed_rule", "string"))


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document.

    The counts are needed for all; the cascade of ``rules`` runs over what the base rules let through.
    Null text: all counts 0, base_failed. Empty table: no rows. Repeated rows give repeated results.
    """
    order = tuple(r for r, _, _ in cascade_order(docs, rules, sample_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                t = Texts(part.column("text"))
                counts = [t.n_words(), t.word_chars(), t.n_symbols(), t.n_dup_lines(), t.n_repeat_words()]
                base = np.zeros(part.num_rows, bool)
                for rule in BASE_RULES:
                    base |= rule.rejects(t)
                kept = ~base
                passed = np.flatnonzero(kept)
                if len(passed):
                    kept[passed] = failed_rule(part.column("text").take(pa.array(passed)), order) < 0
                arrays = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in counts), pa.array(base), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(freed(count), schema)

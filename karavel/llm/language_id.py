"""Language of every text by character models with interpolated Kneser-Ney smoothing, one per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from karavel.llm.common import chunks, mix, seeds

ORDER = 4
TRAIN_CHARS = 3_000_000  # characters that the models learn from, at most about so many for each language,
TRAIN_CHARS_ALL = 48_000_000  # and for all languages together: this bounds the models, which the driver builds and sends out
MOST_LANGS = 256  # values of lang that get a model: those with the most characters, the first by name if equal
PIECE = 2_000  # characters of a text that are taken into the sample together
ASIDE_FROM = 20  # pieces of a language from which on a tenth is set aside
CALIBRATION_ROWS = 4_000  # documents, at most about so many, that the rejection limits and the sharpness of scores are set on
REJECTED_SHARE = 0.001  # of calibration documents in their own language that the limit lets go
ALPHABET = 1 << 16  # what the smoothing takes for the number of characters that exist
AT_ONCE = 1 << 16  # positions scored at a time
UNKNOWN = "und"  # fixed value: undetermined
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the small letters of each text with one blank for anything between, after ORDER-1 blanks.

    Returns them in one array, the index of the first symbol of each text, and of the one after its last; a text without letters has none.
    """
    lead, parts, starts, ends, at = np.full(ORDER - 1, 32, np.uint32), [], [], [], 0
    for x in texts:
        raw = (x.as_py() or "").lower().encode("utf-32-le")
        cp = np.frombuffer(raw, np.uint32)
        is_letter = letters()[cp]
        cp = np.where(is_letter, cp, np.uint32(32))
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # the first character after a letter, as a blank
        cp = cp[keep] if is_letter.any() else cp[:0]
        parts += [lead, cp]
        starts.append(at + len(lead))
        at += len(lead) + len(cp)
        ends.append(at)
    return np.concatenate(parts) if parts else lead[:0], np.array(starts, np.int64), np.array(ends, np.int64)


def gram_hashes(cp: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k symbols that end at each of ``at``; k = 0 gives one value."""
    h, odd = np.full(len(at), k + 1, np.uint64), seeds(ORDER, 41)
    for j in range(k):
        h += cp[at - j].astype(np.uint64) * odd[j]
    return mix(h)


@dataclass(frozen=True)
class Table:
    """Sorted hashes with a row of values (one for each language) each."""

    hashes: np.ndarray
    values: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        return at, (self.hashes[at] == h) if len(self.hashes) else np.zeros(len(h), bool)


@dataclass(frozen=True)
class Models:
    """``grams[k]``: log2 P(last symbol | the k before it) of grams seen in any language; ``backoff[k]``: log2 of the weight that contexts of k symbols leave to shorter ones."""

    langs: tuple[str, ...]
    grams: tuple[Table, ...]
    backoff: tuple[Table, ...]
    sharpness: float = 1.0
    limits: tuple[float, ...] = ()  # bits per symbol above which a text is rejected, by language

    def entropies(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits per symbol of each text in each language."""
        sums = np.zeros((len(starts), len(self.langs)))
        where = np.repeat(np.arange(len(starts)), ends - starts)
        first = np.cumsum(ends - starts) - (ends - starts)
        place = np.arange(len(where)) - np.repeat(first - starts, ends - starts)
        for a in range(0, len(place), AT_ONCE):
            at, who = place[a : a + AT_ONCE], where[a : a + AT_ONCE]
            logs = self.log_probabilities(cp, at)
            own, begin = np.unique(who, return_index=True)
            sums[own] += np.add.reduceat(logs, begin, axis=0)
        return -sums / np.maximum(ends - starts, 1)[:, None]

    def log_probabilities(self, cp: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), len(self.langs)))
        left = np.arange(len(at))
        for k in range(ORDER - 1, -1, -1):
            row, found = self.grams[k].find(gram_hashes(cp, at[left], k + 1))
            out[left[found]] += self.grams[k].values[row[found]]
            left = left[~found]
            if not len(left):
                return out
            row, found = self.backoff[k].find(gram_hashes(cp, at[left] - 1, k))
            out[left[found]] += self.backoff[k].values[row[found]]
        out[left] -= np.log2(ALPHABET)
        return out


def build_models(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """From each language's distinct grams (rows of ORDER code points) and how often each occurs."""
    langs = tuple(sorted(counts))
    levels: list[dict] = []  # by order: language -> (grams, counts); lower orders count distinct symbols in front
    for k in range(ORDER, 0, -1):
        level = {}
        for lang in langs:
            if k == ORDER:
                grams, n = counts[lang]
                grams, inverse = np.unique(grams, axis=0, return_inverse=True)
                n = np.bincount(inverse.ravel(), weights=n, minlength=len(grams))
            else:
                grams, n = np.unique(levels[-1][lang][0][:, 1:], axis=0, return_counts=True)
            level[lang] = (grams, n.astype(float))
        levels.append(level)
    levels.reverse()
    shorter: list[tuple[Table, Table]] = []
    for k, level in enumerate(levels):  # k symbols of context
        every = np.unique(np.concatenate([g for g, _ in level.values()]), axis=0) if level else np.zeros((0, k + 1), np.uint32)
        h, ctx = _row_hashes(every), _row_hashes(every[:, :-1])
        context, inverse = np.unique(ctx, return_inverse=True)
        # probability of the last symbol after one symbol of context less
        lower = _lookup(shorter, every[:, 1:], len(langs)) if k else np.full((len(every), len(langs)), -np.log2(ALPHABET))
        logs, weights = np.zeros((len(every), len(langs))), np.zeros((len(context), len(langs)))
        for i, lang in enumerate(langs):
            grams, n = level[lang]
            c = np.zeros(len(every))
            order = np.argsort(h)
            c[order[np.searchsorted(h, _row_hashes(grams), sorter=order)]] = n
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total, types = np.bincount(inverse, c, len(context)), np.bincount(inverse, c > 0, len(context))
            gamma = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
            p = np.where(total[inverse] > 0, np.maximum(c - discount, 0) / np.maximum(total[inverse], 1), 0) + gamma[inverse] * 2.0 ** lower[:, i]
            logs[:, i], weights[:, i] = np.log2(p), np.log2(gamma)
        order = np.argsort(h)
        shorter.append((Table(h[order], logs[order].astype(np.float32)), Table(context, weights.astype(np.float32))))
    return Models(langs, tuple(g for g, _ in shorter), tuple(b for _, b in shorter))


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    k = rows.shape[1]
    flat = np.ascontiguousarray(rows).ravel()
    return gram_hashes(flat, np.arange(len(rows)) * k + k - 1, k)


def _lookup(tables: list[tuple[Table, Table]], rows: np.ndarray, langs: int) -> np.ndarray:
    """Every row ends a longer gram that was seen, so the shorter one was seen too."""
    at, _ = tables[-1][0].find(_row_hashes(rows))
    return tables[-1][0].values[at].astype(float) if len(rows) else np.zeros((0, langs))


def is_held_out() -> Column:
    """crc32 of doc_id as text is a multiple of 5; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, train_chars: int = TRAIN_CHARS, all_chars: int = TRAIN_CHARS_ALL, calibration_rows: int = CALIBRATION_ROWS) -> Models:
    """Models from text and lang of documents whose crc32(doc_id) is no multiple of 5, over whole texts.

    A classifier may learn from a bounded sample: pieces of texts are taken by a hash of doc_id, text and place so that
    each language has about ``train_chars`` characters and all have ``all_chars`` together, whatever the lengths of
    its texts. A tenth of a language with ASIDE_FROM pieces or more is not counted but sets limits and sharpness. Of more than
    ``MOST_LANGS`` values of lang those with the most characters are learned. Null langs and texts teach nothing.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    by_lang = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).orderBy(F.col("chars").desc(), "lang").limit(MOST_LANGS)
    sizes = {r["lang"]: r["chars"] for r in by_lang.collect()}
    if not sizes:
        return Models((), (), ())
    each = min(train_chars, all_chars // len(sizes))
    shares = [(lang, min(1.0, each / max(chars, 1)), 0.1 if min(each, chars) >= ASIDE_FROM * PIECE else 0.0) for lang, chars in sizes.items()]
    shares = F.broadcast(spark.createDataFrame(shares, "lang string, share double, aside double"))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                out = [], [], []
                for text, lang, key, share, aside in zip(part.column("text"), *(part.column(c).to_pylist() for c in ("lang", "key", "share", "aside"))):
                    text = text.as_py()
                    h = np.uint64(key % (1 << 64)) + np.arange(-(-len(text) // PIECE), dtype=np.uint64)
                    dice = [mix(h + np.uint64(salt << 40)) / 2.0**64 for salt in (1, 2)]
                    for i in np.flatnonzero(dice[0] < share).tolist():
                        for column, value in zip(out, (lang, text[i * PIECE : (i + 1) * PIECE], bool(dice[1][i] < aside))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.string(), pa.bool_()))], ["lang", "text", "aside"])

    sample = rows.join(shares, "lang").select("lang", "text", "key", "share", "aside").mapInArrow(cut, "lang string, text string, aside boolean")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                for lang in set(part.column("lang").to_pylist()):
                    cp, starts, ends = symbols(part.column("text").filter(pa.compute.equal(part.column("lang"), lang)))
                    at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])
                    if len(at):
                        rows = np.stack([cp[at - j] for j in range(ORDER - 1, -1, -1)], axis=1)
                        grams, n = np.unique(rows, axis=0, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([x.tobytes() for x in grams], pa.binary()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    grams = sample.where("not aside").mapInArrow(count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    by_lang = {}
    for lang in sizes:
        own = grams.filter(pa.compute.equal(grams.column("lang"), lang))
        rows_ = np.frombuffer(b"".join(own.column("gram").to_pylist()), np.uint32).reshape(-1, ORDER)
        if len(rows_):
            by_lang[lang] = (rows_, own.column("n").to_numpy())
    models = build_models(by_lang)
    aside = sum(min(each, chars) for chars in sizes.values()) // (10 * PIECE)  # pieces, about
    picked = sample.where("aside").where(dice_text(calibration_rows, aside))
    known = [r for r in classify_rows(picked.select(F.lit(0).alias("doc_id"), "text", "lang"), models, "lang").select("lang", "bits").collect()]
    return _calibrated(models, [(r["lang"], np.array(r["bits"])) for r in known if r["lang"] in models.langs and r["bits"]])


def dice_text(most: int, rows: int) -> Column:
    return F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < F.lit(min(1.0, most / max(rows, 1)) * (1 << 30))


def _calibrated(models: Models, known: list[tuple[str, np.ndarray]]) -> Models:
    """Limits from the highest bits that texts have in their own language; sharpness with the least log loss."""
    limits, best = [], (np.inf, 1.0)
    for i, lang in enumerate(models.langs):
        own = np.array([b[i] for x, b in known if x == lang])
        limits.append(float(np.quantile(own, 1 - REJECTED_SHARE)) + 1.0 if len(own) else float(np.log2(ALPHABET)))
    if known:
        bits, right = np.array([b for _, b in known]), np.array([models.langs.index(x) for x, _ in known])
        for sharpness in 2.0 ** np.arange(0, 7):
            loss = -np.log(np.maximum(scores(bits, sharpness)[np.arange(len(right)), right], 1e-12)).mean()
            best = min(best, (loss, float(sharpness)))
    return Models(models.langs, models.grams, models.backoff, best[1], tuple(limits))


def scores(bits: np.ndarray, sharpness: float) -> np.ndarray:
    """Shares of the languages, from 0 to 1, by how many bits per symbol each is above the best."""
    x = np.exp2(-sharpness * (bits - bits.min(axis=1, keepdims=True)))
    return x / x.sum(axis=1, keepdims=True)


def classify_rows(docs: DataFrame, models: Models, *keep: str) -> DataFrame:
    """doc_id, ``keep``, lang_pred, score, accepted, bits (per symbol, by language; null without letters)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for part in chunks(batch):
                cp, starts, ends = symbols(part.column("text"))
                some = ends > starts
                names, score, ok = [UNKNOWN] * len(starts), np.zeros(len(starts)), np.zeros(len(starts), bool)
                bits: list = [None] * len(starts)
                if models.langs and some.any():
                    found = models.entropies(cp, starts, ends)
                    best, shares = found.argmin(axis=1), scores(found, models.sharpness)
                    for i in np.flatnonzero(some):
                        names[i], score[i], bits[i] = models.langs[best[i]], shares[i, best[i]], found[i].tolist()
                        ok[i] = found[i, best[i]] <= (models.limits[best[i]] if models.limits else np.inf)
                columns = [pa.array(names), pa.array(score), pa.array(ok), pa.array(bits, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *keep)), *columns], ["doc_id", *keep, "lang_pred", "score", "accepted", "bits"])

    kinds = dict(docs.dtypes)
    lead = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *keep))
    return docs.select("doc_id", *keep, F.col("text").cast("string").alias("text")).mapInArrow(predict, f"{lead}, lang_pred string, score double, accepted boolean, bits array<double>")


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every whole text.

    The language with the least bits per symbol wins (the first by name if equal). ``accepted`` is false if
    even that one needs more bits than texts of its language do. Null text and text without letters: ``und``,
    score 0, not accepted; so is everything if no row has a lang to learn from. Repeated rows give repeated results.
    """
    models = train(docs, **options)
    rows = docs.select("doc_id", "text", is_held_out().alias("held_out"))
    return classify_rows(rows, models, "held_out").select("doc_id", "held_out", "lang_pred", "score", "accepted")

"""Repeated and nearly repeated lines: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line per group.

Edits that are spread over a whole line change most blocks of any fingerprint, so lines also meet by a few of their grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from karavel.llm.common import Run, Side, chunks, components, discard, freed, linked_groups, merge_components, mix, same_document, seeds, sized, span_hashes, stage, text_key

KINDS, PLACES = 32, 8  # features: kinds of bytes by the part of the line they stand in, neighbouring parts overlap
BLOCKS, BITS = 12, 20  # a SimHash is cut into blocks; lines that differ in fewer bits than there are blocks agree in one
GRAM_BYTES, COLUMNS = 12, 12  # lines also meet by the least gram of each of so many classes of grams,
GRAM_PLACES = 4  # if it stands in the same part of them; edges of parts differ by class
SAMPLED = 96  # grams of a line, about, from which the least ones are taken: those with the least hashes
RADIUS = 84  # of BLOCKS * BITS bits that similar lines differ in at most, but for 1 % of long ones with a tenth replaced; unrelated ones differ in 120, 0.1 % in less
BLOCK_RADIUS = 64  # the same for lines that meet by a block: only edits in a few places change more bits, and they leave most grams to meet by
FROM_CHARS = 27  # characters from which lines have a SimHash and grams; lines up to SHORT_TO are met by intact segments, whatever the edits
SHORT_TO = 29
SIZE_BIN = 1.3  # lines meet if they are of one class of size; its edges differ by block and column
AT_ONCE = 1_000  # lines whose features are held at a time
SMALL = 16  # a bucket gives up to half as many near pairs a member; of others each member is compared with one first
MIDDLE = 1024  # members of a bucket whose sizes and SimHashes are compared pair by pair where they meet
PASSES = 4  # parts of the meeting points that are shuffled one after the other, since each row of theirs carries a SimHash
LEAST_CHARS = 1  # bytes of a normalised line; only blank lines are left alone
SIMILARITY = 0.9  # 1 - edits / characters of the longer line
GRAM, PARITY_WORDS = 3, 16  # lines are compared by parity bits of their 3-character grams before their texts are,
PAIRS_AT_ONCE, CHARS_AT_ONCE = 512, 1 << 18  # so many pairs, or characters of them, at a time
BAND, CELLS_AT_ONCE = 1000, 1 << 15  # pairs of up to BAND allowed edits are compared many at once, so many cells in a step

_table = bytearray(range(256))
for _c in range(128):
    if not chr(_c).isalnum() and _c != 10:
        _table[_c] = 32
for _c in b"0123456789":
    _table[_c] = 48
NORMAL = bytes(_table)
KIND = 28 + np.arange(256) % 4
KIND[97:123] = np.arange(26)
KIND[[48, 32]] = 26, 27
_matrix: np.ndarray | None = None


def normalised(text: str) -> list[bytes]:
    """The lines of a text in small letters, digits as 0, ASCII punctuation and runs of blanks as one blank."""
    return [b" ".join(x.split()) for x in text.lower().encode().translate(NORMAL).split(b"\n")]


def feature_matrix() -> np.ndarray:
    """(kinds x half parts) x bits. A byte counts three times for its part of the line, once for the nearer part beside
    it; of each kind the mean over all parts is taken off, so what all lines have in common does not count."""
    global _matrix
    if _matrix is None:
        bits = BLOCKS * BITS
        coin = (seeds(KINDS * PLACES * bits, 8) >> np.uint64(63)).astype(np.int64)
        signs = (2 * coin - 1).reshape(KINDS, PLACES, bits)
        signs = PLACES * signs - signs.sum(axis=1, keepdims=True)
        half = np.arange(2 * PLACES)
        beside = np.clip(half // 2 + np.where(half % 2, 1, -1), 0, PLACES - 1)
        _matrix = (3 * signs[:, half // 2] + signs[:, beside]).reshape(KINDS * 2 * PLACES, bits).astype(np.float32)
    return _matrix


def simhash(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits (lines x BLOCKS * BITS) of the lines of a buffer, none of them empty."""
    size, cells = np.diff(off), KINDS * 2 * PLACES
    owner = np.repeat(np.arange(len(size)), size)
    half = (np.arange(len(buf)) - off[owner]) * (2 * PLACES) // size[owner]
    counts = np.bincount(owner * cells + KIND[buf] * (2 * PLACES) + half, minlength=len(size) * cells)
    return counts.reshape(len(size), cells).astype(np.float32) @ feature_matrix() > 0


def least_grams(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The least gram (32 bits of its hash) in each of COLUMNS classes of the grams of each line; 0 if there is none."""
    runs = np.maximum(np.diff(off) - GRAM_BYTES + 1, 0)
    owner = np.repeat(np.arange(len(runs)), runs)
    at = np.arange(len(owner)) + (off[:-1] - np.cumsum(runs) + runs)[owner]
    h = span_hashes(buf, at, at + GRAM_BYTES)
    rank = (h >> np.uint64(40)).astype(np.int64)  # 24 bits; only small ones can be the least of a long line
    some = rank * runs[owner] < SAMPLED << 24
    owner, h, rank, at = owner[some], h[some], rank[some], at[some]
    column = ((h >> np.uint64(34)) & np.uint64(63)).astype(np.int64) % COLUMNS
    part = ((at - off[owner]) * GRAM_PLACES / (off[1:] - off[:-1])[owner] + column / COLUMNS).astype(np.int64)
    out = np.full(len(runs) * COLUMNS, 1 << 62)
    np.minimum.at(out, owner * COLUMNS + column, (rank << 37) + ((h & np.uint64((1 << 34) - 1)).astype(np.int64) << 3) + part)
    out = out.reshape(len(runs), COLUMNS)
    return np.where(out == 1 << 62, 0, mix(out.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def segments(line: str) -> set[tuple[int, int, str]]:
    """Parts of a short line. Two lines whose similarity is 0.9 or more, the longer of at most SHORT_TO characters, have one in common.

    For the size of the longer line one or two edits are allowed. One leaves the first or the last half. Two leave
    the first or the last third, or one is in each and the third after the first one is moved by one place at most.
    """
    out, n = set(), len(line)
    for longer in range(n, SHORT_TO + 1):
        allowed = longer // 10
        if longer - n > allowed:
            break
        k = longer // (allowed + 1) if allowed else n
        out |= {(longer, 0, line[:k]), (longer, 1, line[-k:])}
        if allowed == 2:
            out |= {(longer, 2, line[k + s : 2 * k + s]) for s in (-1, 0, 1)}
    return out


def sketches(lines: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """SimHash (lines x 4 words), other meeting points (32-bit numbers; of lines from FROM_CHARS on COLUMNS grams first) and characters of each line."""
    off = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    buf = np.frombuffer(b"".join(lines), np.uint8)
    count = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = count[off[1:]] - count[off[:-1]]
    packed = np.zeros((len(lines), 32), np.uint8)
    long = np.flatnonzero(chars >= FROM_CHARS)
    for at in range(0, len(long), AT_ONCE):
        some = long[at : at + AT_ONCE]
        own = [lines[i] for i in some.tolist()]
        bits = simhash(np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in own])]))
        packed[some, : BLOCKS * BITS // 8] = np.packbits(bits, axis=1)
    other = [row.tobytes() for row in least_grams(buf, off)]
    for i in np.flatnonzero(chars <= SHORT_TO).tolist():
        own = b"".join([hashlib.blake2b(repr(x).encode(), digest_size=4).digest() for x in sorted(segments(lines[i].decode("utf-8", "replace")))])
        other[i] = other[i] + own if chars[i] >= FROM_CHARS else own
    return packed.view("<u8"), other, chars


def size_class(chars: np.ndarray, column: int, columns: int) -> np.ndarray:
    return np.floor(np.log(np.maximum(chars, 1)) / np.log(SIZE_BIN) + column / columns).astype(np.int64)


def block_buckets(sketch: np.ndarray, chars: np.ndarray, blocks: Sequence[int] = range(BLOCKS)) -> np.ndarray:
    """Buckets (lines x blocks) of SimHashes: block, class of size, bits of the block."""
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1)[:, : BLOCKS * BITS].reshape(len(chars), BLOCKS, BITS)
    values = (bits[:, list(blocks)].astype(np.float32) @ (1 << np.arange(BITS)).astype(np.float32)).astype(np.int64)
    return np.stack([(1 << 48) + (k << 40) + (size_class(chars, k, BLOCKS) << 32) + values[:, i] for i, k in enumerate(blocks)], axis=1)


def gram_buckets(grams: np.ndarray, chars: np.ndarray, columns: Sequence[int] = range(COLUMNS)) -> np.ndarray:
    """Buckets (lines x columns) of least grams, -1 where there is none."""
    found = [(2 << 48) + (k << 40) + (size_class(chars, k, COLUMNS) << 32) + grams[:, k].astype(np.int64) for k in columns]
    return np.where(grams[:, list(columns)] == 0, -1, np.stack(found, axis=1))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; one step for each character of the shorter text, on all of the longer one at once."""
    skip = 0
    while skip < min(len(a), len(b)) and a[skip] == b[skip]:
        skip += 1
    a, b = a[skip:], b[skip:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    size, places = len(a), {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    at = {}
    for c, found in places.items():
        bits = bytearray(size // 8 + 1)
        for i in found:
            bits[i >> 3] |= 1 << (i & 7)
        at[c] = int.from_bytes(bits, "little")
    every, last = (1 << size) - 1, 1 << (size - 1)
    up, down, distance = every, 0, size  # where the column rises or falls by one against the character before
    for c in b:
        same = at.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (every & ~(diagonal | up)), up & diagonal
        distance += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | 1) & every, fall << 1 & every
        up, down = fall | (every & ~(diagonal | rise)), rise & diagonal
    return distance


def odd_grams(xs: list[str], ys: list[str]) -> np.ndarray:
    """For each pair of texts, of how many classes of GRAM neighbouring characters one holds an odd and the other an even number."""
    texts = [x for pair in zip(xs, ys) for x in pair]
    size = np.array([len(x) for x in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    runs = np.maximum(size - GRAM + 1, 0)
    at = np.repeat(np.cumsum(size) - size, runs) + _ranges(runs)
    odd, h = seeds(GRAM, 8), np.zeros(len(at), np.uint64)
    for i in range(GRAM):
        h += c[at + i] * odd[i]
    bits = 64 * PARITY_WORDS
    owner = np.repeat(np.arange(len(texts)) // 2, runs)
    counts = np.bincount(owner * bits + (mix(h) >> np.uint64(40)).astype(np.int64) % bits, minlength=len(xs) * bits)
    return (counts & 1).reshape(len(xs), bits).sum(axis=1)


def maybe_similar_pairs(xs: list[str], ys: list[str], least: float) -> np.ndarray:
    """False only for pairs that are not similar: an edit changes at most GRAM grams of either text, and each gram one parity bit."""
    allowed = np.array([int((1 - least) * max(len(x), len(y)) + 1e-9) for x, y in zip(xs, ys)], np.int64)
    out = 2 * GRAM * allowed >= 32 * PARITY_WORDS  # texts that have nothing in common differ in half of the bits
    ask, held = np.flatnonzero(~out), np.cumsum([len(xs[i]) + len(ys[i]) for i in np.flatnonzero(~out).tolist()])
    at = 0
    while at < len(ask):
        to = min(at + PAIRS_AT_ONCE, max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + CHARS_AT_ONCE, "right"))))
        some = ask[at:to]
        out[some] = odd_grams([xs[i] for i in some.tolist()], [ys[i] for i in some.tolist()]) <= 2 * GRAM * allowed[some]
        at = to
    return out


def maybe_similar(a: str, b: str, least: float) -> bool:
    return bool(maybe_similar_pairs([a], [b], least)[0])


def similar(a: str, b: str, least: float) -> bool:
    allowed = int((1 - least) * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= allowed and edit_distance(a, b) <= allowed


def banded_distances(xs: list[str], ys: list[str], k: int) -> np.ndarray:
    """``edit_distance`` of pairs of texts in the order of their characters together; any number over k, up to k + 1, if it is over k. k is BAND at most.

    Only cells (i, j) with i - j from -k to k count. Those of one i + j depend on the two sums before only, so all of them, in all pairs,
    are one step. ``even`` holds i - j = -k, -k + 2, ... k; ``odd`` the ones between, and an edge on either side.
    """
    pairs, n = np.arange(len(xs)), np.array([(len(x), len(y)) for x, y in zip(xs, ys)], np.int64)
    total, end = n.sum(axis=1), int(n[-1].sum())
    rows = k + 3 + (end + k) // 2
    sides = []
    for k_, texts in enumerate((xs, ys)):
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        side = np.zeros((rows, len(pairs)), np.uint16 if codes.max(initial=0) < 1 << 16 else np.uint32)
        side[k + 1 + _ranges(n[:, k_]), np.repeat(pairs, n[:, k_])] = codes
        sides.append(side)
    x, y = sides[0], np.ascontiguousarray(sides[1][::-1])
    small = np.uint8 if k < 255 else np.uint16
    over = np.full((k + 2, len(pairs)), k + 1, small)
    even, odd, least = over[1:].copy(), over.copy(), over[1:].copy()
    (odd if k % 2 else even)[(k + 1) // 2] = 0
    differ = np.empty((k + 1, len(pairs)), bool)
    differing = differ.view(np.uint8)
    due, at = np.searchsorted(total, np.arange(end + 2)).tolist(), (n[:, 0] - n[:, 1] + k + 1) // 2
    out = np.zeros(len(pairs), np.int64)
    for step in range(1, end + 1):
        gap = (step + k) % 2
        own, beside, m = (odd[1:-1], even, k) if gap else (even, odd, k + 1)
        i, j = k + (step - k + gap) // 2, rows - k - 1 - (step + k - gap) // 2
        np.not_equal(x[i : i + m], y[j : j + m], out=differ[:m])
        np.minimum(beside[:-1], beside[1:], out=least[:m])
        least[:m] += 1
        own += differing[:m]
        np.minimum(own, least[:m], out=own)
        np.minimum(own, over[:m], out=own)
        if due[step] < due[step + 1]:
            some = slice(due[step], due[step + 1])
            out[some] = (odd if gap else even)[at[some], pairs[some]]
    return out


def similar_pairs(xs: list[str], ys: list[str], least: float) -> np.ndarray:
    """``similar`` of many pairs of texts."""
    n = np.array([(len(x), len(y)) for x, y in zip(xs, ys)], np.int64).reshape(-1, 2)
    allowed = np.array([int((1 - least) * m + 1e-9) for m in n.max(axis=1).tolist()], np.int64)
    out, open_ = np.zeros(len(xs), bool), abs(n[:, 0] - n[:, 1]) <= allowed
    long = np.flatnonzero(open_ & (allowed > BAND)).tolist()
    for i, maybe in zip(long, maybe_similar_pairs([xs[i] for i in long], [ys[i] for i in long], least).tolist()):
        out[i] = maybe and similar(xs[i], ys[i], least)
    short = np.flatnonzero(open_ & (allowed <= BAND))
    short = short[np.argsort(n[short].sum(axis=1), kind="stable")]
    total, at = n[short].sum(axis=1), 0
    while at < len(short):  # texts of about one size together
        to = int(np.searchsorted(total, 1.1 * total[at] + 8, "right"))
        to = min(to, at + max(1, CELLS_AT_ONCE // (int(allowed[short[at:to]].max()) + 1)))
        some = short[at:to]
        own = [[texts[i] for i in some.tolist()] for texts in (xs, ys)]
        out[some] = banded_distances(*own, int(allowed[some].max())) <= allowed[some]
        at = to
    return out


def line_table(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, th, line (from 0), h1 and h2 (a 128-bit hash of the normalised line), its size in characters, SimHash (s0 to s3) and other buckets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                lines, owner, number, held = [], [], [], 0
                while at < batch.num_rows and held < 1 << 19:
                    for n, x in enumerate(normalised(batch.column("text")[at].as_py())):
                        if len(x) >= max(1, least_chars):
                            lines.append(x)
                            owner.append(at)
                            number.append(n)
                            held += len(x)
                    at += 1
                if not lines:
                    continue
                digest = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in lines]), "<i8").reshape(-1, 2)
                sketch, other, chars = sketches(lines)
                rows, sketch = pa.array(owner), sketch.view(np.int64)
                arrays = [batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(number, pa.int32())]
                arrays += [pa.array(digest[:, i].copy()) for i in range(2)] + [pa.array(chars.astype(np.int32)), pa.array(other, pa.binary())]
                arrays += [pa.array(sketch[:, i].copy()) for i in range(4)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "line", "h1", "h2", "size", "other", *SKETCH])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "th", "text").mapInArrow(freed(make), f"doc_id {kind}, th long, line int, h1 long, h2 long, size int, other binary, s0 long, s1 long, s2 long, s3 long")


SKETCH = ("s0", "s1", "s2", "s3")
MET = ("id", "size", *SKETCH)


def _explode(part: int) -> Run:
    """(bucket, id, size, SimHash) of every line and every meeting point of one of the PASSES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue

            def rows(bucket: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(bucket), *(batch.column(c).take(pa.array(at)) for c in MET)], ["bucket", *MET])

            chars = batch.column("size").to_numpy()
            other, long = batch.column("other").to_pylist(), chars >= FROM_CHARS
            grams = np.frombuffer(b"".join([x[: 4 * COLUMNS] for x, some in zip(other, long.tolist()) if some]), "<u4").reshape(-1, COLUMNS)
            own = [x[4 * COLUMNS * some :] for x, some in zip(other, long.tolist())]
            short = np.frombuffer(b"".join(own), "<u4").astype(np.int64)
            at = np.repeat(np.arange(len(own)), [len(x) // 4 for x in own])
            yield rows(short[short % PASSES == part] + (3 << 48), at[short % PASSES == part])
            at, long_chars = np.flatnonzero(long), chars[long]
            sketch = np.stack([batch.column(c).to_numpy() for c in SKETCH], axis=1)[long]
            buckets = block_buckets(sketch, long_chars, range(part, BLOCKS, PASSES)), gram_buckets(grams, long_chars, range(part, COLUMNS, PASSES))
            for column in (*buckets[0].T, *buckets[1].T):
                yield rows(column[column >= 0], at[column >= 0])

    return run


def _nearness(similarity: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For rows of (bucket, id, size, SimHash) and others of their buckets: the bits that differ, -1 if ``_far_apart`` holds.

    Lines that meet by a block must differ in BLOCK_RADIUS bits at most; beyond it most meet by chance, the more often the more lines there are.
    """

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        least, most = np.minimum(x[:, 2], y[:, 2]), np.maximum(x[:, 2], y[:, 2])
        d = np.bitwise_count((x[:, 3:] ^ y[:, 3:]).view(np.uint64)).sum(axis=1, dtype=np.int32)
        radius = np.where(x[:, 0] >> 48 == 1, BLOCK_RADIUS, RADIUS)
        return np.where((least < np.floor(most * similarity - 1e-9)) | ((most > SHORT_TO) & (d > radius)), np.int32(-1), d)

    return near


def _near_pairs(rows: np.ndarray, first: np.ndarray, n: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Near pairs (i, j, d) of rows of groups, which begin at ``first`` and have n rows. Of groups with more than SMALL / 2 of them a row there are none, but their rows that are near another come last."""
    found, mates, count = [np.zeros((0, 4), np.int64)], np.zeros(len(rows), bool), np.zeros(len(n), np.int64)
    open_ = np.arange(len(n))
    for step in range(1, int(n.max(initial=1))):
        open_ = open_[n[open_] > step]
        runs = n[open_] - step
        i, group = np.repeat(first[open_], runs) + _ranges(runs), np.repeat(open_, runs)
        d = near(rows[i], rows[i + step])
        i, group, d = i[d >= 0], group[d >= 0], d[d >= 0]
        if not len(i):
            continue
        mates[i] = mates[i + step] = True
        np.add.at(count, group, 1)
        few = 2 * count[group] <= SMALL * n[group]
        found.append(np.stack([i, i + step, d, group], axis=1)[few])
        # a group with many pairs is done once each of its rows is near another
        many = [g for g in np.unique(group[~few]).tolist() if mates[first[g] : first[g] + n[g]].all()]
        open_ = open_[~np.isin(open_, many)] if many else open_
    pairs, many = np.concatenate(found), 2 * count > SMALL * n
    pairs = pairs[~many[pairs[:, 3]]]
    at = np.repeat(first[many], n[many]) + _ranges(n[many])
    return pairs[:, 0], pairs[:, 1], pairs[:, 2], at[mates[at]]


def _meet(batches: Iterator[pa.RecordBatch], near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """(bucket, a, b, large) from rows in the order of (bucket, id): all pairs of buckets with up to SMALL lines; of larger ones each line with the first, which stands with itself too. Lines alone go.

    With ``near`` rows have the columns MET and results also d, -1 if the pair isn't near. Then buckets with up to MIDDLE lines give
    their near pairs only; one that has many of them counts as large, with those of its lines that are near another.
    """
    rows, held, most = None, None, SMALL if near is None else MIDDLE  # ``held``: the first line of a large bucket that goes on

    def out(a: np.ndarray, b: np.ndarray, large: bool, d: np.ndarray | None) -> pa.RecordBatch:
        arrays = [pa.array(b[:, 0]), pa.array(a[:, 1]), pa.array(b[:, 1]), pa.array(np.full(len(a), large))]
        arrays += [] if near is None else [pa.array((near(a, b) if d is None else d).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, ["bucket", "a", "b", "large", "d"][: len(arrays)])

    def give(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal held
        if not len(rows):
            return
        first = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[:1, 0] - 1))
        n, top = np.diff(np.append(first, len(rows))), rows[first]
        large = n > most
        if held is not None and rows[0, 0] == held[0]:
            large[0], top[0] = True, held
        held = top[-1] if large[-1] else None
        own = np.repeat(large, n)
        yield out(np.repeat(top, n, axis=0)[own], rows[own], True, None)
        first, n = first[~large & (n > 1)], n[~large & (n > 1)]
        if near is not None:
            i, j, d, dense = _near_pairs(rows, first, n, near)
            yield out(rows[i], rows[j], False, d)
            dense = rows[dense]
            new = np.flatnonzero(np.diff(dense[:, 0], prepend=dense[:1, 0] - 1))
            yield out(np.repeat(dense[new], np.diff(np.append(new, len(dense))), axis=0), dense, True, None)
            return
        for step in range(1, SMALL):
            own = np.repeat(first, np.maximum(n - step, 0)) + _ranges(np.maximum(n - step, 0))
            if not len(own):
                break
            yield out(rows[own], rows[own + step], False, None)

    for batch in batches:
        more = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in batch.schema.names], axis=1)
        rows = more if rows is None else np.concatenate([rows, more])
        if not len(rows):
            continue
        # the last bucket may go on in the next batch; of a large one nothing is kept back
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        cut = len(rows) if len(rows) - cut > most or held is not None and rows[-1, 0] == held[0] else cut
        yield from give(rows[:cut])
        rows = rows[cut:]
    if rows is not None:
        yield from give(rows)


def _ranges(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of some lengths, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "line")


def _differ(x: Side, y: Side) -> Column:
    bits = F.lit(0)
    for c in SKETCH:
        bits = bits + F.bit_count(x(c).bitwiseXOR(y(c)))
    return bits


def _far_apart(x: Side, y: Side, similarity: float) -> Column:
    """Do the sizes, or the SimHashes of lines that have one, rule out that two lines are similar?"""
    least, most = F.least(x("size"), y("size")), F.greatest(x("size"), y("size"))
    return (least < F.floor(most * similarity - 1e-9)) | ((most > SHORT_TO) & (_differ(x, y) > RADIUS))


def similar_lines(docs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """Groups (id, root) of lines that are linked by similarity. ``distinct``: id, at (where it stands), size, SimHash, other."""
    # an edit or more is allowed only from this size on; shorter lines are linked if they are equal
    least = next((n - 1 for n in range(1, 1 << 20) if int((1 - similarity) * n + 1e-9)), 1 << 20)
    wide = distinct.where(f"size >= {least}").select("id", "size", "other", *SKETCH)
    closeness, met = _nearness(similarity), None
    for part in range(PASSES):
        rows = wide.mapInArrow(freed(_explode(part)), "bucket long, id long, size int, s0 long, s1 long, s2 long, s3 long")
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", "id")
        own = stage(rows.mapInArrow(freed(lambda batches: _meet(batches, closeness)), "bucket long, a long, b long, large boolean, d int"), "lines_met")
        met = own if met is None else met.unionByName(own)
    other = lambda c: F.col(f"to_{c}")
    left = distinct.select(F.col("id").alias("a"), "size", *SKETCH)
    right = distinct.select(F.col("id").alias("b"), *(F.col(c).alias(f"to_{c}") for c in ("size", *SKETCH)))

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.join(left, "a").join(right, "b").where(~_far_apart(F.col, other, similarity)).select("a", "b", _differ(F.col, other).alias("d"))

    pairs = stage(met.where("a <> b and d >= 0").select("a", "b", "d").distinct(), "lines_near")
    members = stage(met.where("large").select("bucket", F.col("b").alias("id")), "lines_members")
    discard(met)
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, out = [], []
                for row in batch.slice(at, 64).to_pylist():
                    lines = normalised(row["text"])
                    ids += [x["id"] for x in row["wanted"]]
                    out += [lines[x["line"]].decode("utf-8", "replace") for x in row["wanted"]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "x"])

    def texts_of(pairs: DataFrame) -> DataFrame:
        """(id, x) of the lines of pairs, by one pass over the documents that hold the first of their copies."""
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        by_text = wanted.join(distinct, "id").groupBy("at.doc_id", "at.th").agg(F.collect_list(F.struct("id", "at.line")).alias("wanted"))
        by_text = sized(stage(by_text, "lines_wanted"))
        return stage(docs.join(by_text, same_document(docs, by_text)).select("wanted", "text").mapInArrow(freed(pick), "id long, x string"), "lines_texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            yield batch.select(["a", "b"]).filter(pa.array(similar_pairs(xs, ys, similarity)))

    def check(pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        texts = texts_of(pairs) if texts is None else texts
        x, y = texts.select(F.col("id").alias("a"), "x"), texts.select(F.col("id").alias("b"), F.col("x").alias("y"))
        return pairs.join(x, "a").join(y, "b").mapInArrow(freed(compare), "a long, b long")

    def bound(named: DataFrame) -> DataFrame:
        low, reach = F.floor(F.col("size") * similarity - 1e-9), F.ceil(F.col("size") / similarity + 1e-9)
        return named.select("id").join(distinct, "id").select("id", "size", *SKETCH, low.alias("low"), reach.alias("reach"))

    fits = lambda p, q: ~_far_apart(p, q, similarity)
    texts = texts_of(pairs)
    roots = _spanned(pairs, lambda p: check(p, texts))
    discard(texts, pairs)
    if members.isEmpty():
        return roots
    return linked_groups(members, lambda p: check(stage(near(p).select("a", "b"), "lines_pairs")), "lines_links", bound, fits, roots)


def _spanned(pairs: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Groups (id, root) of all pairs (a, b, d) that pass ``check``; pairs inside a group that is known are not checked.

    First each line is checked with the nearest line before it, then each two groups by their nearest lines, then all pairs that are left.
    """
    nearest = F.min(F.struct("d", "a", "b")).alias("p")
    roots, pick = None, pairs.groupBy("b").agg(nearest).select("p.a", "p.b")
    for turn in range(3):
        pick = stage(pick, "lines_picked")
        found = stage(check(pick), "lines_linked")
        roots = components(found, "lines_links") if roots is None else merge_components(roots, found, "lines_links")
        if turn == 2:
            return roots
        ra, rb = roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        left = pairs.join(pick, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left")
        left = left.select("a", "b", "d", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")
        pairs = stage(left, "lines_open")
        if pairs.isEmpty():
            return roots
        pick = pairs.groupBy(F.least("ra", "rb"), F.greatest("ra", "rb")).agg(nearest).select("p.a", "p.b") if turn == 0 else pairs.select("a", "b")
        pairs = pairs.select("a", "b", "d")


def repeated_lines(docs: DataFrame, least_chars: int, similarity: float) -> DataFrame:
    """doc_id, th, line of each line that goes. ``docs``: doc_id, th, text, one row each."""
    lines = stage(line_table(docs, least_chars), "lines_all")
    kept = [F.first(c).alias(c) for c in ("size", "other", *SKETCH)]
    distinct = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(_place()).alias("at"), *kept)
    distinct = stage(distinct.select(F.monotonically_increasing_id().alias("id"), "*"), "lines_distinct")
    roots = similar_lines(docs, distinct, similarity)
    named = distinct.join(roots, "id", "left").where("n > 1 or root is not null").select("h1", "h2", "at", F.coalesce("root", "id").alias("root"))
    named = stage(named, "lines_named")
    first = stage(named.groupBy("root").agg(F.min("at").alias("first")), "lines_first")
    keepers = sized(stage(named.join(first, "root").select("h1", "h2", "first"), "lines_keepers"))
    gone = lines.select("doc_id", "th", "line", "h1", "h2").join(keepers, ["h1", "h2"]).where(_place() != F.col("first"))
    gone = stage(gone.groupBy("doc_id", "th").agg(F.collect_list("line").alias("gone")), "lines_gone")
    discard(lines, distinct)
    return gone


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, similarity: float = SIMILARITY) -> DataFrame:
    """The columns of ``docs`` with the text left, and n_lines, n_removed (replaced if there are such columns).

    Lines are linked if they are equal when normalised, or meet in a bucket and are similar in edits. Lines of up to SHORT_TO
    characters meet whenever they are similar. Longer ones meet if their SimHashes (see ``feature_matrix``) agree in a
    block, which all do that differ in fewer bits than there are blocks in a partition, or in one of their least grams,
    as nearly all do whose edits are in one place; only the latter may differ in more than BLOCK_RADIUS bits. Of each connected group the first line stays:
    the one with the least doc_id (null comes last), hash of the text and number. Lines whose normalised
    form is empty, or has fewer than ``least_chars`` bytes, stay. Rows that agree in doc_id and text are one document and
    get equal results. A null text stays null with 0 lines.
    """
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), "doc_id", text_key().alias("th"), F.col("text").cast("string").alias("text"))
    texts = rows.where("text is not null").select("doc_id", "th", "text")
    if _repeated(rows):
        texts = stage(texts.dropDuplicates(["doc_id", "th"]), "lines_documents")
    gone = sized(repeated_lines(texts, least_chars, similarity))
    joined = rows.join(gone, same_document(rows, gone), "left").select("row", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), rows["text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                left, count, removed = [], [], []
                for text, gone in zip(part.column("text"), part.column("gone")):
                    text, drop = text.as_py(), set(gone.as_py())
                    lines = (text or "").split("\n")
                    left.append("\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text)
                    count.append(0 if text is None else len(lines))
                    removed.append(len(drop))
                arrays = [part.column("row"), pa.array(left, pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "left", "n_lines", "n_removed"])

    out = joined.mapInArrow(freed(cut), joined.select("row").schema.add("left", "string").add("n_lines", "long").add("n_removed", "long"))
    kept = [F.col("left").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*kept, "n_lines", "n_removed")


def _repeated(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id", "th").count().where("count > 1").isEmpty()

"""Byte strings that occur twice in a corpus: sorted suffixes and prefixes at sampled places, without pairs.

Every string of ``length`` bytes holds the least hash of its ``gram``-byte strings at a place that depends on
its bytes only, its anchor. Strings with an equal anchor gram are compared by sorting what stands right and
left of their anchors; neighbours in these orders have the longest common parts.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from karavel.llm.common import CHUNK, _power_tables, chunks, mix, same_document, stage, text_bytes

LENGTH, GRAM = 400, 64
SHALLOW = 128  # depth to which multikey quicksort goes; longer common prefixes are sorted with blind tries
WORD = 8  # bytes that count as one character of the quicksort
GROUP_MAX = 4096  # strings sorted together; larger groups are split by more of their context first
SLICE = 1 << 23  # bytes of a text looked at together


def common_prefix(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # equal up to low, different somewhere before high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def blind_trie(strings: list[bytes], members: list[int]) -> list[int]:
    """Members in the order of their strings. An inner node is [depth, children by byte], a leaf a list of equal members.

    A string walks down by the bytes at the nodes' depths only, is compared once with the leaf it meets, and
    branches off at the depth where the two differ. A string that ends there takes the branch -1.
    """
    at = lambda s, depth: s[depth] if depth < len(s) else -1
    root: tuple | list = [members[0]]
    for m in members[1:]:
        s, path, node = strings[m], [], root
        while isinstance(node, tuple):
            key = at(s, node[0])
            if key not in node[1]:
                key = next(iter(node[1]))
            path.append((node, key))
            node = node[1][key]
        other = strings[node[0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node.append(m)
            continue
        k = 0
        while k < len(path) and path[k][0][0] < depth:
            k += 1
        below = path[k][0] if k < len(path) else node
        if k < len(path) and below[0] == depth:
            below[1][at(s, depth)] = [m]
            continue
        branch = (depth, {at(other, depth): below, at(s, depth): [m]})
        if k:
            path[k - 1][0][1][path[k - 1][1]] = branch
        else:
            root = branch
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            out += node
        else:
            todo += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings, and the common prefix of each with the one before it (0 for the first)."""
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            out += blind_trie(strings, group)
        else:
            word = [strings[i][depth : depth + WORD] for i in group]
            pivot = sorted((word[0], word[len(word) // 2], word[-1]))[1]
            less, same, more = [], [], []
            for i, w in zip(group, word):
                (less if w < pivot else same if w == pivot else more).append(i)
            todo.append((more, depth))
            if len(pivot) < WORD:  # they end here and are equal
                todo += [([i], depth) for i in reversed(same)]
            else:
                todo.append((same, depth + WORD))
            todo.append((less, depth))
    return out, [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(out[:-1], out[1:])]


class RangeMinimum:
    def __init__(self, values: list[int]):
        self.rows = [values]
        while 2 * (1 << (len(self.rows) - 1)) <= len(values):
            step, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(list(map(min, last, last[step:])))

    def least(self, a: int, b: int) -> int:
        """Of values[a:b], which is not empty."""
        k = (b - a).bit_length() - 1
        return min(self.rows[k][a], self.rows[k][b - (1 << k)])


def repeated_offsets(texts: list[bytes], anchors: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each text the ranges of d for which its ``length`` bytes from d before its anchor stand likewise in another text.

    Right parts are sorted; going from long to short common prefixes, groups of neighbours are merged, the
    smaller into the larger, each kept in the order of left parts. A member gets its neighbours of the other group there.
    """
    size = len(texts)
    order, common = deep_shallow_sort([x[a:] for x, a in zip(texts, anchors)])
    left, left_common = deep_shallow_sort([x[:a][::-1] for x, a in zip(texts, anchors)])
    rank = [0] * size
    for r, i in enumerate(left):
        rank[i] = r
    shared = RangeMinimum(left_common)
    found: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    group = list(range(size))  # by place in the right order, its group's name
    members = [[rank[i]] for i in order]
    where = {rank[i]: place for place, i in enumerate(order)}

    def meet(x: int, y: int, right: int) -> None:
        both = shared.least(min(x, y) + 1, max(x, y) + 1)
        if both + right >= length:
            found[left[x]].append((length - right, both))
            found[left[y]].append((length - right, both))

    for place in sorted(range(1, size), key=lambda p: -common[p]):
        right = min(common[place], length)
        a, b = group[place - 1], group[place]
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        for x in small:
            k = bisect.bisect_left(large, x)
            if k:
                meet(x, large[k - 1], right)
            if k < len(large):
                meet(x, large[k], right)
            large.insert(k, x)
            group[where[x]] = a
        members[b] = []
    return found


def anchor_runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``length`` bytes inside the texts off[i]:off[i+1] of up to 16 MB: text, place, first and last start, gram hash."""
    empty = np.zeros(0, np.int64)
    if len(buf) < length:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    powers, inverse = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[: len(buf)], out=sums[1:])
    n = len(buf) - gram + 1
    h = mix((sums[gram:] - sums[:-gram]) * inverse[:n])
    # the least of the upper 40 bits, the first of equal ones: it depends on the bytes of the string only
    least = (h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = [np.arange(a, b - length + 1) for a, b in zip(off[:-1].tolist(), off[1:].tolist()) if b - a >= length]
    if not starts:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    p = np.concatenate(starts)
    at = anchor[p]
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    text = np.searchsorted(off, p[first], "right") - 1
    return text, at[first], p[first], p[last], h[at[first]]


def anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, th, a (place of the anchor), lo and hi (the strings start hi..lo bytes before it), k (its hash), s1 and s2 (a 128-bit hash of all these strings' bytes)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=CHUNK):
                buf, off = text_bytes(part.column("text"))
                step = SLICE if len(buf) > SLICE else max(len(buf), 1)
                for base in range(0, len(buf), step):
                    piece = buf[base : base + step + length - 1]
                    text, at, first, last, k = anchor_runs(piece, np.clip(off - base, 0, len(piece)), length, gram)
                    raw = piece.tobytes()
                    digest = b"".join(hashlib.blake2b(raw[a : b + length], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist()))
                    s = np.frombuffer(digest, "<i8").reshape(-1, 2)
                    rows, begin = pa.array(text), off[text] - base if len(text) else text
                    arrays = [part.column("doc_id").take(rows), part.column("th").take(rows), pa.array(at - begin), pa.array((at - last).astype(np.int32)), pa.array((at - first).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(k.view(np.int64)), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy())], ["doc_id", "th", "a", "lo", "hi", "k", "s1", "s2"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "th", "text").mapInArrow(make, f"doc_id {kind}, th long, a long, lo int, hi int, k long, s1 long, s2 long")


def context_rows(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """The bytes of one place of every distinct span: k, s1, s2, n, x, off (of the anchor in x), lo, hi."""
    by_doc = spans.groupBy("one.doc_id", "one.th").agg(F.collect_list(F.struct("k", "s1", "s2", "n", "one.a", "lo", "hi")).alias("spans"))
    by_doc = stage(by_doc, "repeats_places")
    rows = docs.join(by_doc, same_document(docs, by_doc)).select("text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                raw, rows = text.as_py().encode(), spans.as_py()
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    numbers = [pa.array([x[c] for x in part], t) for c, t in (("k", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()))]
                    x = pa.array([raw[x["a"] - x["hi"] : x["a"] - x["lo"] + length] for x in part], pa.binary())
                    more = [pa.array([x[c] for x in part], pa.int32()) for c in ("hi", "lo", "hi")]
                    yield pa.RecordBatch.from_arrays([*numbers, x, *more], ["k", "s1", "s2", "n", "x", "off", "lo", "hi"])

    return rows.mapInArrow(cut, "k long, s1 long, s2 long, n long, x binary, off int, lo int, hi int")


WORK = "k long, s1 long, s2 long, n long, x binary, off int, lo int, hi int, g1 long, g2 long, q1 long, q2 long, least int, most int"


def split_groups(rows: DataFrame, length: int) -> DataFrame:
    """Each span twice, for the nearer and the farther half of its starts, grouped by the bytes that all strings of the half share.

    Strings that start d bytes before the anchor, least <= d <= most, all hold the bytes from ``least`` before it to
    ``most`` before the farthest end, so equal strings stay in one group.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                middle = (r["least"] + r["most"]) // 2
                for least, most in ((r["least"], middle), (middle + 1, r["most"])):
                    lo, hi = max(r["lo"], least), min(r["hi"], most)
                    if lo > hi:
                        continue
                    a, x = r["off"], r["x"]
                    core = hashlib.blake2b(x[a - least : a - most + length] + b"%d" % least, digest_size=16).digest()
                    own = x[a - hi : a - lo + length]
                    q = hashlib.blake2b(own, digest_size=16).digest()
                    number = lambda b: int.from_bytes(b, "little", signed=True)
                    out.append(r | {"x": own, "off": hi, "lo": lo, "hi": hi, "g1": number(core[:8]), "g2": number(core[8:]), "q1": number(q[:8]), "q2": number(q[8:]), "least": least, "most": most})
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return rows.mapInArrow(split, WORK)


def sorted_groups(rows: DataFrame, length: int) -> DataFrame:
    """k, s1, s2, d1, d2: starts d1..d2 bytes before the anchor are those of strings that occur again, found by sorting each group."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column("members"):
                rows, out = group.as_py(), []
                for r, ranges in zip(rows, repeated_offsets([r["x"] for r in rows], [r["off"] for r in rows], length)):
                    if r["n"] > 1:
                        ranges = [(r["lo"], r["hi"])]
                    ranges = sorted((max(a, r["lo"]), min(b, r["hi"])) for a, b in ranges)
                    end = None
                    for a, b in ranges:
                        if a <= b and (end is None or b > end):
                            out.append((r["k"], r["s1"], r["s2"], a if end is None else max(a, end + 1), b))
                            end = b
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64() if i < 3 else pa.int32()) for i in range(5)], ["k", "s1", "s2", "d1", "d2"])

    members = rows.groupBy("g1", "g2").agg(F.collect_list(F.struct("k", "s1", "s2", "n", "x", "off", "lo", "hi")).alias("members"))
    return members.mapInArrow(solve, "k long, s1 long, s2 long, d1 int, d2 int")


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_max: int = GROUP_MAX) -> DataFrame:
    """doc_id, th, start, end: byte ranges (they may overlap) covered by ``length``-byte strings that also start anywhere else.

    ``docs``: doc_id, th, text, with no null text. Rows that repeat are each a place of their own.
    Places with equal bytes around their anchors are counted, one of them is sorted in their stead. A group of more than
    ``group_max`` different ones is split by longer shared context until it is small or all the same.
    """
    anchors = stage(anchor_table(docs, length, gram), "repeats_anchors")
    grams = anchors.groupBy("k").agg(F.count("*").alias("c"), *(f(s).alias(f.__name__ + s) for s in ("s1", "s2") for f in (F.min, F.max)))
    grams = grams.where("c > 1").select("k", F.expr("mins1 <> maxs1 or mins2 <> maxs2").alias("differ"))
    again = stage(anchors.join(stage(grams, "repeats_grams"), "k"), "repeats_again")
    covered = lambda near, far: (F.struct((F.col("a") - F.col(far)).alias("start"), (F.col("a") - F.col(near) + length).alias("end")))
    equal = again.where("not differ").select("doc_id", "th", covered("lo", "hi").alias("r"))

    spans = again.where("differ").groupBy("k", "s1", "s2").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min(F.struct("doc_id", "th", "a")).alias("one"))
    spans = context_rows(docs.dropDuplicates(["doc_id", "th"]) if _repeated(docs) else docs, stage(spans, "repeats_spans"), length)
    number = lambda c: F.col(c).cast("long")
    start = [number("k").alias("g1"), F.lit(0).cast("long").alias("g2"), F.col("s1").alias("q1"), F.col("s2").alias("q2"), F.lit(0).alias("least"), F.lit(length - gram).alias("most")]
    work, found = stage(spans.select("*", *start), "repeats_work"), []
    while True:
        groups = work.groupBy("g1", "g2").agg(F.count("*").alias("rows"), F.sum("n").alias("places"), *(f(s).alias(f.__name__ + s) for s in ("q1", "q2") for f in (F.min, F.max)))
        groups = groups.where("places > 1").select("g1", "g2", F.expr("case when minq1 = maxq1 and minq2 = maxq2 then 0 when rows <= {m} then 1 else 2 end".format(m=group_max)).alias("state"))
        groups = stage(groups, "repeats_groups")
        rows = work.join(groups, ["g1", "g2"])
        found.append(stage(rows.where("state = 0").select("k", "s1", "s2", F.col("lo").alias("d1"), F.col("hi").alias("d2")), "repeats_same"))
        found.append(stage(sorted_groups(rows.where("state = 1"), length), "repeats_sorted"))
        if groups.where("state = 2").isEmpty():
            break
        work = stage(split_groups(rows.where("state = 2").drop("state").select(*work.columns), length), "repeats_work")
    ranges = found[0]
    for more in found[1:]:
        ranges = ranges.unionByName(more)
    ranges = stage(ranges, "repeats_ranges")
    other = again.where("differ").join(ranges, ["k", "s1", "s2"]).select("doc_id", "th", covered("d1", "d2").alias("r"))
    return equal.unionByName(other).select("doc_id", "th", "r.start", "r.end")


def _repeated(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id", "th").count().where("count > 1").isEmpty()


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_max: int = GROUP_MAX) -> DataFrame:
    """doc_id, n_bytes, spans (maximal ranges removed, as start and end), kept (the bytes left) of every document.

    A byte goes if a ``length``-byte string over it also starts elsewhere in the corpus, judged on the input; no
    string reaches over two documents. Null text: no bytes. Texts shorter than ``length`` stay. Repeated rows
    repeat each other, so both lose what is long enough. Other columns are not read.
    """
    if not 0 < gram <= length:
        raise ValueError("the gram has to fit into the string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    ranges = find_repeats(docs.where(F.octet_length("text") >= length), length, gram, group_max)
    gone = stage(ranges.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("gone")), "repeats_gone")
    rows = docs.join(gone, same_document(docs, gone), "left").select(docs["doc_id"], "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone")):
                raw, runs = text.as_py().encode(), []
                for a, b in sorted((x["start"], x["end"]) for x in gone.as_py() or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                sizes.append(len(raw))
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else raw)
                spans.append([{"start": a, "end": b} for a, b in runs])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")

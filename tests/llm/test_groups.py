"""Operators that compare texts: repeated bytes, benchmark passages, near copies, lines; each against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from karavel.llm import common, decontaminate, line_dedup, near_dedup, queries, suffix_dedup
from tests.llm.conftest import find, multiset_shingles, words

FOLDER = "/root/testdata/sf0.001"


# -- helpers ---------------------------------------------------------------------------------------------------


def test_workers_give_memory_back():
    """What a task used and freed must not stay with its worker, which lives on beside those of other stages."""
    import os

    def held():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGESIZE") / 1e6

    def run(batches):
        for batch in batches:
            common.Words(batch.column(0))
            large = [pa.array(np.arange(1 << 13)).cast(pa.float64()) for _ in range(3000)]
            yield pa.RecordBatch.from_arrays([pa.array([len(large)])], ["n"])

    common.give_back()
    before = held()
    (out,) = common.freed(run)(iter([pa.RecordBatch.from_arrays([pa.array(["a b " * 1000])], ["text"])]))
    assert out.column(0).to_pylist() == [3000] and held() - before < 40 and len(common._powers) == 1


def test_words_and_windows_of_texts():
    texts = ["a bb  a bb", None, "", " x\t", "a bb", "é é a"]
    found = common.Words(pa.array(texts))
    assert np.diff(found.first).tolist() == [len(words(t)) for t in texts]
    h = found.hashes
    assert h[0] == h[2] == h[5] and h[1] == h[3] and h[0] != h[1]
    runs, bounds = found.windows(2, short=True)
    assert np.diff(bounds).tolist() == [3, 0, 0, 1, 1, 1] and runs[0] == runs[2] == runs[4]


def test_components_of_random_edges(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5001 + i) for i in range(300)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        parent[find(parent, a)] = find(parent, b)
    got = {r.id: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    groups = {}
    for x, root in got.items():
        groups.setdefault(root, set()).add(find(parent, x))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(parent, x) for x in got})
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_all_links_of_mixed_buckets_are_found(spark):
    r = random.Random(7)
    value = {i: r.randint(0, 3000) for i in range(500)}
    rows = [(i // 250, i) for i in value] + [(9, i) for i in list(value)[::3]]
    buckets = common.stage(spark.createDataFrame(rows, "bucket long, id long"), "t")
    table = F.create_map(*[F.lit(x) for i, v in value.items() for x in (i, v)])

    def verify(pairs):
        return pairs.where(F.abs(table[F.col("a").cast("int")] - table[F.col("b").cast("int")]) <= 5)

    got = {x.id: x.root for x in common.linked_groups(buckets, verify, "t").collect()}
    parent = {i: i for i in value}
    for b in {b for b, _ in rows}:
        inside = [i for bb, i in rows if bb == b]
        for i in inside:
            for j in inside:
                if abs(value[i] - value[j]) <= 5:
                    parent[find(parent, i)] = find(parent, j)
    name = {}
    for i in value:
        assert name.setdefault(find(parent, i), got.get(i, i)) == got.get(i, i)
    assert len(set(name.values())) == len(name)


# -- repeated bytes --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shallow", [0, 8, 128])
def test_deep_shallow_order(shallow):
    r = random.Random(5)
    for _ in range(200):
        xs = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 40))]
        order, common_ = suffix_dedup.deep_shallow_sort(xs, shallow)
        assert [xs[i] for i in order] == sorted(xs) and sorted(order) == list(range(len(xs)))
        for a, b, n in zip(order[:-1], order[1:], common_[1:]):
            assert xs[a][:n] == xs[b][:n] and xs[a][n : n + 1] != xs[b][n : n + 1] or xs[a] == xs[b]


def plain_removal(rows, length):
    texts = [(i, (x or "").encode()) for i, x in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(frame):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return sorted([tuple(r) for r in frame.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()], key=str)


@pytest.mark.parametrize("length, gram, most", [(12, 5, 4096), (12, 5, 2), (10, 10, 5)])
def test_repeated_bytes_with_small_and_split_groups(spark, length, gram, most):
    r = random.Random(9)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(40)]
    rows += [(3, rows[3][1]), (None, "abab" * 10), (None, None), (77, "a" * 50), (78, "é" * 20), (79, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(suffix_dedup.remove_repeats(docs, length, gram, most)) == plain_removal(rows, length)


def test_repeated_bytes_of_the_table(spark, source, none):
    got = sorted([tuple(r) for r in queries.op1_suffix_dedup(spark, FOLDER).collect()], key=str)
    want = plain_removal([(r.doc_id, r.text) for r in source.collect()], 400)
    assert got == want and any(x[2] for x in want)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_anchors_of_a_text_cut_into_slices(monkeypatch, spark):
    r = random.Random(1)
    part = "".join(r.choice("abcd") for _ in range(300))
    rows = [(1, part * 4), (2, "x" + part + "y" * 700 + part), (3, "".join(r.choice("abcd") for _ in range(900)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit(1).cast("long"))
    make = suffix_dedup.anchor_table(docs, 40, 16)
    whole = {(x.doc_id, x.a - d) for x in make.collect() for d in range(x.lo, x.hi + 1)}
    assert whole == {(i, p) for i, t in rows for p in range(len(t) - 39)}


# -- benchmark passages ----------------------------------------------------------------------------------------


def plain_leaks(docs, items, k=5):
    import regex

    split = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    found = set()
    for item, text in items:
        ws = split(text)
        size, kk = len(ws), min(k, len(ws))
        if not ws:
            continue
        own = multiset_shingles(ws, kk)
        for doc, t in docs:
            ds = split(t)
            for s in range(max(1, len(ds) - size + 1)):
                window = multiset_shingles(ds[s : s + size], kk)
                shared = sum((window & own).values())
                if shared and 100 * shared >= 80 * (sum(window.values()) + sum(own.values()) - shared):
                    found.add((doc, item))
    return found


def test_leaks_with_changes_short_items_and_odd_documents(spark, odd, none):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(1, make(30)), (2, make(60)), (3, ["only", "three", "words"]), (4, make(30)), (5, ["a"] * 25), (6, [])]
    items = [(i, " ".join(ws)) for i, ws in items] + [(7, None), (None, " ".join(make(20)))]
    docs = [(0, None), (1, "")]
    for n, (item, text) in enumerate(items[:5]):
        ws = text.split()
        docs.append((10 + n, " ".join(make(25) + ws + make(40))))
        docs.append((20 + n, " ".join(make(5) + ws[1:])))  # the first word is missing
        docs.append((30 + n, " ".join(ws[: len(ws) // 2] + ["other"] + ws[len(ws) // 2 :])))
        docs.append((40 + n, ", ".join(ws).upper()))
    docs += [(60, "a " * 23), (61, "a " * 400), (None, items[0][1]), (10, docs[2][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").withColumn("th", F.lit("x"))
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(d, b).collect()}
    assert got == plain_leaks(docs, items) and len(got) > 15
    bad = {x for x, _ in got}
    left = decontaminate.remove_leaks(d, b)
    assert Counter(x.doc_id for x in left.collect()) == Counter(x for x, _ in docs if x not in bad)
    assert decontaminate.find_leaks(none, b).count() == 0 and decontaminate.find_leaks(d, b.where("false")).count() == 0
    assert decontaminate.remove_leaks(odd, b).columns == odd.columns and decontaminate.remove_leaks(odd, b).count() == odd.count()


def test_fingerprints_within_the_radius_share_a_block(spark):
    r = random.Random(3)
    rows = []
    for _ in range(300):
        f = r.getrandbits(64)
        g = f
        for bit in r.sample(range(64), decontaminate.RADIUS):
            g ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (f, g)))
    pairs = spark.createDataFrame(rows, "f long, g long")
    block = lambda c: decontaminate.hamming_blocks(c, decontaminate.RADIUS)
    assert pairs.where(F.arrays_overlap(block("f"), block("g"))).count() == len(rows)


def test_main_path_is_native(spark):
    docs, items = queries.table(spark, FOLDER, "documents"), queries.table(spark, FOLDER, "benchmark")
    plan = decontaminate.find_leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    with open(decontaminate.__file__) as code:
        assert not {"udf", "mapInArrow", "mapInPandas", "rdd"} & set(code.read().replace("(", " ").replace(".", " ").split())


# -- near copies -----------------------------------------------------------------------------------------------


def plain_components(rows, k, percent=80):
    sets = []
    for i, text in rows:
        ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((i, frozenset(tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))) if ws else frozenset()))
    parent = {n: n for n in range(len(sets))}
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                parent[find(parent, a)] = find(parent, b)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            root = find(parent, n)
            least[root] = min(i, least.get(root, i))
    return sorted(((i, len(s), least.get(find(parent, n)), i == least.get(find(parent, n))) for n, (i, s) in enumerate(sets)), key=str)


def near_rows(seed=4):
    """Copies with few and with many changes around the limit of similarity, and chains of them."""
    r = random.Random(seed)
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice("abcdefghij") * r.randint(1, 5) for _ in range(r.choice((3, 30, 120, 400)))]
        for _ in range(r.randint(1, 9)):
            rows.append((n, " ".join(base)))
            n += 1
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                base = list(base)
                base[r.randrange(len(base))] = f"x{r.randint(0, 99)}"
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "One Two"), (504, "one two"), (504, "one two"), (None, rows[0][1]), (None, rows[5][1])]


@pytest.mark.parametrize("k", [4, 5])
def test_near_copies_against_all_pairs(spark, k):
    rows = near_rows()
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()], key=str)
    assert got == plain_components(rows, k)


def test_near_copies_of_the_table(spark, source, odd, none):
    got = sorted([tuple(r) for r in queries.op6_near_dedup(spark, FOLDER).collect()], key=str)
    assert got == plain_components([(r.doc_id, r.text) for r in source.collect()], 4)
    assert near_dedup.near_duplicates(none).count() == 0
    left = near_dedup.one_of_each(odd)
    assert left.columns == odd.columns
    ids = sorted((r.doc_id for r in left.collect()), key=str)
    assert ids == sorted([1, 2, None, 3, 4, 5, 6, 8, 9], key=str)  # the two long ones and the three equal lines are one each


def test_a_large_group_of_copies_costs_one_pair_a_member(spark, monkeypatch):
    r = random.Random(6)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(200)]
    rows = [(i, " ".join(base[: i % 190] + [f"x{i}"] + base[i % 190 :])) for i in range(300)]
    counts = []
    stage = common.stage
    monkeypatch.setattr(common, "stage", lambda df, *a: counts.append((df.columns, out.count())) or out if (out := stage(df, *a)) is not None else out)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=5)
    assert {r.component_id for r in found.collect()} == {0}
    assert max(n for columns, n in counts if columns == ["a", "b"]) < 40 * len(rows)


def test_registers_merge_and_estimate():
    sketch, r = near_dedup.SetSketch(), np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 3000).astype(np.uint64), r.integers(0, 2**63, 3000).astype(np.uint64)
    parts = sketch.of(np.concatenate([a, b, a, b]), np.array([0, 3000, 6000, 12000]))
    assert (np.maximum(parts[0], parts[1]) == parts[2]).all()
    for shared, same in ((2000, False), (2900, True)):  # similarities 0.5 and 0.93
        c = np.concatenate([a[:shared], b[: 3000 - shared]])
        x = sketch.of(np.concatenate([a, c]), np.array([0, 3000, 6000]))
        assert bool(sketch.may_reach(x[:1], x[1:], np.array([3000]), np.array([3000]), 0.8)[0]) is same


# -- lines -----------------------------------------------------------------------------------------------------


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == lev(a, b)


def test_edit_distances_of_pairs_at_once(monkeypatch):
    r = random.Random(2)
    for k in range(9):
        pairs = [("".join(r.choice("ab") for _ in range(r.randint(0, 20))), "".join(r.choice("ab") for _ in range(r.randint(0, 20)))) for _ in range(200)]
        pairs = sorted([p for p in pairs if abs(len(p[0]) - len(p[1])) <= k], key=lambda p: len(p[0]) + len(p[1]))
        assert line_dedup.banded_distances(*map(list, zip(*pairs)), k).tolist() == [min(lev(*p), k + 1) for p in pairs]
    xs = ["".join(r.choice("abcd é漢😀") for _ in range(r.choice([0, 1, 9, 10, 35, 300, 1200, 3000]))) for _ in range(150)]
    ys = [x if r.random() < 0.2 else "".join(r.choice(["", "x", "xy"]) if r.random() < 0.1 else c for c in x) if r.random() < 0.8 else r.choice(xs) for x in xs]
    xs, ys = [*xs, "a" * 300, "a" * 9], [*ys, "b" * 300, "a" * 8]
    want = [line_dedup.similar(x, y, 0.9) for x, y in zip(xs, ys)]
    assert line_dedup.similar_pairs(xs, ys, 0.9).tolist() == want and 30 < sum(want) < 140
    assert line_dedup.similar_pairs([], [], 0.9).tolist() == []
    monkeypatch.setattr(line_dedup, "BAND", 20)  # as lines that are too long for a band
    assert line_dedup.similar_pairs(xs, ys, 0.9).tolist() == want


def meeting_points(lines):
    """The buckets of each line."""
    if not lines:
        return []
    sketch, other, chars = line_dedup.sketches(lines)
    blocks, out = line_dedup.block_buckets(sketch.view(np.int64), chars), []
    for i, x in enumerate(other):
        long = chars[i] >= line_dedup.FROM_CHARS
        grams = np.frombuffer(x[: 4 * line_dedup.COLUMNS * long], "<u4").reshape(-1, line_dedup.COLUMNS)
        found = set(blocks[i].tolist()) | set(line_dedup.gram_buckets(grams, chars[i : i + 1])[0].tolist()) - {-1} if long else set()
        out.append(found | {(x, "short") for x in np.frombuffer(x[4 * line_dedup.COLUMNS * long :], "<u4").tolist()})
    return out


def plain_lines(rows, least=line_dedup.LEAST_CHARS, similarity=line_dedup.SIMILARITY):
    """Lines removed by (doc_id, number): all pairs that are equal or share a bucket and are similar."""
    lines = [(i, n, x) for i, text in rows if text is not None for n, x in enumerate(line_dedup.normalised(text)) if len(x) >= least]
    points = meeting_points([x for _, _, x in lines])
    parent = {n: n for n in range(len(lines))}
    for a in range(len(lines)):
        for b in range(a):
            if find(parent, a) != find(parent, b) and (lines[a][2] == lines[b][2] or points[a] & points[b] and line_dedup.similar(lines[a][2].decode(), lines[b][2].decode(), similarity)):
                parent[find(parent, a)] = find(parent, b)
    first = {}
    for n, (i, number, _) in enumerate(lines):
        root = find(parent, n)
        first[root] = min(first.get(root, (i, number)), (i, number))
    return {(i, number) for n, (i, number, _) in enumerate(lines) if first[find(parent, n)] != (i, number)}


def test_lines_against_all_pairs(spark):
    r = random.Random(12)
    sentence = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))
    pool = [sentence(r.choice((3, 12, 60, 150))) for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            x = r.choice(pool) if r.random() < 0.6 else sentence(8)
            x = x.upper() if r.random() < 0.2 else x
            if r.random() < 0.5 and len(x) > 300:
                at = r.randrange(len(x))
                x = x[:at] + "z" + x[at + 1 :]
            lines.append(x + r.choice(("", ".", "  ")))
        rows.append((i, "\n".join(lines)))
    gone = plain_lines(rows)
    got = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(gone) > 30
    for i, text in rows:
        lines = text.split("\n")
        left = [x for n, x in enumerate(lines) if (i, n) not in gone]
        assert got[i].text == "\n".join(left) and got[i].n_lines == len(lines) and got[i].n_removed == len(lines) - len(left)


def test_lines_of_awkward_documents(odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"] and out.count() == odd.count()
    rows = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in out.collect()}
    assert rows[(1, "The same line of text stands in here.\nAnother one that is alone.")] == (2, 0)
    assert rows[(2, "")] == rows[(None, "")] == (1, 1)
    assert rows[(3, None)] == rows[(None, None)] == (0, 0) and rows[(4, "")] == (1, 0)
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_that_are_nearly_the_same_are_found(spark):
    r = random.Random(3)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(250))
    rows = [(i, long[: 40 * i] + "q" + long[40 * i + 1 :]) for i in range(1, 12)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(x.n_removed for x in out) >= 9 and next(x for x in out if x.doc_id == 1).n_removed == 0


def nearly_equal(r, n, change):
    """A line of n words and a changed one that is similar to it."""
    while True:
        x = [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n))]
        x.append(change(x[0]))
        a, b = (line_dedup.normalised(t)[0].decode() for t in x)
        if a != b and lev(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9):
            return x


def one_word(r):
    def change(x):
        ws = x.split()
        ws[r.randrange(len(ws))] = "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
        return " ".join(ws)

    return change


def letters(r, share):
    def change(x):
        for _ in range(max(1, int(share * len(x)))):
            at, way = r.randrange(len(x)), r.randrange(3)
            x = x[:at] + ("", "q", "q" + x[at])[way] + x[at + 1 :]
        return x

    return change


def test_nearly_equal_lines_of_any_length_are_found(spark):
    """Recall against edit similarity alone: variants of lines of 2 to 60 words, which need not share a fingerprint by this test."""
    r = random.Random(21)
    pairs = [nearly_equal(r, n, way) for n in (2, 5, 10, 25, 60) for way in (one_word(r), letters(r, 0), letters(r, 0.05)) for _ in range(12)]
    rows = [(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)]
    out = {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[2 * i] == 0 for i in range(len(pairs)))
    assert sum(out[2 * i + 1] for i in range(len(pairs))) >= 0.99 * len(pairs)


def test_parity_of_pairs_at_once(monkeypatch):
    r = random.Random(4)
    xs = ["".join(r.choice("abcdefgh é漢") for _ in range(r.choice([0, 1, 2, 9, 60, 400, 1200]))) for _ in range(60)]
    ys = [x if r.random() < 0.3 else "".join(c if r.random() < 0.93 else r.choice("xyz") for c in x) if r.random() < 0.6 else r.choice(xs) for x in xs]

    def odd(x):
        c, found = [ord(y) for y in x], Counter()
        for i in range(len(c) - 2):
            h = sum(v * int(o) for v, o in zip(c[i : i + 3], line_dedup.seeds(3, 8))) % 2**64
            found[int(line_dedup.mix(np.array([h], np.uint64))[0] >> np.uint64(40)) % 1024] += 1
        return {k for k, n in found.items() if n % 2}

    monkeypatch.setattr(line_dedup, "PAIRS_AT_ONCE", 7)
    assert line_dedup.odd_grams(xs, ys).tolist() == [len(odd(x) ^ odd(y)) for x, y in zip(xs, ys)]
    got = line_dedup.maybe_similar_pairs(xs, ys, 0.9).tolist()
    assert got == [line_dedup.maybe_similar(x, y, 0.9) for x, y in zip(xs, ys)] and not all(got)
    assert all(m or not line_dedup.similar(x, y, 0.9) for x, y, m in zip(xs, ys, got))


def test_fingerprints_of_lines_at_the_limit_agree():
    r = random.Random(22)
    for n in (3, 8, 20, 50):
        pairs = [[line_dedup.normalised(x)[0] for x in nearly_equal(r, n, letters(r, 0.1))] for _ in range(60)]
        points = meeting_points([x for p in pairs for x in p])
        assert np.mean([bool(a & b) for a, b in zip(points[::2], points[1::2])]) >= 0.9
        bits = line_dedup.sketches([x for p in pairs for x in p])[0]
        assert (np.bitwise_count(bits[::2] ^ bits[1::2]).sum(axis=1) <= line_dedup.RADIUS).all()
        assert all(line_dedup.maybe_similar(a.decode(), b.decode(), 0.9) for a, b in pairs)


def test_lines_within_the_guaranteed_bits_share_a_block():
    r = np.random.default_rng(24)
    bits = r.random((200, line_dedup.BLOCKS * line_dedup.BITS)) < 0.5
    other = bits.copy()
    for row in other:
        at = r.choice(len(row), line_dedup.BLOCKS - 1, replace=False)
        row[at] = ~row[at]
    chars = np.full(200, 80)
    a, b = (line_dedup.block_buckets(np.packbits(np.pad(x, ((0, 0), (0, 16))), axis=1).view("<i8"), chars) for x in (bits, other))
    assert (a == b).any(axis=1).all()


def test_short_lines_that_are_similar_always_meet():
    r = random.Random(25)
    for n in range(9, line_dedup.SHORT_TO + 1):
        for _ in range(60):
            a = "".join(r.choice("abc") for _ in range(n))
            b = a
            for _ in range(r.randint(1, n // 10 or 1)):
                at = r.randrange(len(b))
                b = b[:at] + ("", "z", "z" + b[at])[r.randrange(3)] + b[at + 1 :]
            if len(b) <= line_dedup.SHORT_TO and line_dedup.similar(a, b, 0.9):
                assert line_dedup.segments(a) & line_dedup.segments(b), (a, b)


def test_buckets_are_met_over_any_batches():
    r = np.random.default_rng(26)
    sizes = [1, 2, 3, 16, 17, 40, 1, 2, 60, 5]
    rows = np.concatenate([[(k, i) for i in range(n)] for k, n in enumerate(sizes)])
    for _ in range(40):
        cuts = np.sort(r.integers(0, len(rows) + 1, 4))
        batches = [pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["bucket", "id"]) for x in np.split(rows, cuts)]
        got = [tuple(x.values()) for b in line_dedup._meet(iter(batches)) for x in b.to_pylist()]
        want = [(k, i, j, False) for k, n in enumerate(sizes) if n <= 16 for i in range(n) for j in range(i + 1, n)]
        want += [(k, 0, i, True) for k, n in enumerate(sizes) if n > 16 for i in range(n)]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_lines_that_are_far_apart_meet_without_a_pair(monkeypatch):
    monkeypatch.setattr(line_dedup, "MIDDLE", 60)
    r = np.random.default_rng(27)
    near = line_dedup._nearness(0.9)
    rows = []
    for bucket, (n, groups) in enumerate([(2, 2), (2, 1), (16, 16), (16, 1), (50, 50), (50, 25), (50, 1), (60, 3), (61, 61), (90, 2)]):
        base = r.integers(-(2**63), 2**63, (groups, 4))
        for i in range(n):
            rows.append([bucket, len(rows), 300 + i % 20, *(base[i % groups] ^ (1 << r.integers(0, 60, 4)))])
    rows = np.array(rows)
    for _ in range(10):
        cuts = np.sort(r.integers(0, len(rows) + 1, 4))
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in x.T], ["bucket", *line_dedup.MET]) for x in np.split(rows, cuts)]
        got = [tuple(x.values()) for b in line_dedup._meet(iter(batches), near) for x in b.to_pylist()]
        pairs, members = {(k, a, b): d for k, a, b, _, d in got if a != b and d >= 0}, {(k, b) for k, _, b, large, _ in got if large}
        for k in range(10):
            own = rows[rows[:, 0] == k]
            i, j = np.triu_indices(len(own), 1)
            d = near(own[i], own[j])
            want = {(k, a, b): v for a, b, v in zip(own[i, 1].tolist(), own[j, 1].tolist(), d.tolist()) if v >= 0}
            found, held = {p: v for p, v in pairs.items() if p[0] == k}, {b for x, b in members if x == k}
            if len(own) > 60:  # all of them stay, each tried against the first
                assert held == set(own[:, 1].tolist()) and len(found) < len(own)
            elif 2 * len(want) > line_dedup.SMALL * len(own):  # many copies of one line: each tried against one
                assert held == {x for p in want for x in p[1:]} and len(found) < len(own)
            else:
                assert found == want and not held
            assert found.items() <= want.items()
    assert len(got) < 800  # of 4,000 pairs


def test_lines_that_meet_in_a_block_by_chance_give_no_pairs():
    near = line_dedup._nearness(0.9)
    bits = [0, 12, line_dedup.BLOCK_RADIUS, line_dedup.BLOCK_RADIUS + 1, line_dedup.RADIUS, line_dedup.RADIUS + 1]
    for kind, found in ((1, 3), (2, 5)):
        x = np.array([[(kind << 48) + 5, i, 200, 0, 0, 0, 0] for i in range(len(bits))])
        y = np.array([[(kind << 48) + 5, 10 + i, 205, *(-1 if n >= 64 * (k + 1) else (1 << max(0, n - 64 * k)) - 1 for k in range(4))] for i, n in enumerate(bits)])
        assert near(x, y).tolist() == bits[:found] + [-1] * (len(bits) - found)


def test_lines_with_a_part_replaced_meet_near_enough():
    r = random.Random(29)
    for n in (12, 30, 80):
        lines = [x.encode() for _ in range(150) for x in nearly_equal(r, n, lambda x: x[:9] + "".join(r.choice("etaoinshrdlu ") for _ in range(len(x) // 11)) + x[9 + len(x) // 11 :])]
        bits, other, chars = line_dedup.sketches(lines)
        grams = line_dedup.gram_buckets(np.frombuffer(b"".join(x[: 4 * line_dedup.COLUMNS] for x in other), "<u4").reshape(-1, line_dedup.COLUMNS), chars)
        d = np.bitwise_count(bits[::2] ^ bits[1::2]).sum(axis=1)
        blocks = line_dedup.block_buckets(bits, chars)
        by_gram, by_block = ((grams[::2] == grams[1::2]) & (grams[::2] >= 0)).any(axis=1), (blocks[::2] == blocks[1::2]).any(axis=1)
        assert (by_gram & (d <= line_dedup.RADIUS) | by_block & (d <= line_dedup.BLOCK_RADIUS)).mean() >= 0.99


def generated(plan):
    """Rows that Generate nodes of an executed plan made."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return generated(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return generated(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
    return own + sum(generated(plan.children().apply(i)) for i in range(plan.children().size()))


def test_members_of_the_largest_group_are_met_without_copies(spark):
    """Each pair between groups once; of a bucket with one large group only the few other members are given to classes of size."""
    r = random.Random(28)
    rows = [(b, 1000 * b + i, 1000 * b if i < big else 1000 * b + i - i % 2, n, r.randint(80, 130)) for b, big, n in ((1, 290, 300), (2, 0, 40), (3, 20, 41)) for i in range(n)]
    members = spark.createDataFrame([x[:4] for x in rows], "bucket long, id long, root long, n long")
    sizes = spark.createDataFrame([(x[1], x[4], int(0.9 * x[4]), int(x[4] / 0.9) + 1) for x in rows], "id long, size int, low int, reach int")
    pairs = common._pairs_between_groups(members, lambda named: named.join(sizes, "id").drop("root"), None, "t")
    got = [tuple(sorted(x)) for x in pairs.collect()]
    fits = lambda x, y: int(0.9 * x) <= y <= int(x / 0.9) + 1 and int(0.9 * y) <= x <= int(y / 0.9) + 1
    want = [(x[1], y[1]) for i, x in enumerate(rows) for y in rows[i + 1 :] if x[0] == y[0] and x[2] != y[2] and fits(x[4], y[4])]
    assert sorted(got) == sorted(want) and len(want) > 1000
    assert 0 < generated(pairs._jdf.queryExecution().executedPlan()) < 2 * 8 * (10 + 40 + 21)


def test_staged_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" ")))
    before = files()
    staged = common.stage(spark.range(1000).repartition("id"), "few")
    for _ in range(100):  # they go in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and staged.count() == 1000


def test_many_near_copies_of_one_line_and_common_beginnings(spark):
    r = random.Random(23)
    base = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20))
    rows = [(i, base[: i % 130] + chr(105 + i // 130) + base[i % 130 + 1 :]) for i in range(260)]
    rows += [(1000 + i, base[:50] + " ".join("".join(r.choice("ijklmnop") for _ in range(6)) for _ in range(20))) for i in range(150)]
    out = {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[i] for i in range(260)) == 259 and out[0] == 0 and not any(out[1000 + i] for i in range(150))


def test_short_lines_take_part_and_blank_ones_stay(spark):
    rows = [(1, "Read more\nThis one stands alone"), (2, "read more!\n\nNothing like it elsewhere"), (3, "Read more\n続く。\n---"), (4, "続く。\n\n---\nOK"), (5, "ok.")]
    out = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (rows[0][1], 0), 2: ("\nNothing like it elsewhere", 1), 3: ("続く。\n---", 1), 4: ("\n---\nOK", 1), 5: ("", 1)}

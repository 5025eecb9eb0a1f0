"""Periodic runs against every lag tried at every word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from karavel.llm.periodic_runs import digests, find_runs, lag_classes, periodic_runs, planted
from tests.llm.conftest import words


def every_run(w, least=12):
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 2 * q) and not any(r[:2] == (i, n) and q % r[2] == 0 for r in found):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def awkward(rnd):
    """Texts over few words: random, repeated parts with faults, stretches of one word, two phases of one period."""
    kind = rnd.randrange(4)
    if kind == 0:
        return [rnd.randint(0, rnd.choice([1, 1, 2, 5])) for _ in range(rnd.randint(0, 90))]
    if kind == 1:
        unit, out = [rnd.randint(0, 2) for _ in range(rnd.randint(1, 14))], []
        for _ in range(rnd.randint(1, 6)):
            out += unit * rnd.randint(1, 3) + [rnd.randint(0, 2)] * rnd.randint(0, 1)
        return out
    if kind == 2:
        stretch, out = [rnd.randint(0, 1)] * rnd.randint(5, 20), []
        for _ in range(rnd.randint(1, 5)):
            out += stretch + [rnd.randint(0, 2) for _ in range(rnd.randint(0, 2))]
        return out * rnd.randint(1, 3)
    unit = [rnd.randint(0, 1) for _ in range(rnd.randint(1, 5))] * 30
    return unit[: rnd.randint(0, 70)] + [2] * rnd.randint(0, 1) + unit[rnd.randint(0, 3) : rnd.randint(3, 70)]


@pytest.mark.parametrize("least", [2, 7, 12, 20])
def test_runs_equal_brute_force(least):
    rnd = random.Random(least)
    for _ in range(500):
        texts = [awkward(rnd) for _ in range(rnd.randint(0, 3))]
        first = np.cumsum([0, *map(len, texts)])
        flat = np.array([x + 7 for t in texts for x in t], np.uint64)
        got = [tuple(r) for r in periodic_runs(flat, first, least).tolist()]
        assert got == [(i, *r) for i, t in enumerate(texts) for r in every_run(t, least)], texts


def test_guaranteed_overlap():
    for least in (2, 7, 12, 20):
        lags = [(q, k) for low, high, k in lag_classes(200, least) for q in range(low, high)]
        assert [q for q, _ in lags] == list(range(1, len(lags) + 1))
        assert all(k <= max(least - q, q) for q, k in lags)


def test_many_equal_grams_are_not_paired():
    """One word, Fibonacci words and stretches of one word: pairs would be billions."""
    x, y = [0], [0, 1]
    while len(y) < 60_000:
        x, y = y, y + x
    for text in ([1] * 100_000, y, ([1] * 500 + [2]) * 100):
        runs = periodic_runs(np.array(text, np.uint64) + np.uint64(5), np.array([0, len(text)]))
        assert len(runs) and (runs[:, 2] >= 2 * runs[:, 3]).all()


def plain(doc_id, text):
    """The query's row, word by word."""
    ws = words(text)
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(ws)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
    runs = every_run(ws)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def rows_of(docs):
    return sorted(map(tuple, digests(find_runs(planted(docs))).collect()), key=str)


def test_query_equals_plain_code(source):
    some = source.where("length(text) < 3000")
    assert rows_of(some) == sorted((plain(r["doc_id"], r["text"]) for r in some.collect()), key=str)


def test_awkward_documents(spark, odd, none):
    assert rows_of(none) == []
    short = odd.where("text is null or length(text) < 10000")
    assert rows_of(short) == sorted((plain(r["doc_id"], r["text"]) for r in short.collect()), key=str)
    found = {r["doc_id"]: r for r in find_runs(odd.where("doc_id in (6, 7)")).collect()}
    assert found[6]["runs"] == found[7]["runs"] == []
    twice = spark.createDataFrame([(1, "x y " * 9 + "z"), (1, "x y " * 9 + "z"), (2, None)], "doc_id long, text string").collect()
    got = find_runs(spark.createDataFrame(twice)).collect()
    assert [(len(r["runs"]), r["collapsed"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(1, "x y z"), (1, "x y z"), (0, "")]

"""Quality trees: statistics word by word, trees node by node, accuracy on documents that were held out."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from karavel.llm.quality_classifier import BYTE_CLASSES, STATISTICS, Trees, bin_limits, classify, fit, grow, score_quality, statistics
from tests.llm.conftest import words


def plain(text):
    """The statistics of one text in plain code."""
    text, ws = text or "", words(text)
    if not ws:
        return dict.fromkeys(STATISTICS, 0.0)
    raw, n = text.encode(), len(ws)
    sizes = [len(w) for w in ws]
    mean = sum(sizes) / n
    out = {name: sum(b in members for b in raw) / len(text) for name, members in BYTE_CLASSES.items()}
    out["inner_bytes"] = sum(128 <= b < 192 for b in raw) / len(text)
    out["wide_chars"] = sum(b >= 192 for b in raw) / len(text)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = [any("A" <= c <= "Z" for c in w) for w in ws]
    lower = [any("a" <= c <= "z" or ord(c) >= 128 for c in w) for w in ws]
    stops = sum(w[-1] in ".,;:" for w in ws)

    def again(k):
        grams = [tuple(ws[i : i + k]) for i in range(n - k + 1)]
        return 1 - len(set(grams)) / len(grams) if grams else 0

    out |= {
        "log_words": math.log(1 + n), "word_chars": mean, "word_chars_spread": math.sqrt(max(sum(s * s for s in sizes) / n - mean**2, 0)),
        "longest_word": min(max(sizes), 100), "distinct_words": len(set(ws)) / n, "top_word": max(Counter(ws).values()) / n,
        "repeated_triples": again(3), "repeated_eights": again(8), "capital_words": sum("A" <= w[0] <= "Z" for w in ws) / n,
        "loud_words": sum(u and not x for u, x in zip(upper, lower)) / n, "stop_ends": stops / n,
        "symbol_ends": sum(w[-1] in "!?#*$%&|<>@^~=+_/\\{}[]" for w in ws) / n, "wordless": sum(not u and not x for u, x in zip(upper, lower)) / n,
        "log_lines": math.log(1 + len(lines)), "line_words": n / len(lines), "repeated_lines": (len(lines) - len(set(lines))) / len(lines),
        "sentence_words": min(n / max(stops, 1), 200),
    }
    return out


def test_statistics_equal_plain_code(source, odd):
    texts = [r["text"] for r in source.limit(60).collect()] + [r["text"] for r in odd.collect() if len(r["text"] or "") < 5000]
    got = statistics(pa.array(texts, pa.string()))
    want = np.array([[plain(t)[name] for name in STATISTICS] for t in texts])
    assert np.allclose(got, want, atol=1e-9)


def test_statistics_do_not_depend_on_neighbours():
    texts = ["a b c a b c\nx", "", None, "A! 1", "a b c a b c\nx"]
    together = statistics(pa.array(texts))
    assert np.array_equal(together, np.concatenate([statistics(pa.array([t], pa.string())) for t in texts]))


def test_trees_go_down_node_by_node():
    rnd = np.random.default_rng(1)
    trees = Trees(0.3, rnd.integers(0, 4, (7, 7)), rnd.random((7, 7)), rnd.normal(size=(7, 8)))
    x = rnd.random((50, 4))

    def walk(row):
        total = 0.3
        for f, c, leaf in zip(trees.feature, trees.limit, trees.leaf):
            i = 0
            while i < 7:
                i = 2 * i + 1 + (row[f[i]] > c[i])
            total += leaf[i - 7]
        return total

    assert np.allclose(trees.raw(x), [walk(r) for r in x])


def test_first_split_is_the_best_of_all():
    rnd = np.random.default_rng(2)
    x, y = rnd.integers(0, 9, (200, 3)).astype(float), rnd.random(200)
    y = (y + (x[:, 1] > 4) > 1).astype(float)
    grad, hess = 0.5 - y, np.full(200, 0.25)
    limits = bin_limits(x)
    binned = np.stack([np.searchsorted(limits[c], x[:, c]) for c in range(3)], axis=1)
    feature, limit, leaf, at = grow(binned, limits, grad, hess, 1)

    def gain(c, cut):
        sides = [x[:, c] <= cut, x[:, c] > cut]
        if min(hess[s].sum() for s in sides) < 1:
            return 0
        return sum(grad[s].sum() ** 2 / (hess[s].sum() + 1) for s in sides) - grad.sum() ** 2 / (hess.sum() + 1)

    best = max(gain(c, cut) for c in range(3) for cut in limits[c])
    assert math.isclose(gain(feature[0], limit[0]), best) and feature[0] == 1
    assert np.allclose(leaf, [-grad[at == i].sum() / (hess[at == i].sum() + 1) for i in (0, 1)])


def test_labels_of_one_kind_or_none():
    x, none = np.zeros((5, len(STATISTICS))), np.zeros(5, bool)
    assert len(fit(x, np.ones(5), np.ones(5), none).leaf) == 0
    assert math.isclose(fit(x, np.ones(5), np.ones(5), none).scores(x)[0], 6 / 7)
    assert fit(x[:0], np.ones(0), np.ones(0), none[:0]).scores(x)[0] == 0.5


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_held_out_accuracy(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = classify(docs, labels).join(labels, "doc_id").collect()
    for held_out in (True, False):
        own = [r for r in rows if r["held_out"] == held_out]
        assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == held_out for r in own)
        right = [[r["predicted"] == q for r in own if r["quality"] == q] for q in (0, 1)]
        assert sum(right[1]) >= 0.99 * len(right[1]) and sum(right[0]) >= 0.95 * len(right[0])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_held_out_labels_teach_nothing(spark, source):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality", "toxic")
    assert sorted(classify(source, labels).collect()) == sorted(classify(source.drop("lang", "source"), held).collect())


def test_awkward_documents(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, None), (2, None, 1), (None, 1, 0), (9, 7, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for docs, known in ((odd, labels), (odd, labels.where("false")), (none, labels)):
        rows = classify(docs, known).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) <= 1  # null and empty
    assert {r["score"] for r in classify(odd, labels.where("false")).collect()} == {0.5}
    twice = [r["score"] for r in classify(odd, labels).where("doc_id = 2").collect()]
    assert twice[0] == twice[1]
    assert not [r for r in score_quality(odd, fit(np.zeros((0, len(STATISTICS))), np.zeros(0), np.zeros(0), np.zeros(0, bool))).collect() if r["doc_id"] is None and r["held_out"]]

"""Small documents with every awkward case, and brute-force helpers."""

import re
from collections import Counter

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def multiset_shingles(ws, k):
    return Counter(tuple(ws[i : i + k]) for i in range(max(0, len(ws) - k + 1)))


@pytest.fixture(scope="module")
def source(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977} v{i % 131}" for i in range(20_000))
    rows = [
        (1, "The same line of text stands in here.\nAnother one that is alone.", "en", "a", 1, "x", 1),
        (2, "The same line of text stands in here.", None, None, None, None, None),
        (2, "The same line of text stands in here.", None, None, None, None, None),
        (None, "The same line of text stands in here.", "en", "a", 3, "y", 2),
        (None, None, "en", "a", 3, "y", 2),
        (3, None, None, None, None, None, None),
        (4, "", "de", "b", 0, "z", 3),
        (5, " \n\t ", "de", "b", 4, "z", 3),
        (6, long, "en", "c", len(long), "z", 4),
        (7, long + " end", "en", "c", len(long) + 4, "z", 4),
        (8, "1234 !? ##", "fr", "c", 10, "z", 4),
        (9, "▁ \U0010ffff é ☃ 漢字" * 40, "fr", "c", 10, "z", 4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, th string, id long")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")

"""Operators that look at one text at a time: quality rules, languages, token counts, pieces."""

import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from karavel.llm import language_id, queries, quality, sentencepiece_codec as pieces, token_counts
from tests.llm.conftest import words

FOLDER = "/root/testdata/sf0.001"


def counted(text):
    ws, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_of_awkward_texts(odd, none):
    got = [tuple(r)[1:6] for r in quality.measured(odd).where("doc_id not in (6, 7) or doc_id is null").collect()]
    want = [counted(r.text) for r in odd.where("doc_id not in (6, 7) or doc_id is null").collect()]
    assert sorted(got) == sorted(want)
    assert quality.measured(none).count() == 0


def test_cascade_order_does_not_change_verdicts(source):
    rows = pa.array([r.text for r in source.collect()])
    rules = quality.BASE_RULES + quality.RULES
    verdict = quality.failed_rule(rows, rules) >= 0
    assert verdict.any() and not verdict.all()
    assert (verdict == (quality.failed_rule(rows, rules[::-1]) >= 0)).all()
    each = np.any([r.rejects(quality.Texts(rows)) for r in rules], axis=0)
    assert (verdict == each).all()


def test_cascade_puts_rejections_per_cost_first(source):
    order = quality.cascade_order(source, quality.BASE_RULES + quality.RULES)
    rate = [share / max(cost, 1e-9) for _, cost, share in order]
    assert rate == sorted(rate, reverse=True) and len(order) == 5
    assert [r.name for r, _, _ in quality.cascade_order(source.where("false"), quality.RULES)] == [r.name for r in quality.RULES]


def test_rules_keep_all_columns(odd):
    out = quality.apply_rules(odd.withColumn("failed_rule", F.lit("old")))
    assert out.columns == [*odd.columns, "failed_rule"] and out.count() == odd.count()
    assert out.where("text is null and failed_rule is null").count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 0.1 < len(held) / len(rows) < 0.3
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_probabilities_of_a_language_add_up():
    text = pa.array(["abracadabra and a bar", "bad cab"])
    cp, starts, ends = language_id.symbols(text)
    at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])
    rows, n = np.unique(np.stack([cp[at - j] for j in range(language_id.ORDER - 1, -1, -1)], axis=1), axis=0, return_counts=True)
    models = language_id.build_models({"xx": (rows, n), "yy": (rows[::2], n[::2])})
    known = sorted(set(cp.tolist()))
    context = list(cp[starts[0] : starts[0] + 3])
    total = 0.0
    for last in known:
        one = np.array([*context, last], np.uint32)
        total = total + 2.0 ** models.log_probabilities(one, np.array([3]))[0]
    unseen = 2.0 ** models.log_probabilities(np.array([*context, 0x4E00], np.uint32), np.array([3]))[0]
    assert np.allclose(total + unseen * (language_id.ALPHABET - len(known)), 1, atol=1e-4)


def test_language_of_awkward_texts(odd, none):
    out = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(odd).where("doc_id in (3, 4, 5, 8)").collect()}
    assert out == {(i, "und", 0.0) for i in (3, 4, 5, 8)}
    unlabelled = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert language_id.identify(none).count() == 0
    assert all(r.held_out is False for r in language_id.identify(odd).where("doc_id is null").collect())


def test_token_histogram_against_plain_counting(spark):
    lengths = [r.n_tokens for r in token_counts.encoded_lengths(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()]
    rows = queries.op5_token_counts(spark, FOLDER).collect()
    assert sorted(r.limit for r in rows) == sorted(set(lengths))
    for r in rows:
        assert r.n_docs == lengths.count(r.limit) and r.docs_at_least == sum(x >= r.limit for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= r.limit) and r.truncated_total == sum(min(x, r.limit) for x in lengths)
        assert r.docs_below == sum(x < r.limit for x in lengths) and (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    hist = spark.createDataFrame(rows)
    for q in (0.0, 0.25, 0.5, 0.99, 1.0):
        assert token_counts.quantile(hist, q).first()[0] == sorted(lengths)[max(0, int(np.ceil(q * len(lengths))) - 1)]
    for limit in (0, 100, 333, 10**6):
        assert tuple(token_counts.at_limit(hist, limit).first()) == (sum(x > limit for x in lengths), sum(min(x, limit) for x in lengths))


def test_token_counts_of_awkward_texts(odd, none):
    got = {(r.doc_id, r.n_tokens) for r in token_counts.encoded_lengths(odd).collect()}
    assert {(3, 0), (4, 0), (None, 0)} <= got
    assert token_counts.length_histogram(token_counts.encoded_lengths(none)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


def tiny():
    scores = {"▁": (0, -5), "a": (1, -4), "b": (2, -4), "ab": (3, -6), "ba": (4, -5), "aba": (5, -9), "▁a": (6, -7), "▁▁": (7, -8)}
    texts = [x.replace("▁", " ").encode() for x in scores] + [bytes([b]) for b in range(256)]
    return pieces.make_vocabulary(scores, tuple(range(8, 264)), tuple(texts))


def best_score(v, s):
    """The highest total over all ways to cut s, by plain recursion over places."""
    best = [0] + [None] * len(s)
    for j in range(1, len(s) + 1):
        ways = [best[i] + v.table[s[i:j]][1] for i in range(j) if s[i:j] in v.table and v.table[s[i:j]][0] != pieces.PREFIX]
        if v.table.get(s[j - 1 : j], (pieces.PREFIX,))[0] == pieces.PREFIX:
            ways.append(best[j - 1] + v.unknown)
        best[j] = max(ways)
    return best[-1]


def test_pieces_have_the_highest_score():
    v, r = tiny(), random.Random(3)
    s = pieces.Segmenter(v)
    for _ in range(400):
        text = "".join(r.choice("aabb  c▁") for _ in range(r.randint(0, 24)))
        score, ids = s.encode(text)
        assert score == best_score(v, pieces.marked(text))
        assert b"".join(v.texts[i] for i in ids).removeprefix(b" ").decode() == text


def test_short_segments_cut_at_once_as_one_by_one(vocabulary, monkeypatch):
    r = random.Random(8)
    for v, letters in ((tiny(), "aabb▁c"), (vocabulary, "aeinst.,é漢☃\n\U0010ffff1")):
        s, mark = pieces.Segmenter(v), pieces.SPACE
        segments = [mark * r.randint(0, 2) + pieces.marked("".join(r.choice(letters) for _ in range(r.randint(0, 40))), False) for _ in range(500)] + ["", mark, mark * 9]
        want = [s.path(x, 0, len(x)) for x in segments]
        got = [np.frombuffer(x, np.int32) for x in s.short_paths(segments)]
        assert [(s.score(x), x.tolist()) for x in got] == want
    # words that are new need no search of their own, and what is remembered is bounded
    monkeypatch.setattr(pieces, "MEMORY", 200_000)
    s = pieces.Segmenter(vocabulary)
    monkeypatch.setattr(s, "path", None)
    for i in range(40):
        s.encode_all([" ".join(f"w{r.random()}" for _ in range(200))])
        assert sum(sys.getsizeof(x) + sys.getsizeof(y) for part in (s.known, s.older) for x, y in part.items()) < 400_000
    assert s.older
    s.forget()  # as tasks do when they end
    assert not s.known and not s.older and not s.held
    monkeypatch.undo()
    assert s.encode("ab, ab") == pieces.Segmenter(vocabulary).encode("ab, ab")


def test_sure_cuts_are_found_without_cutting_the_chunk(vocabulary, monkeypatch):
    r, segmenter = random.Random(31), pieces.Segmenter(vocabulary)
    k = vocabulary.longest
    cases = ["".join(pieces.SPACE if r.random() < share else "a" for _ in range(r.randint(0, 60))) for share in (0.02, 0.3, 0.9) for _ in range(400)]
    want = [[m.start() for m in pieces.SEGMENT.finditer(s, 0, n) if m.start() >= k and s[m.start() - 1] != pieces.SPACE] for s in cases for n in (len(s), len(s) // 2)]
    monkeypatch.setattr(pieces, "SEGMENT", None)
    got = [segmenter.sure_cuts(s, n) for s in cases for n in (len(s), len(s) // 2)]
    assert got == [(x[0], x[-1]) if x else None for x in want] and any(x and len(x) > 1 for x in want)


def test_chunks_joined_by_matrices_score_as_the_whole():
    v, r = tiny(), random.Random(4)
    s = pieces.Segmenter(v)
    for _ in range(200):
        marked = pieces.marked("".join(r.choice("aab" if r.random() < 0.5 else "ab cc ") for _ in range(r.randint(10, 60))))
        size = r.randint(v.longest, 12)
        cuts = list(range(0, len(marked), size))
        parts = [(marked[a : a + size + v.longest - 1], min(size, len(marked) - a)) for a in cuts]
        matrices, rest = zip(*[s.transfer(*p) for p in parts])
        states = pieces.trace(list(matrices), 0, 0)
        back = [s.backtrace(x, a, b) for x, a, b in zip(rest, states[:-1], states[1:])]
        whole = s.path(marked, 0, len(marked))[0]
        total = matrices[0]
        for m in matrices[1:]:
            total = pieces.combine(total, m)
        assert total[0, 0] == whole == sum(x for x, _ in back)
        ids = [i for _, part in back for i in part]
        assert b"".join(v.texts[i] for i in ids).decode() == marked.replace("▁", " ")
        half = len(matrices) // 2
        if half and len(matrices) > 2:  # associative
            left = pieces.combine(pieces.combine(matrices[0], matrices[1]), matrices[2])
            assert (left == pieces.combine(matrices[0], pieces.combine(matrices[1], matrices[2]))).all()


def test_pieces_as_the_library_cuts_them_by_score(source, vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(pieces.MODEL, "rb").read())
    model.trainer_spec.model_type = 1  # unigram
    for p in model.pieces:
        p.score = max(p.score, -40_000.0)  # the library adds in single precision
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    s = pieces.Segmenter(vocabulary)
    for r in source.collect():
        line = r.text.split("\n")[0]
        assert library.encode(line) == s.encode(line)[1]


def test_pieces_round_trip_whole_and_in_chunks(odd, source, none):
    docs = odd.select("doc_id", "text").union(source.select("doc_id", "text"))
    whole = {(r.doc_id, r.th): r.score for r in pieces.encode(docs, chunk_chars=10**9).collect()}
    parts = pieces.encode(docs, chunk_chars=64)
    assert {(r.doc_id, r.th): r.score for r in parts.collect()} == whole
    assert parts.count() == docs.count()
    back = pieces.decode(parts)
    assert back.where(F.xxhash64("text") != F.col("th")).count() == 0
    out = pieces.round_trip(docs)
    assert out.where("not round_trip").count() == 0 and out.count() == docs.count()
    assert pieces.round_trip(none).count() == 0


def test_many_values_of_lang_do_not_stop_the_training(spark):
    rows = [(i, f"wort{i % 7} und {i} text mit buchstaben " * 3, f"l{i % 700:03d}") for i in range(2100)] + [(9000 + i, "the long one of few " * 40_000, "zz") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(docs, train_chars=50_000)
    assert len(models.langs) == language_id.MOST_LANGS and "zz" in models.langs  # of a language with few, long texts some is learned
    out = language_id.identify(docs.where("lang in ('l001', 'zz')"), train_chars=50_000).collect()
    assert {r.lang_pred for r in out} <= {"l001", "zz"} and len(out) == 7


def test_every_language_with_a_document_has_a_model(spark):
    rows = [(i, f"kurzer text {chr(97 + i % 26)} " * 5, f"l{i // 2:03d}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    import zlib

    known = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5}
    assert set(language_id.train(docs).langs) == known

"""The whole pipeline, each stage against plain code on its own input, and queries against their statements."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from compare import compare_one, connect
from karavel.llm import line_dedup, quality, queries
from karavel.llm.common import stage
from tests.llm.test_documents import counted
from tests.llm.test_groups import plain_components, plain_leaks, plain_lines

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_statement(spark, name):
    state, detail = compare_one(spark, connect(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLES[name])
    assert state == "OK", detail


def test_every_operator_has_one_query():
    numbers = [int(n.split("_")[0][2:]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11))


def test_stages_against_plain_code(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(step(spark, docs, FOLDER), f"test_{name}")
        if name != "sentencepiece":
            assert out.columns == docs.columns
        kept[name] = (before, {r.doc_id: r for r in out.collect()})
        docs = out
    before, after = kept["quality_rules"]
    for i, r in before.items():
        n, chars, symbols, dup, repeat = counted(r.text)
        lines = sum(1 for x in r.text.split("\n") if x.split())
        bad = n < 20 or 100 * repeat > 30 * n or chars < 2 * n or chars > 20 * n or 10 * symbols > n or 10 * dup > 3 * lines
        assert (i in after) == (not bad)
    before, after = kept["line_dedup"]
    gone = plain_lines([(r.doc_id, r.text) for r in before.values()])
    for i, r in before.items():
        left = "\n".join(x for n, x in enumerate(r.text.split("\n")) if (i, n) not in gone)
        assert (after[i].text == left and after[i].n_chars == len(left)) if i in after else not left.strip()
    before, after = kept["near_dedup"]
    rows = plain_components([(r.doc_id, r.text) for r in before.values()], 5)
    assert set(after) == {i for i, _, _, own in rows if own}
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert set(before) - set(after) == {i for i, _ in plain_leaks([(r.doc_id, r.text) for r in before.values()], items)}
    before, after = kept["sentencepiece"]
    assert set(before) == set(after) and all(r.round_trip for r in after.values())


def test_stages_of_awkward_documents(spark, odd, none):
    for name, step in corpus_pipeline.STAGES[:4]:
        assert step(spark, odd, FOLDER).columns == odd.columns
        assert step(spark, none, FOLDER).count() == 0


def test_entry_works_without_the_corpus_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in os.listdir(repo):
        if name.endswith(".py") and name != "corpus_pipeline.py":
            os.symlink(f"{repo}/{name}", tmp_path / name)
    os.makedirs(tmp_path / "karavel")
    for name in os.listdir(f"{repo}/karavel"):
        if name != "llm":
            os.symlink(f"{repo}/karavel/{name}", tmp_path / "karavel" / name)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q))"
    code = code.replace("import __spark_entry__ as e", "exec(open('__spark_entry__.py').read().replace('os.path.abspath(__file__)', repr('./x'))); e = sys.modules['__main__']")
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[1] == "False"

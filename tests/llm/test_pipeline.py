"""The pipeline: each stage against brute force on its own input, and what is
left when the llm folder is gone."""
import os
import shutil
import subprocess
import sys

import pytest
from corpus import alnum_words
from test_jaccard import brute as near
from test_small_operators import brute_hits

import corpus_pipeline
from tillstar.llm import common, segment

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    bench = [tuple(r) for r in common.table(spark, SF, "benchmark", "item_id", "text").collect()]
    cols, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.cut(stage(spark, docs, SF), "test")
        after = {r.doc_id: r for r in docs.collect()}
        seen[name] = len(after)
        assert after.keys() <= before.keys()
        if name != "encoding":
            assert docs.columns == cols
        if name == "near_duplicates":
            rows = near(list(before.items()), 5, 80, 100)
            assert after.keys() == {d for d, n, c in rows if not n or d == c}
        if name == "substring_dedup":
            own = {}
            for d, r in sorted(after.items()):
                assert r.n_chars == len(r.text)
                w = alnum_words(r.text)
                for s in range(len(w) - 49):
                    assert own.setdefault(tuple(w[s:s + 50]), d) == d
        if name == "decontamination":
            bad = {d for d, t in before.items() for n, hit, _ in [brute_hits(t, bench)] if hit and 20 * len(hit) >= n}
            assert after.keys() == before.keys() - bad
        if name == "encoding":
            pieces = segment.Pieces.load(segment.MODEL_PATH)
            assert all(pieces.decode(r.ids) == before[d] for d, r in after.items())
            assert after.keys() == before.keys()
    assert list(seen) == [n for n, _ in corpus_pipeline.STAGES] and seen["encoding"] > 100


def test_the_rest_works_without_the_folder(tmp_path):
    for name in ("__spark_entry__.py", "tillstar"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    n, op, pipe = said.stdout.split()
    assert int(n) >= 75 and (op, pipe) == ("False", "False")


def test_encoding_keeps_all_samples(spark):
    docs = spark.createDataFrame([(1, "some text to encode", "en", "web"), (2, None, None, "web")],
                                 "doc_id long, text string, lang string, source string")
    rows = corpus_pipeline.encoding(spark, docs, SF).collect()
    pieces = segment.Pieces.load(segment.MODEL_PATH)
    assert sorted((r.doc_id, r["sample"]) for r in rows) == [(1, k + 1) for k in range(segment.SAMPLES)] + [(2, 1)]
    texts = {1: "some text to encode", 2: ""}
    assert all(pieces.decode(r.ids) == texts[r.doc_id] and r.exact and len(r.ids) == r.n_pieces for r in rows)
    assert len({tuple(r.ids) for r in rows if r.doc_id == 1}) == segment.SAMPLES

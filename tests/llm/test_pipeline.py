import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import test_near  # noqa: E402


def test_stages_one_by_one(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        rows = [(r.doc_id, r.text) for r in before.values()]
        stage(spark, docs, sf).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        if name != "encoding":
            assert docs.columns == names and all(r.n_chars == len(r.text) for r in after.values())
        if name == "language_id":
            assert set(after) == {i for i, t in rows if any(c.isalpha() for c in t)}
        elif name == "near_dedup":
            assert set(after) == test_near.kept(rows)
        elif name == "substring_dedup":
            for i, (words, kept) in brute.substrings(rows).items():
                assert after[i].text == (before[i].text if len(kept) == len(words) else " ".join(kept))
        elif name == "decontamination":
            for i, text in rows:
                words, hit, _ = brute.contamination(text, items)
                assert brute.ALNUM.findall(brute.low(after[i].text)) == [w for w, h in zip(words, hit, strict=True) if not h]
                assert any(hit) or after[i].text == text
        else:
            assert all(after[i].decoded == text for i, text in rows)


def test_run(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "ids", "n_tokens", "n_best_scores", "decoded"] and got.count() > 100

"""The pipeline's near-duplicates: Jaccard 0.8 of 5-word shingles, against all pairs."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from bourselake.llm import near  # noqa: E402


def _set(text, n=5):
    w = brute.WORD.findall(brute.low(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def kept(rows, similarity=0.8):
    sets = {i: _set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a & b) >= similarity * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


def test_stage_keeps_one_of_each_group(spark, small):
    """Copies of 30 to 400 words at similarities around 0.8, which 3 bits of a fingerprint do not link."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(7)
    rows = [(r.doc_id, r.text) for r in small.collect()]
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 60, 120, 400]))]
        rows.append((10_000 + 2 * k, " ".join(words)))
        for _ in range(rng.randrange(1, 2 + len(words) // 40)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((10_001 + 2 * k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept(rows))


def test_estimates_are_near(spark):
    rng = random.Random(3)
    for n in (20, 60, 300, 2000):
        for _ in range(40):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = list(words)
            for _ in range(max(1, n // 50)):
                other[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            a, b = _set(" ".join(words)), _set(" ".join(other))
            raw = np.frombuffer(" ".join(words).encode() + " ".join(other).encode(), np.uint8)
            cut = len(" ".join(words).encode())
            h, begins = near.shingle_sets(raw, np.array([0, cut, len(raw)]), 5)
            bins = near.sketches(h, begins)[3]
            assert abs(near.estimates(bins[0], bins[1]) - len(a & b) / len(a | b)) < (0.15 if n < 60 else 0.08)


def test_a_shared_passage_makes_no_group(spark, monkeypatch):
    """Half of each text is one passage: texts meet in bands, and only true copies are linked, in chunks of any size."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(36)])) for i in range(120)]
    for i in range(120, 150):  # similar to one of them
        w = rows[i - 120][1].split()
        w[-3] = "changed"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near, "GROUP", 16)
    got = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept(rows))


def test_odd_rows(odd, empty):
    got = near.keep_one(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 3, 6, 7, 9, 10]  # 11 holds 21 of its 25 shingles in common with 1
    assert near.keep_one(empty).count() == 0


def test_a_link_behind_a_better_estimate_is_found(spark, monkeypatch):
    """The best estimates of two components fail on the sets, a worse one holds: all pairs are verified in the end, one or a few at a time."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]

    def changed(words, places):
        words = list(words)
        for i, at in enumerate(places):
            words[at] = f"x{rng.randrange(10**6)}"
        return words

    rows = [(1, " ".join(base))]
    # a chain of copies at about 0.85 from one end to the other: only neighbours are links
    now = base
    for i in range(2, 9):
        now = changed(now, [i * 40 + 5 * j for j in range(6)])
        rows.append((i, " ".join(now)))
    true = near.estimates
    turned = lambda a, b: np.where(true(a, b) >= 0.6, 1.7 - true(a, b), 0.0)  # noqa: E731  # the better a pair, the lower
    monkeypatch.setattr(near, "estimates", turned)
    for first, more in ((1, 2), (1, 16), (4, 64)):
        monkeypatch.setattr(near, "FIRST", first)
        monkeypatch.setattr(near, "MORE", more)
        monkeypatch.setattr(near, "links", lambda prints: prints.selectExpr("node as a", "node as b").limit(0))
        got = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r.doc_id for r in got.collect()) == sorted(kept(rows))


def test_forests_span_what_pairs_connect():
    """In any portions: each forest joins what all pairs join, has no circle, takes the first pairs; all pairs come in the end."""
    rng = random.Random(5)
    for most in (1, 2, 30):
        forests, before, parents = near.Forests(most), [], [dict(enumerate(range(20))) for _ in range(most)]
        for _ in range(6):
            pairs = [(rng.randrange(20), rng.randrange(20)) for _ in range(rng.randrange(0, 25))]
            pairs = [(a * 7, b * 7) for a, b in pairs if a != b]
            taken, more = forests.take(*(np.array([p[k] for p in pairs], np.int64) for k in (0, 1)))
            want = []
            left = list(range(len(pairs)))
            for parent in parents:  # Kruskal's way, one forest after the other

                def root(x, parent=parent):
                    while parent[x] != x:
                        x = parent[x]
                    return x

                rest = []
                for k in left:
                    a, b = root(pairs[k][0] // 7), root(pairs[k][1] // 7)
                    if a == b:
                        rest.append(k)
                    else:
                        parent[max(a, b)] = min(a, b)
                        want.append(k)
                left = rest
            assert np.flatnonzero(taken).tolist() == sorted(want) and more == bool(left)
            before += pairs


def test_a_group_passes_on_no_more_pairs_than_components(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(1, 255, near.BINS).astype(np.uint8)
    rows = []
    for n in range(300):  # one key, all alike, each a component of its own
        b = base.copy()
        b[rng.integers(0, near.BINS, 10)] = 7
        rows.append((7, 0, n, n, 100, b.tobytes(), [5, 10**9 + n]))
    schema = "g long, side int, node long, c long, size long, bins binary, earlier array<long>"
    met = spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(near._closest(0.8, 1), "a long, b long, more boolean").collect()
    assert [r.a for r in met] == [None] and not met[0].more  # all have met in an earlier band
    df = spark.createDataFrame([(*r[:6], [10**9 + r[2]] if r[2] % 2 else []) for r in rows], schema).coalesce(1)
    for most in (1, 3):
        got = df.mapInArrow(near._closest(0.8, most), "a long, b long, more boolean").collect()
        pairs = [r for r in got if r.a is not None]
        assert len(pairs) == len({(r.a, r.b) for r in pairs}) == 299 * most and any(r.more for r in got)


def test_recall_on_a_larger_table(spark):
    """Against brute force over all pairs of a table of 1 000 documents, copies and near copies among them."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(kept(rows))

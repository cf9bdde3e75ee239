import collections
import math
import os
import random
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from bourselake.llm import ann, decontaminate, graph, langid, lm, pieces, sharding, simhash, substrings, token_counts, token_files  # noqa: E402
from bourselake.llm.common import shared_folder  # noqa: E402
from bourselake.llm.tokenizer import load  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- 1 language identification


def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = dict(docs.select("doc_id", "lang").collect())
    rows = [r for r in langid.digests(docs).collect() if r.held_out]
    assert len(rows) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_odd_rows(odd, empty):
    got = collections.defaultdict(list)
    for r in langid.digests(odd).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == odd.count()
    for i in (3, 4, 5, 10):
        assert got[i][0].lang_pred == "und" and got[i][0].score == 0
    assert got[7][0].lang_pred in ("de", "en") and got[None][0].held_out is False
    assert langid.digests(empty).count() == 0
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, 7, None, 9, 11}


def test_texts_far_from_every_codeword_go(spark):
    """Long strings of letters that are no language go; prose of all four languages, and short junk, stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(4)
    junk = [(10**6 + i, "".join(rng.choice("qxzjkvwyhgfb") + (" " if rng.random() < 0.15 else "") for _ in range(n)), None, "j", 0) for i, n in enumerate([900] * 20 + [60] * 5)]
    rows = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    kept = {r.doc_id for r in langid.keep_known(rows).collect()}
    assert {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} <= kept
    assert not kept & {10**6 + i for i in range(20)} and kept >= {10**6 + i for i in range(20, 25)}


def test_langid_against_a_plain_version(spark, small):
    """The same classifier, text by text and bit by bit in plain Python: margins, losses and answers."""
    rows = [(r.doc_id, r.text, r.lang) for r in small.collect()]
    learned = langid.learn(small)
    got = {r.id: (r.lang_pred, r.score) for r in langid.predict(small, learned).collect()}

    def grams(text):
        folded = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()]
        counts = collections.Counter()
        for n in langid.LENGTHS:
            for i in range(len(folded) - n + 1):
                v = 0
                for c in folded[i : i + n]:
                    v = (v * 0x01000193 + c + 1) % 2**32 if v else c + 1
                v = v * 0x9E3779B1 % 2**32
                v ^= v >> 15
                counts[(v * 0x85EBCA77 % 2**32) >> 18] += 1
        return counts

    for i, text, _ in rows[:40]:
        counts = grams(text or "")
        total = sum(counts.values())
        if not total:
            continue
        losses = []
        for code in learned.code:
            loss = 0.0
            for bit, sign in enumerate(code):
                margin = sum(c / total * float(learned.weights[f, bit]) for f, c in counts.items()) + learned.bias[bit]
                loss += learned.bit_weight[bit] * math.log1p(math.exp(-2 * max(-30.0, min(30.0, margin * sign))))
            losses.append(loss)
        best = min(range(len(losses)), key=losses.__getitem__)
        share = [math.exp(-langid.SHARPNESS * (x - losses[best])) for x in losses]
        assert got[i][0] == learned.languages[best] and math.isclose(got[i][1], share[best] / sum(share), rel_tol=1e-5)


def test_langid_sample_is_bounded_and_fair(spark):
    """One text in masses is one text, and a language of few texts is learned."""
    rows = [(i, "the same words of one text again", "en") for i in range(500)] + [(1000 + i, f"nur wenige deutsche Sätze über {i}", "de") for i in range(5)] + [(2000 + i, f"many english words about {i}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.learn(docs, 20).languages == ["de", "en"]


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 8, 12):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n and all(abs(c.sum()) < n for c in code.T)


# ---- 2 sharding


def test_sharding(spark, small, odd, empty):
    rows = sharding.digests(small, f"{shared_folder(spark)}/map-small").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == list(range(16))
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert max(sizes) <= 1.02 * min(sizes)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    texts = dict(pairs(small))
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    got = sharding.digests(odd, f"{shared_folder(spark)}/map-odd").collect()
    assert len(got) == odd.count() and {r["size"] for r in got if r.doc_id in (3, 4)} == {1}
    assert sharding.digests(empty, f"{shared_folder(spark)}/map-empty").count() == 0


def test_rebalance_moves_few_slots(spark):
    sizes = [(i, 10 + i % 7, 1) for i in range(400)]
    one = sharding.deal(sizes, 8)
    two = sharding.rebalance(one, sizes, 9)
    moved = [s for s in one if one[s] != two[s]]
    load = collections.Counter()
    for s, b, _ in sizes:
        load[two[s]] += b
    assert len(moved) < 60 and max(load.values()) <= 1.03 * min(load.values())
    path = f"{shared_folder(spark)}/map-versions"
    for version, m in ((1, one), (2, two)):
        sharding.store_map(spark, path, sharding.map_rows(version, m, sizes))
    newest = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path).collect()}
    assert newest == two and {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 1).collect()} == one
    assert set(sharding.rebalance(one, sizes, 5).values()) == set(range(5))


# ---- 3 and 5 tokens


@pytest.fixture(scope="module")
def expected(odd, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    return lambda t: library.encode(t or "", add_special_tokens=False).ids


def test_token_counts(odd, small, empty, expected):
    for docs in (small, odd):
        got = collections.Counter(tuple(r) for r in token_counts.counts(docs, WORD_BPE).collect())
        want = collections.Counter((i, len((t or "").encode()), n := len(expected(t)), n > 2048) for i, t in pairs(docs))
        assert got == want
    assert token_counts.counts(empty, WORD_BPE).count() == 0


def test_token_counts_of_a_sentencepiece_model(odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    short = odd.where("length(text) < 1000 or text is null")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.counts(short, PIECES).collect())
    assert got == sorted((i or 0, len(model.encode(t or ""))) for i, t in pairs(short))


def test_token_files_round_trip(spark, odd, small, empty, expected):
    path = f"{shared_folder(spark)}/tokens-test"
    docs = small.select("doc_id", "text").unionByName(odd.where("doc_id > 2 and doc_id < 12").selectExpr("doc_id + 1000000 as doc_id", "text"))
    token_files.write(docs, path, WORD_BPE)
    at = 0
    want = []
    for i, t in sorted(pairs(docs)):
        ids = [*expected(t), 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.digests(spark, path).collect()) == want
    some = {r.doc_id: r.ids for r in token_files.read_tokens(spark, path, [5, 1000009]).collect()}
    assert some[5] == [*expected(dict(pairs(docs))[5]), 1] and len(some) == 2
    assert sorted((r.doc_id, r.start) for r in token_files.starts(spark, path).collect()) == [w[:2] for w in want]
    token_files.write(odd, f"{path}-odd", WORD_BPE)
    assert token_files.digests(spark, f"{path}-odd").count() == odd.count()
    token_files.write(empty, f"{path}-empty", WORD_BPE)
    assert token_files.digests(spark, f"{path}-empty").count() == 0


# ---- 4 language-model scores


def _check_lm(docs):
    """All columns against dictionaries of counts: the score too, as the filter has bits enough to be free of false positives here."""
    got = collections.defaultdict(list)
    for r in lm.digests(docs).collect():
        got[r.doc_id].append(tuple(r))
    one, two = collections.Counter(), collections.Counter()
    rows = [(i, [*brute.WORD.findall(brute.low(t)), None]) for i, t in pairs(docs)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, w in rows:
        if not held(i):
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
    n, v = sum(one.values()), len(one)
    low = lambda c: math.ceil(lm.BASE ** math.floor(math.log(c) / math.log(lm.BASE) + 1e-9) - 1e-9) if c else 0
    high = lambda c: max(low(c), math.ceil(lm.BASE ** (math.floor(math.log(c) / math.log(lm.BASE) + 1e-9) + 1) - 1e-9) - 1) if c else 0
    want = collections.defaultdict(list)
    for i, w in rows:
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip([None, *w[:-1]], w, strict=True):
            c = two[a, b] if two[a, b] >= lm.LEAST else 0
            score += math.log10(lm.PAIR * (low(c) / high(one[a]) if c and one[a] else 0.0) + (1 - lm.PAIR) * (low(one[b]) + 1) / (n + v + 1))
        want[i].append((i, held(i), len(w), sum(one[x] > 0 for x in w), n, base, score))
    assert got.keys() == want.keys()
    for i in want:
        for g, x in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert g[:5] == x[:5] and math.isclose(g[5], x[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], x[6], rel_tol=1e-9, abs_tol=1e-9)


def test_lm_base_and_score(small, odd, monkeypatch):
    monkeypatch.setattr(lm, "BITS", 64)
    _check_lm(small)
    _check_lm(odd)
    monkeypatch.setattr(lm, "PART_TOKENS", 3_000)  # many parts of the filter, many blocks
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    _check_lm(small.unionByName(small))


def test_lm_false_positives_are_rare(small, monkeypatch):
    got = {r.doc_id: r.score for r in lm.digests(small).collect()}
    monkeypatch.setattr(lm, "BITS", 64)
    exact = {r.doc_id: r.score for r in lm.digests(small).collect()}
    assert sum(abs(got[i] - exact[i]) < 0.01 * abs(exact[i]) for i in exact) > 0.95 * len(exact)


def test_lm_probabilities_sum_to_at_most_one(spark):
    """p(w | v) over all words and one unseen, for every v."""
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{min(int(x), 30)}" for x in rng.zipf(1.4, 60))) for i in range(60)]
    one, two = collections.Counter(), collections.Counter()
    for _, t in docs:
        w = [*t.split(), None]
        one.update(w)
        two.update(zip([None, *w[:-1]], w, strict=True))
    words = [*one, "unseen"]
    level = lambda c: np.array([int(lm.level_of(np.array([x]))[0]) if x else 0 for x in c])
    for v in words:
        p = 10 ** lm.log10(level([one[w] for w in words]), level([one[v]] * len(words)), level([two[v, w] for w in words]), sum(one.values()), len(one))
        assert p.sum() <= 1 + 1e-12


def test_lm_parts_texts_that_repeat(spark):
    """Texts that the training set holds twice score better by word than others of their kind; base scores don't part them."""
    rng = np.random.default_rng(9)
    text = lambda: " ".join(f"v{x}" for x in rng.integers(0, 400, 80))
    rows = [(i, text()) for i in range(600)]
    rows += [(10_000 + i, rows[i][1]) for i in range(60)]
    got = {r.doc_id: (r.base_score / r.n_tokens, r.score / r.n_tokens, r.held_out) for r in lm.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = [got[i] for i in range(60) if not got[i][2] and not got[10_000 + i][2]]
    rest = [got[i] for i in range(60, 600)]
    assert min(t[1] for t in twice) > max(r[1] for r in rest)
    assert min(t[0] for t in twice) < max(r[0] for r in rest)


def test_lm_empty(spark, empty):
    assert lm.digests(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)  # the only row is held out: nothing to learn from
    (r,) = lm.digests(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.base_score == 0.0 and math.isfinite(r.score)


def test_filter_gives_back_levels():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = rng.integers(1, 5_000, len(h))
    levels = lm.level_of(counts)
    made = lm.Filter.sized(int(levels.sum()))
    made.add(h, levels)
    got = made.levels(h)
    assert (got >= levels).all() and (got == levels).mean() > 0.98
    assert (made.levels(rng.integers(0, 2**63, 5_000).astype(np.uint64)) == 0).mean() > 0.95
    assert (lm.low_of(levels) <= counts).all() and (counts <= lm.high_of(levels)).all() and (lm.high_of(levels) <= lm.low_of(levels) * lm.BASE + 1).all()


# ---- 6 substrings


def _check_substrings(docs):
    want = brute.substrings(pairs(docs))
    for r in substrings.digests(docs).collect():
        words, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), len(words) - len(kept), brute.sha(" ".join(kept))), r.doc_id


def test_substrings(small, odd, empty):
    _check_substrings(small)
    _check_substrings(odd)
    assert substrings.digests(odd).count() == odd.count() and substrings.digests(empty).count() == 0


def test_substrings_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2_000)
    _check_substrings(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7))


def test_without_repeats(odd):
    got = {r.doc_id: r for r in substrings.without_repeats(odd).collect()}
    assert substrings.without_repeats(odd).columns == odd.columns
    assert got[11].text.startswith("intro words here then") and len(got[11].text.split()) == 4 and got[11].g == "g of 11" and got[11]["n.m"] == "n.m of 11"
    assert got[3].text is None and got[5].text == " \t\n " and got[1].text.startswith("The quick")


def test_factors_name_their_source(odd):
    (r,) = [r for r in substrings.factors(odd).collect() if r.doc_id == 11]
    assert [(f.at, f.words, f.ref_d, f.ref_at) for f in r.factors] == [(4, 26, 1, 0)]


def test_factors_are_longest_matches(spark, monkeypatch):
    """Two sources that overlap in a text: two factors that both reach as far as they can, and every window across their ends is looked up."""
    w = [f"w{i}" for i in range(200)]
    rows = [(1, w[:60]), (2, w[40:100]), (3, ["x", *w[10:90], "y"]), (4, w[90:130]), (5, w[100:125] + w[10:35] + w[100:125])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    for block in (2 << 20, 300):  # one block, and a block for each document or two
        monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
        got = {r.doc_id: [(f.at, f.words, f.ref_d, f.ref_at) for f in r.factors] for r in substrings.factors(docs.coalesce(1)).collect()}
        assert {i: [f[:2] for f in v] for i, v in got.items()} == {2: [(0, 20)], 3: [(1, 50), (32, 49)], 5: [(0, 25), (25, 25), (50, 25)]}
        words = dict(rows)
        assert all(words[i][at : at + n] == words[d][ref : ref + n] and (d, ref) < (i, at) for i, v in got.items() for at, n, d, ref in v)


# ---- 7 SimHash


def _check_simhash(docs):
    rows = pairs(docs)
    want = brute.components(rows)
    for r in simhash.op7(docs.sparkSession, docs).collect():
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
            assert r.fingerprint in {f"{brute.fingerprint(t):016x}" for i, t in rows if i == r.doc_id}


def test_simhash(small, odd, empty):
    _check_simhash(small)
    _check_simhash(odd.where("length(text) < 5000 or text is null"))
    assert simhash.op7(odd.sparkSession, empty).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


def test_links_lose_nothing(spark):
    """Clusters around centres, groups cut into chunks."""
    rng = np.random.default_rng(5)
    fps = []
    for centre in rng.integers(0, 2**63, 12).tolist():
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.append(x & (2**64 - 1))
    fps = sorted(set(fps))
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for group in (2048, 7):
        edges = simhash.links(spark.createDataFrame(rows, "fp long, node long"), group)
        assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 3 for r in edges.collect())
        got = {r.node: r.component for r in graph.connected_components(edges).collect()}
        assert all(got.get(i, i) == find(i) for i in range(len(fps)))


def test_golay_code_is_perfect():
    assert len(set(simhash._remainder(simhash._corrections()).tolist())) == 2048


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1001] == 1000


# ---- 8 nearest neighbours


def test_ann_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    ids = np.array(sorted(table))
    x = np.stack([table[i] for i in ids])
    got = collections.defaultdict(list)
    for r in ann.search(rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        s = x @ table[q]
        s[ids == q] = -9
        hits += len({r.vec_id for r in got[q]} & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
        assert [r["rank"] for r in got[q]] == list(range(1, 21))
        assert all(abs(r.score - float(table[q] @ table[r.vec_id])) < 1e-12 for r in got[q])
    assert hits / (20 * len(got)) >= 0.9


def test_fewer_lists_as_neighbours_come_closer():
    """Clustered vectors: the share of lists that the sample asks for falls as tables grow, and covers the true neighbours at either size."""
    rng = np.random.default_rng(1)
    middles = rng.standard_normal((60, 16))
    shares = []
    for total in (2_000, 40_000):
        x = middles[rng.integers(0, 60, total)] + 0.25 * rng.standard_normal((total, 16))
        x /= np.linalg.norm(x, axis=1)[:, None]
        known = x[:2_000]
        centers = ann.kmeans(known, 50)
        least = ann.lists_to_probe(known, centers, 20, total, 0.95)
        q, own = x[-100:], ann.nearest(x, centers)
        s = q @ x.T
        s[np.arange(100), total - 100 + np.arange(100)] = -9
        best = np.argsort(-s, axis=1)[:, :20]
        place = np.argsort(np.argsort(-(q @ centers.T), axis=1), axis=1)
        assert (np.take_along_axis(place, own[best], axis=1) < least).mean() >= 0.9
        shares.append(least / len(centers))
    assert shares[1] <= shares[0] < 0.5


def test_ann_copies_in_masses(spark):
    """One vector that most rows share: its smallest ids are everyone's, and copies that are queries are answered."""
    rng = np.random.default_rng(2)
    rows = [(i, [0.6, 0.8, 0.1] if i % 3 else rng.standard_normal(3).round(3).tolist()) for i in range(900)]
    table = {i: np.array(np.array(v, np.float32), float) for i, v in rows}
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 900, 20):
        want = sorted(((-float(table[q] @ v), i) for i, v in table.items() if i != q))[:20]
        assert [i for i, _ in got[q]] == [i for _, i in want]


def test_ann_odd_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, float(i % 3), 0.5]) for i in range(60)] + [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 0.0]), (160, [nan, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (180, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and len(got) == 60
    best = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 20)  # ties go to the smaller id
    assert [v for _, v in best] == [i for i in range(60) if i % 3 == 2 and i != 20][:19] + [1]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert sorted(r.vec_id for r in ann.search(few).collect()) == [1, 2]
    assert ann.search(df.limit(0)).count() == 0


# ---- 9 pieces


def test_n_best_is_exact():
    of = pieces.Pieces(load(PIECES)[0])

    def brute_force(text, n):
        t, out = pieces.BLANK + text.replace(" ", pieces.BLANK), []

        def go(e, s, ids):
            if e == 0:
                out.append((s, ids))
            else:
                for i, edge, score in of.edges_to(t, e):
                    go(i, s + score, [*edge, *ids])

        go(len(t), 0.0, [])
        return sorted(out, key=lambda x: -x[0])[:n]

    for text in ("hello, worl", "ab c\nd", "日本x", "  a  b", " a", "aaa aa."):
        want, got = brute_force(text, 6), of.segmentations(text, 6)
        assert [round(s, 9) for s, _ in want] == [round(s, 9) for s, _ in got]
        assert len({tuple(i) for _, i in got}) == len(got) and all(of.decode(np.array(i)) == text for _, i in got)
        assert [round(s, 9) for s in of.encode(text, 6)[1]] == [round(s, 9) for s, _ in got]


def test_ties_and_long_runs_are_no_burden():
    of = pieces.Pieces(load(PIECES)[0])
    for n in (7, 40):  # many ties; the scores are those of a plain dynamic program over lists of n best
        text = pieces.BLANK + "a" * n
        lists = [[0.0]]
        for e in range(1, len(text) + 1):
            lists.append(sorted((x + score for s, _, score in of.edges_to(text, e) for x in lists[s]), reverse=True)[:6])
        got = of.n_best(text, 6)
        assert [s for s, _ in got] == lists[-1] and len({i for _, i in got}) == 6
    began = time.perf_counter()
    for text in ("a" * 1_000_000, "ab" * 300_000, "語" * 100_000, "▁" * 20_000, "x" * 5_000 + "é" * 5_000):
        ids, best, _ = of.encode(text, 4)
        assert of.decode(np.frombuffer(ids, "<u4")) == text and sorted(best, reverse=True) == best
    assert time.perf_counter() - began < 60


def test_ids_against_the_library(small):
    """Where merges and the lattice's best agree, and by how much they differ: the library's pieces are never better on the lattice's own scores."""
    import sentencepiece

    of, model = pieces.Pieces(load(PIECES)[0]), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    score = lambda ids: sum(of.scores.get(i, of.byte_score) for i in ids)
    same = words = 0
    for _, text in pairs(small.where("length(text) < 4000")):
        for w in text.split():
            ids, best, _ = of.encode(w, 1)
            mine, theirs = np.frombuffer(ids, "<u4").tolist(), model.encode(w)
            assert best[0] >= score(theirs) - 1e-9
            same, words = same + (mine == theirs), words + 1
    assert same / words > 0.5


def test_pieces_round_trip(small, odd, empty):
    for docs in (small, odd):
        got = collections.Counter((r.doc_id, r.decoded) for r in pieces.encoded(docs, PIECES).collect())
        assert got == collections.Counter((i, t or "") for i, t in pairs(docs))
    digest = {r.doc_id: r for r in pieces.digests(small, PIECES).collect()}
    assert all(digest[i].decoded_sha256 == brute.sha(t) for i, t in pairs(small))
    assert pieces.encoded(empty, PIECES).count() == 0


# ---- 10 decontamination


def test_decontamination(small, odd, benchmark, empty):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    for docs in (small, odd.where("length(text) < 5000 or text is null")):
        texts = collections.defaultdict(list)
        for i, t in pairs(docs):
            texts[i].append(t)
        for r in decontaminate.digests(docs, benchmark).collect():
            w, hit, ids = brute.contamination(texts[r.doc_id][0], items)
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), sum(hit), len(ids), brute.sha(",".join(ids)), any(hit))
    assert decontaminate.digests(empty, benchmark).count() == 0 and decontaminate.digests(odd, benchmark.limit(0)).where("contaminated").count() == 0


def test_decontamination_short_items_parts_and_cuts(spark):
    items = spark.createDataFrame([(1, "Two Words"), (2, None), (3, "..."), (10, "one two three four five six seven eight nine ten eleven"), (None, "never")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "He said: two, WORDS! Then left.", "k"), (2, "a one two three four five six seven eight nine ten b", "k"), (3, None, "k")], "doc_id long, text string, hit_from string")
    whole = {r.doc_id: r for r in decontaminate.hits(docs, items).collect()}
    parts = {r.doc_id: r for r in decontaminate.hits(docs, items, part_bytes=3).collect()}
    assert {k: tuple(v) for k, v in whole.items()} == {k: tuple(v) for k, v in parts.items()}
    assert whole[1]["items"] == ["1"] and whole[2]["items"] == ["10"] and whole[3]["n_words"] == 0
    assert [docs.collect()[0].text[a:b] for a, b in zip(whole[1]["hit_from"], whole[1]["hit_to"], strict=True)] == ["two", "WORDS"]
    cut = {r.doc_id: r.text for r in decontaminate.without_hits(docs, items).collect()}
    assert "two" not in cut[1] and "Then left." in cut[1] and cut[2].split() == ["a", "b"] and cut[3] is None

"""Importance resampling, byte-level BPE and spelling variants against plain versions."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from bourselake.llm import byte_bpe, decontaminate, resample, variants  # noqa: E402
from bourselake.llm.words import span_crcs  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_span_crcs():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 9, 47, 48, 49, 500]))) for _ in range(300)]
    raw, at = np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum([len(w) for w in words]))
    assert span_crcs(raw, at[:-1], at[1:]).tolist() == [zlib.crc32(w) for w in words]
    front = np.array([zlib.crc32(b"x:")] * len(words), np.uint32)
    assert span_crcs(raw, at[:-1], at[1:], front).tolist() == [zlib.crc32(b"x:" + w) for w in words]


# ---- 11 importance resampling


def _resampled(rows, target, percent=10, grams=1, least=20):
    def features(text):
        w = brute.ALNUM.findall(brute.low(text))
        return w, [zlib.crc32(" ".join(w[i : i + g]).encode()) % 10000 for g in range(1, grams + 1) for i in range(len(w) - g + 1)]

    s, t = (collections.Counter(f for x in texts for f in features(x)[1]) for texts in ([t for _, t in rows], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for d, text in rows:
        words, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[f] + 1) * (n_s + 10000) / ((s[f] + 1) * (n_t + 10000)))) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for i, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("percent", "grams", "least"), [(10, 1, 20), (60, 2, 3), (100, 1, 0), (0, 1, 20)])
def test_resample(small, odd, benchmark, percent, grams, least):
    target = [t for _, t in benchmark.collect()]
    for docs in (small, odd):
        same([tuple(r) for r in resample.resample(docs, benchmark, percent, grams, least_words=least).collect()], _resampled(pairs(docs), target, percent, grams, least))


def test_resample_many_blocks(small, benchmark, monkeypatch):
    """Runs of 16 rows, blocks of 3, few splitters: the same rows."""
    monkeypatch.setattr(resample, "RUN_ROWS", 16)
    monkeypatch.setattr(resample, "BLOCK_ROWS", 3)
    monkeypatch.setattr(resample, "RANGES", 4)
    docs = small.repartition(7)
    same([tuple(r) for r in resample.resample(docs, benchmark, 50).collect()], _resampled(pairs(docs), [t for _, t in benchmark.collect()], 50))


def test_resample_empty(small, empty, benchmark):
    assert resample.resample(empty, benchmark).count() == 0
    rows = resample.resample(small, benchmark.limit(0)).collect()
    assert len(rows) == small.count() and sum(r["rank"] is not None for r in rows) == len({r["rank"] for r in rows}) - 1


def test_resample_repeated_rows(small, benchmark):
    """One row in masses: each of its rows has a rank of its own."""
    docs = small.unionByName(small.where("n_chars > 1000").limit(1).crossJoin(small.sparkSession.range(500)).drop("id"))
    rows = [tuple(r) for r in resample.resample(docs, benchmark, 90).collect()]
    same(rows, _resampled(pairs(docs), [t for _, t in benchmark.collect()], 90))


def test_tournament():
    rng = random.Random(2)
    blocks = sorted(sorted((rng.randrange(50), 0, rng.randrange(9), 0, 0) for _ in range(rng.randrange(1, 40))) for _ in range(60))
    packed = [(0, b[0][:4], np.array(b, resample._ROW).tobytes()) for b in blocks]
    everything = sorted(x for b in blocks for x in b)
    for draws in (0, 1, 100, len(everything), 10**6):
        got = list(resample.merged(iter(packed), np.array([0]), draws))
        ranked = [r for r in got if r[5] is not None]
        assert [r[:5] for r in ranked] == everything[:draws] and [r[5] for r in ranked] == list(range(1, len(ranked) + 1))
        assert sorted(r[:5] for r in got) == everything


# ---- 12 byte-level BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_digests(small, odd, empty, library):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for docs in (small, odd):
        want = []
        for d, text in pairs(docs):
            ids = library.encode_ordinary(text or "")
            want.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())))
        same([tuple(r) for r in byte_bpe.digests(docs, RANKS).collect()], want)
    assert byte_bpe.digests(empty, RANKS).count() == 0


def test_bpe_round_trip(odd, spark):
    ids = byte_bpe.encoded(odd, RANKS)
    texts = collections.Counter((r.doc_id, r.text) for r in byte_bpe.decoded(ids, RANKS).collect())
    assert texts == collections.Counter((d, t or "") for d, t in pairs(odd))
    assert byte_bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS).first().text == ""


def test_bpe_long_and_odd_texts(library, monkeypatch):
    own = byte_bpe.ByteBpe(open(RANKS, "rb").read())
    rng = random.Random(3)
    texts = ["a" * 100_000, " " * 50_000 + "x", "".join(rng.choice("abcdeé日 \n'0١") for _ in range(200_000)), "é" * 20_001, "<|endoftext|> it's we'LL\r\n\t", "\x00\x1c\x85  ﻿\U0001f600"]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(3000))]
    for t in texts:
        assert own.encode(t) == library.encode_ordinary(t) and own.decode(own.encode(t)) == t.encode()
    monkeypatch.setattr(byte_bpe, "CACHE", 8)
    monkeypatch.setattr(byte_bpe, "STRETCH", 5)
    own = byte_bpe.ByteBpe(open(RANKS, "rb").read())
    assert all(own.encode(t[:3000]) == library.encode_ordinary(t[:3000]) for t in texts)


def test_forest_equals_single_trees():
    """Words worked out together, of every length, and a pair table that probes."""
    own, rng = byte_bpe.ByteBpe(open(RANKS, "rb").read()), random.Random(8)
    for size in (2, 4, 8, 16, 32):
        words = ["".join(rng.choice("abcdenorstié日 0") for _ in range(40)).encode()[: rng.randrange(2, size + 1)] for _ in range(400)] + [b"aa" * (size // 2), b"\xff\xfe"]
        trees = [byte_bpe.RankTree(w, own.ranks) for w in words]
        for tree in trees:
            while tree.merge():
                pass
        assert byte_bpe.forest(words, size, own.pairs, own.of_byte) == [[own.ranks[p] for p in tree.parts()] for tree in trees]
    ids = {t: r for t, r in own.ranks.items() if len(t) > 1}
    some = rng.sample(sorted(ids), 2000)
    cuts = [(own.ranks.get(t[:i]), own.ranks.get(t[i:]), ids[t]) for t in some for i in range(1, len(t))]
    a, b, want = map(np.array, zip(*(c for c in cuts if None not in c), strict=True))
    assert (own.pairs.ranks(a, b) == want).all()
    a, b = np.array([rng.randrange(50_000) for _ in range(5000)]), np.array([rng.randrange(50_000) for _ in range(5000)])
    want = [own.ranks.get(own.tokens[x] + own.tokens[y], byte_bpe._NO_RANK) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert own.pairs.ranks(a, b).tolist() == want


def test_rank_tree_merges_leftmost_first():
    tree = byte_bpe.RankTree(b"abababc", {b"ab": 5, b"abab": 7, b"bc": 9, b"ba": 6})
    seen = []
    while tree.merge():
        seen.append(list(tree.parts()))
    assert seen[0] == [b"ab", b"a", b"b", b"a", b"b", b"c"] and seen[-1] == [b"abab", b"ab", b"c"]


# ---- 13 spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _groups(rows):
    count = collections.Counter()
    for d, text in rows:
        for run in RUN.findall(brute.low(text)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            k = h % len(run)
            run = run[:k] + run[k + 1 :] if h % 31 == 0 else run
            if len(run) >= 7:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= 2}
    near = {w: [x for x in n if _distance_one(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n]


def test_variants(small, odd, empty):
    for docs in (small, odd):
        same([tuple(r) for r in variants.groups(docs).collect()], _groups(pairs(docs)))
    assert variants.groups(empty).count() == 0


def test_variants_chains_and_edits(spark):
    """Every edit at every place, doubled letters, letters that share a bit, chains of three forms, ties."""
    base = "receiveß"
    rows, texts = [], [base] * 30_000
    edits = {base[:i] + base[i + 1 :] for i in range(8)} | {base[:i] + x + base[i + 1 :] for i in range(8) for x in "aeéÿ"} | {base[:i] + x + base[i:] for i in range(9) for x in "reß÷"}
    texts += [w for w in sorted(edits) for _ in range(25)]
    texts += ["recieveß"] * 3 + ["aaaaaaaa"] * 40 + ["aaaaaaab"] * 40 + ["aaaaaaaaa"] * 4
    chain = ["misspelling", "mispelling", "mispeling", "mispelin"]
    texts += [w for i, w in enumerate(chain) for _ in range(40 * 11 ** (3 - i) // 11 if i else 40 * 11**2)]
    for i in range(0, len(texts), 50):
        rows.append((i, " ".join(texts[i : i + 50])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in variants.groups(docs).collect()]
    same(got, _groups(rows))
    assert any(r[1] not in (None, r[2]) for r in got)


def test_mask_bands():
    """One edit flips at most two bits, so one band of three stays."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzàéîõüÿ×÷ÀÞ"
    mask = lambda w: int(np.bitwise_xor.reduce(variants._BITS[np.frombuffer(w.encode(), np.uint8)]))
    for _ in range(2000):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 15)))
        i, c = rng.randrange(len(w)), rng.choice(letters)
        for v in (w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]):
            x = mask(w) ^ mask(v)
            assert x.bit_count() <= 2 and any(not x >> 21 * k & 0x1FFFFF for k in range(3))


# ---- 10 benchmark decontamination, by blocks


@pytest.mark.parametrize("window", [1, 4, 5, 10])
@pytest.mark.parametrize("part_bytes", [60, 1 << 20])
def test_blocks_find_every_window(spark, window, part_bytes):
    """Few different words, so that blocks repeat, overlap and run over the ends of items and texts; items longer than a part."""
    rng = random.Random(window)
    say = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, window - 1, window, window + 1, 40]), "abc")) for i in range(12)] + [(50, "a " * 45), (51, None)]
    texts = [(i, say(rng.randrange(0, 60), "abcd")) for i in range(40)] + [(40, "A a-A " * 30), (41, None)]
    texts += [(60 + i, f"x {items[i][1]} y {items[(i + 3) % 12][1]}") for i in range(12)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.hits(docs, bench, window, part_bytes).collect()}
    for d, text in texts:
        words, hit, ids = brute.contamination(text, items, window)
        spans = [m.span() for m in brute.ALNUM.finditer(brute.low(text))]
        assert (got[d].n_words, got[d]["items"]) == (len(words), ids)
        assert got[d].hit_from == [a for (a, _), h in zip(spans, hit, strict=True) if h], (d, text)


def test_automaton_stays_small():
    """As many nodes as the benchmark has characters at the most; a text in which an item runs on is followed once."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))).encode() for _ in range(30_000)]
    items = [(str(i), b" ".join(rng.choice(words) for _ in range(2000))) for i in range(80)]
    of = decontaminate.Machine(items, 10)
    stats = of.automaton.get_stats()
    size = sum(len(t) for _, t in items)
    assert stats["nodes_count"] <= 1.3 * size and stats["total_size"] <= 80 * size
    raw = np.frombuffer(b"start " + items[3][1] + b" end", np.uint8)
    ((n, _, _, hit, found),) = decontaminate.scan(raw, np.array([0, len(raw)]), of)
    assert n == 2002 and hit.sum() == 2000 and not hit[0] and not hit[-1] and found == {"3"}

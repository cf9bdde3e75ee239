"""Plain versions of the operators, over lists of (doc_id, text)."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    w = [x.encode() for x in WORD.findall(low(text))]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, radius=3):
    """doc_id -> smallest doc_id reachable."""
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = [(i, fingerprint(t)) for i, t in rows if i is not None]
    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def substrings(rows, n=20):
    """doc_id -> (words, kept words); rows with one id and text count once, null ids last."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if k in seen:
                gone[s : s + n] = [True] * n
            seen.add(k)
        out[i] = w, [x for x, g in zip(w, gone, strict=True) if not g]
    return out


def contamination(text, items, n=10):
    """(words, hit, ids)."""
    windows = {}
    for item, body in items:
        w = ALNUM.findall(low(body))
        m = min(n, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add(str(item))
    w = ALNUM.findall(low(text))
    hit, ids = [False] * len(w), set()
    for m in {len(k) for k in windows}:
        for s in range(len(w) - m + 1):
            if (k := tuple(w[s : s + m])) in windows:
                ids |= windows[k]
                hit[s : s + m] = [True] * m
    return w, hit, sorted(ids)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()

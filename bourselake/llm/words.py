"""Words, word hashes and hashes of word runs over a whole slice of texts, in numpy."""

from __future__ import annotations

import zlib

import numpy as np

U = np.uint64
_M1, _M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_BYTE, _WORD = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_BLOCK = 1 << 18
_powers: dict[int, np.ndarray] = {}

#: Separators [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: All of ASCII but digits and letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x41:0x5B] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def find_words(raw: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts and ends of all words in raw, and for each text the index of its first word (with the count of all at the end)."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    return find_runs(~separators[raw], offs)


def find_runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts and ends of all runs of bytes that are inside, none across a text's border, and for each text the index of its first run."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * _M1
    x ^= x >> U(33)
    x *= _M2
    x ^= x >> U(33)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 14), U(base & (2**64 - 1)))
        factors[0] = 1
        have = _powers[base] = np.multiply.accumulate(factors)
    return have[:n]


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """For each run its polynomial in base modulo 2 ** 64, from prefix sums; starts and ends ascend."""
    out = np.empty(len(starts), U)
    inverse = pow(base, -1, 2**64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        high = int(ends[to - 1])
        sums = np.zeros(high - low + 1, U)
        np.cumsum(values[low:high].astype(U) * _power(base, high - low), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * _power(inverse, high - low + 1)[s]
        at = to
    return out


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(_runs(raw, starts, ends, _BYTE) + (ends - starts).astype(U) * _M2)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive hashes: one for each start, without regard to texts."""
    if len(hashes) < n:
        return np.empty(0, U)
    starts = np.arange(len(hashes) - n + 1)
    return mix(_runs(hashes, starts, starts + n, _WORD) + U(n))


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space after each, and where they start and end in that."""
    lengths = ends - starts
    to = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1] + 1, out=to[1:])
    total = int(lengths.sum()) + len(starts)
    out = np.full(total, 0x20, np.uint8)
    shift = np.repeat(to - starts, lengths)
    source = np.arange(len(shift)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out[source + shift] = raw[source]
    return out.tobytes(), to, to + lengths


def _crc_table() -> np.ndarray:
    """The 256 remainders of CRC-32's reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1)).astype(np.uint32)
    return t


_CRC = _crc_table()
#: Spans beyond so many bytes go one by one through zlib.
_LONG = 48


def span_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned CRC-32 of each span of raw, all spans together byte by byte; `before`: the CRC-32 of what stands in front of each."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    state = np.full(len(s), 0xFFFFFFFF, np.uint32) if before is None else ~before.astype(np.uint32)[order]
    long = int(np.searchsorted(-n, -_LONG, "left"))
    for i in range(long):
        state[i] = zlib.crc32(raw[s[i] : s[i] + n[i]], int(~state[i])) ^ 0xFFFFFFFF
    s, n, short = s[long:], n[long:], state[long:]
    for p in range(int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -p, "left"))
        now = short[:k]
        short[:k] = _CRC[(now ^ raw[s[:k] + p]) & 0xFF] ^ (now >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    return out

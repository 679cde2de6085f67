"""Per-text helpers shared by the corpus operators; pure functions of one text."""

import numpy as np
import xxhash

#: The six ASCII characters that separate words; ``bytes.split()`` cuts at just these.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: 65,536 shingles are expanded to bits at a time, so that a long text needs bounded memory.
BIT_BLOCK = 1 << 16
#: A random number for each byte, zero for blanks.
RANDOM = np.random.default_rng(7)
BYTE = RANDOM.integers(1, 1 << 64, 256, np.uint64)
BYTE[[ord(c) for c in BLANKS]] = 0
BLANK = BYTE == 0
ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as bytes; none for null."""
    return text.encode("utf-8", "replace").split() if text else []


def ranks(items):
    """Each item's rank of first appearance, as int64."""
    seen = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in items), np.int64, len(items))


def repeated_cover(items, size):
    """How many items lie in a window of ``size`` that is found twice or more in the list."""
    n = len(items) - size + 1
    if n < 2:
        return 0
    code = ranks(items)
    key = code[:n]
    for k in range(1, size):
        key = np.unique(key * (int(code.max()) + 1) + code[k : k + n], return_inverse=True)[1]
    hit = np.flatnonzero(np.bincount(key)[key] > 1)
    edge = np.zeros(len(items) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def shingles(text, size=5, seed=42):
    """(hash of the lower-cased words, sorted distinct XXH64 of the word shingles as int64); a shorter text is one shingle."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    line = b" ".join(words)
    whole = np.frombuffer(xxhash.xxh64_digest(line, seed), np.int64)[0]
    if not words:
        return whole, np.zeros(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(line[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist())])
    return whole, np.unique(np.frombuffer(raw, np.int64))


def simhash(text, size=4, seed=42):
    """64-bit fingerprint of a text: a bit is set where over half of its word shingles' XXH64 have it."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    pairs = list(zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, BIT_BLOCK):
        raw = b"".join([digest(line[s:e], seed) for s, e in pairs[at : at + BIT_BLOCK]])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def by_bytes(items, limit, size=len):
    """The items in lists of about ``limit`` bytes at most; one that is larger stands alone."""
    held, total = [], 0
    for x in items:
        n = size(x)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(x)
        total += n
    if held:
        yield held


def mixed(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(raws):
    """(hash of each word, number of words of each byte string)."""
    data = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
    blank = BLANK[data]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    edges = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    counts = np.diff(np.searchsorted(starts, edges))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lens = np.diff(np.append(starts, len(data)))
    power = np.cumprod(np.full(int(lens.max()), ODD, np.uint64))
    within = np.arange(starts[0], len(data)) - np.repeat(starts, lens)
    return mixed(np.add.reduceat(BYTE[data[starts[0] :]] * power[within], starts - starts[0])), counts

import random

import numpy as np
import pytest
import xxhash

from airloom.llm import simhash_dedup as s
from airloom.llm.components import components
from airloom.llm.textops import simhash


def brute(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps):
    fps = sorted(fps)
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 4:
                up[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints():
    for t in (None, "", "one", "A b\tC d", "a b c d e a b c d e f", "É ß x y z " * 40):
        assert simhash(t) == brute(t)


def test_blocks_follow_the_count():
    for n in s.BLOCKS:
        own = s.blocks(n)
        assert sum(own) == (1 << 64) - 1 and all(m.bit_count() % 2 == 0 for m in own)
    assert [s.blocks_for(10**k) for k in (0, 6, 8, 9, 10, 11)] == [8, 8, 8, 10, 12, 12]


@pytest.mark.parametrize("n", [None, *s.BLOCKS])
def test_links_and_components_match_brute_force(spark, n):
    rng = random.Random(5)
    fps = {0}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    fps = [s.signed(x) for x in fps]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    pairs = {(r.a, r.b) for r in s.links(df, n).collect()}
    a = np.array(sorted(fps), np.int64)
    want = {(int(x), int(y)) for i, x in enumerate(a) for y in a[i + 1 :] if bin(int(np.uint64(x) ^ np.uint64(y))).count("1") <= 4}
    assert pairs == want
    got = {r.v: r.root for r in components(spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    groups = roots(fps)
    same = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert same(got) == {g for g in same(groups) if len(g) > 1}


def test_cells_are_not_broadcast(spark):
    """Cells are many times the fingerprints that Spark sizes them by."""
    text = s.links(spark.range(200).withColumnRenamed("id", "fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text, text


def test_long_path_and_empty_graph(spark):
    df = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in components(df).select("root").collect()} == {0}
    assert components(df.limit(0)).count() == 0


def test_near_unique_keeps_one_of_each_group(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base), (3, base), (3, base), (None, base), (9, "other text"), (None, ""), (None, None), (2, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "'x' as fp")
    kept = s.near_unique(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(2, " "), (3, base), (9, "other text")]
    assert s.near_unique(df.limit(0)).count() == 0

import random

import numpy as np
import pytest

from airloom.llm import substring_dedup as s
from airloom.llm.textops import word_hashes


def brute(rows, window=13):
    first = {}
    ids = [(s.NO_ID if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, w in ids:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in ids:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                keep[i : i + window] = [False] * window
        out.append((d, b" ".join(x for x, k in zip(w, keep) if k).decode()))
    return sorted(out)


def test_levels():
    assert s.levels(13) == [7, 13] and s.levels(50) == [7, 13, 25, 50] and s.levels(5) == [5]


def test_word_hashes():
    h, n = word_hashes([b"a b\x0ba", b"", b"  ", b"b \x1c a"])
    assert n.tolist() == [3, 0, 0, 3] and h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    ids = np.sort(rng.integers(-5, 2**62, 50)).repeat(4)
    keys = rng.integers(-(2**63), 2**63 - 1, 50).repeat(4)
    pos = np.sort(rng.integers(0, 10**6, (50, 4)), axis=1).ravel()
    hashes = rng.integers(0, 2**64, 200, np.uint64)
    import pandas as pd

    more = hashes[::-1].copy()
    pdf = pd.DataFrame(list(s.packed(np.arange(200) % 3, ids, keys, pos, hashes, 8, more)), columns=s.PACKED.names)
    got = sorted(zip(*[x.tolist() for x in s.unpacked(pdf)]))
    assert got == sorted(zip(ids.tolist(), keys.tolist(), pos.tolist(), hashes.tolist(), more.tolist()))


@pytest.mark.parametrize("window, narrow", [(5, 4), (13, 4), (13, 1), (30, 4), (30, 1)])
def test_matches_brute_force(spark, window, narrow, monkeypatch):
    rng = random.Random(window)
    words = [f"w{i}é" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    rows = []
    for d in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(6))]
        rows.append((d if d % 17 else None, " ".join(x for p in parts for x in p)))
    rows += [(4, rows[4][1]), (4, "other " * 30), (7, None), (8, ""), (200, "other " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as id", "2 as key", "3 as part").repartition(3)
    monkeypatch.setattr(s, "BUCKET", 100)
    monkeypatch.setattr(s, "WORKING_SET", 500)
    got = sorted((s.NO_ID if r.doc_id is None else r.doc_id, r.text) for r in s.remove_repeats(df, window, narrow).collect())
    assert got == brute(rows, window)


def test_chance_agreements_of_narrow_hashes_remove_nothing(spark):
    df = spark.range(3000, numPartitions=3).selectExpr("id as doc_id", "concat('all rights reserved by the owners of n', id, ' b c d e f') as text")
    assert s.repeated_windows(df, 13, narrow=1).count() == 0
    half = s.from_words(s.keyed(df).select("id", "key", "text"), s.Level([7, 13], 0, 1, 1))
    assert s.starts_of(half, 6).count() > 2500  # one byte tells few of the halves apart, so nearly all are candidates


def test_long_texts_and_shared_keys(spark, monkeypatch):
    text = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(1, text), (2, text + " end"), (3, "short")]
    got = sorted((r.doc_id, r.text) for r in s.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
    monkeypatch.setattr(s, "keyed", lambda d: d.selectExpr("*", "doc_id as id", "7L as key"))  # two texts of one id that can't be told apart by key
    rows = [(1, "a b c d e f g h i j k l m"), (2, "x a b c d e f g h i j k l m y"), (2, "a b")]
    got = s.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.id, s.positions(r.starts).tolist()) for r in got] == [(2, [1])]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert s.remove_repeats(df).count() == 0

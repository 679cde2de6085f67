import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from airloom.llm import lexical_search as s

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, w, Counter(w)) for i, w in own if w]
    total, df = sum(len(w) for _, w, _ in own), Counter(t for _, _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, w, c in own:
            m = 100 - 50 + (50 * len(w) * len(own)) // total
            score = sum(math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return Counter(out)


def test_terms():
    for t in (None, "", "É a-B_c9 x\x7f{y}  Z", "A b\n\tA", "`@[/:"):
        n, found = s.counted(t, block=3)
        assert n == len(terms(t)) and found == Counter(x.encode() for x in terms(t))


@pytest.mark.parametrize("seed, block_terms, step", [(1, 10**6, 10**6), (2, 9, 40), (3, 30, 1)])
def test_matches_brute_force(spark, seed, block_terms, step):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.5)) % 60}" for _ in range(2000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(150)] + [(7, "w1 w2 W1"), (7, "w1 w2 W1"), (None, "w1 w2 w1"), (None, "w1 w2 w1"), (900, None), (901, ""), (902, " -- "), (903, "w3 " * 5000)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)] + [(3, "w1"), (3, "w1"), (None, "W2 w2"), (50, None), (51, "?"), (52, "nowhere")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(5)
    got = s.ranked(d, spark.createDataFrame(items, "item_id long, text string"), 6, block_terms, step)
    assert Counter(map(tuple, got.collect())) == brute(docs, items, 6)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert s.ranked(none, items).count() == 0 and s.ranked(docs, items.filter("false")).count() == 0
    assert s.ranked(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).count() == 0


def test_bounds_prune_frequent_terms():
    import pandas as pd

    stats = pd.DataFrame({"term": [0, 1, 2], "df": [3, 500, 9000], "w": [9000, 3000, 10], "top": [900, 300, 10], "kth": [0, 290, 9]})
    plan = s.Plan([np.array([2, 0, 1])], stats, 3)
    on, rest = plan.split(plan.least)
    assert plan.least.tolist() == [290] and on.tolist() == [True, True, False] and rest.tolist() == [10]
    assert plan.suffix.tolist() == [1210, 310, 10]
    d, i, score = s.scored(plan, plan.least, np.array([0, 1, 1, 2]), np.array([2, 1, 2, 1]), np.array([10, 280, 10, 270]))
    assert (d.tolist(), i.tolist(), score.tolist()) == ([1], [0], [290])

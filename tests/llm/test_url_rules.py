import itertools
import random
import time

from pyspark.sql import functions as F

from airloom.llm import url_filter


def test_low_quality_and_toxic_pages_are_each_bad(spark):
    labels = [(1, 0, 0), (2, 1, 1), (3, 0, 1), (4, 1, 0), (5, None, 1), (6, None, None)]
    pages = spark.createDataFrame([(k, f"http://host{k}.org/a") for k, _, _ in labels], "page_id long, url string")
    rows = url_filter.labelled_urls(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r.tokens[0]: r.bad for r in rows} == {f"h:host{k}": k in (1, 2, 3, 5) for k, _, _ in labels}


def test_support_is_the_same_at_every_size(spark):
    bad = [([f"h:site{k % 4}", "p:x"], True) for k in range(3000)] + [(["h:small", "p:x"], True)] * 5 + [(["h:site0", "p:x"], False)] * 1000 + [(["p:x"], False)] * 1000
    rules = url_filter.mined(spark.createDataFrame(bad, "tokens array<string>, bad boolean")).collect()
    assert {tuple(r.rule): r.support for r in rules} == {("h:site1",): 750, ("h:site2",): 750, ("h:site3",): 750, ("h:small",): 5}


def test_rules_of_four_tokens_are_kept(spark):
    four = ["a", "b", "c", "d"]
    rows = [(four, True)] * 10 + [(list(x), False) for x in itertools.combinations(four, 3)] * 10
    rules = url_filter.mined(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert [(r.rule, r.support, r.confidence) for r in rules] == [(four, 10, 1.0)]


def brute(rows, support=5, confidence=0.8):
    """Minimal sure rules among all sets of tokens of a bad row."""
    sets = {frozenset(c) for t, bad in rows if bad for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n)}
    found = {}
    for s in sets:
        of = [bad for t, bad in rows if s <= set(t)]
        if sum(of) >= support and sum(of) >= confidence * len(of):
            found[s] = (sum(of), sum(of) / len(of))
    return {tuple(sorted(s)): v for s, v in found.items() if not any(r < s for r in found)}


def test_merged_tokens_give_the_rules_of_all_subsets(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(60):
        family = rng.randrange(4)
        own = [f"f{family}k{i}" for i in range(3)] + rng.sample(["a", "b", "c", "d"], rng.randrange(4))
        rows.append((own, rng.random() < (0.9 if family < 2 or {"a", "b"} <= set(own) else 0.2)))
    got = url_filter.mined(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert {tuple(r.rule): (r.support, r.confidence) for r in got} == brute(rows) and len(got) == len(brute(rows)) > 3


def test_urls_of_many_shared_keys_are_mined_in_time(spark):
    url = "http://shop.example.org/list?" + "&".join(f"key{i}=1" for i in range(40))
    pages = [(i, url if i < 5 else f"http://fine{i}.example.org/list") for i in range(25)] + [(90, "http://x.test/?key3=2&key7"), (91, None), (92, "")]
    labels = [(i, int(i >= 5), 0) for i in range(25)]
    pages, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    began = time.time()
    rows = {r.page_id: r for r in url_filter.judged(pages, url_filter.labelled_urls(pages, labels)).collect()}
    assert time.time() - began < 60
    assert {k for k, r in rows.items() if r.verdict == "block"} == {0, 1, 2, 3, 4, 90}
    assert rows[90].n_mined == 2 and rows[0].n_mined == 41 and rows[6].n_mined == 0


def test_long_segments_and_keys_differ_by_their_ends(spark):
    slug = "s" * 70
    urls = [f"http://a.org/{slug}{x}?{slug}{y}=1" for x in "ab" for y in "ab"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.tokens(F.col("url")).alias("t")).collect()
    assert len({tuple(r.t) for r in rows}) == 4 and all(len(x) < 40 for r in rows for x in r.t)

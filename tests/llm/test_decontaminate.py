import random

from airloom.llm import decontaminate as d


def test_substitutions_are_tolerated_and_clean_texts_left_alone(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(40)]
    noise = [word() for _ in range(200)]
    touched = [w if i % 8 else "zzz" for i, w in enumerate(item)]
    shuffled = item[:]
    rng.shuffle(shuffled)
    docs = [
        (1, " ".join(noise[:50] + item + noise[50:])),
        (2, ", ".join(noise[:30] + touched).upper()),
        (3, " ".join(noise)),
        (4, " ".join(noise[:20] + shuffled)),
        (5, " ".join(noise[:20] + item[:15])),
        (6, None),
        (7, ""),
        (8, " ".join(item[10:32])),
        (1, " ".join(noise)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as seed")
    items = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    rows = d.contaminated(df, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 7), (2, 7), (8, 7)]
    kept = d.decontaminated(df, items)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]
    assert d.decontaminated(df, items.limit(0)).count() == len(docs)
    assert d.contaminated(df.limit(0), items).count() == 0


def test_clashing_column_names(spark):
    item = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, item), (2, "clean text")], "doc_id long, text string").selectExpr("*", "doc_id as bad", "text as d", "1 as _bad", "2 as `a.b`")
    kept = d.decontaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(2, "clean text", 2, "clean text", 1, 2)]


def test_finds_every_planted_item(spark):
    import re

    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    texts = {r.item_id: norm(r.text) for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, x in texts.items() if x in norm(r.text)}
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()}
    assert want <= got and len(got - want) <= 0.02 * len(want)

import random
import re

from pyspark.sql import functions as F

from airloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(lines), len(covered)


def test_measures_match_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "é\x85b\x1cc  d", "a b a b a b a", "x\nx\n \nx y\nx y"] + ["".join(rng.choice("ab# \n\té<") for _ in range(rng.randrange(200))) for _ in range(200)]
    assert [q.measure(t) for t in texts] == [brute(t) for t in texts]


def test_bad_host_goes_and_small_hosts_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(80))
    odd = " ".join(f"w{i}###" for i in range(80))
    rows = [(i, good, "fine") for i in range(60)] + [(100 + i, odd, "bad") for i in range(60)] + [(300, odd, "tiny"), (301, good, None), (302, None, "fine"), (303, good, "bad")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("m", F.lit("clash")).withColumn("kept", F.lit(1))
    kept = {r.doc_id for r in q.quality_filter(df).select("doc_id").collect()}
    assert kept == set(range(60)) | {300, 301}
    assert q.quality_filter(df).columns == df.columns
    assert q.quality_filter(df.limit(0)).count() == 0


def test_query(spark):
    from airloom.llm.registry import queries

    sf = "/root/testdata/sf0.001"
    rows = queries()["op7_quality_host_rules"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows[:60]:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == brute(texts[r.doc_id])[:4]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)

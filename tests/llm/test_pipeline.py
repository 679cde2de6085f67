import re

import corpus_pipeline
from pyspark.sql import functions as F

from airloom.llm import bpe, pii, quality_rules

from .test_near_dedup import smallest_of_groups

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    kept = []
    for r in rows:
        m = quality_rules.measure(r["text"])
        if m[0] >= 50 and 100 * m[5] <= 50 * m[0]:
            kept.append(r)
    stay = set(smallest_of_groups([(r["doc_id"], r["text"]) for r in kept], 5, 0.8))
    kept = [r for r in kept if r["doc_id"] in stay]
    norm = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    tests = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [r for r in kept if not any(x in norm(r["text"]) for x in tests)]
    field = pii.fitted(spark.createDataFrame([(r["text"],) for r in kept], "text string"))
    own = bpe.tokenizer(bpe.public_vocabulary())
    want = {r["doc_id"]: own.encode(pii.masked(field, r["text"]), add_special_tokens=False).ids for r in kept}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == want
    assert all(r.decoded == own.decode(list(r.ids), skip_special_tokens=False) and r.n_tokens == len(r.ids) for r in rows)


def test_odd_rows_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string")})
    empty = docs.limit(2).withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    docs = docs.union(docs.limit(5)).union(odd).union(empty).withColumns({k: F.lit(1) for k in ("m", "d", "kept", "fp", "key", "w", "root", "a.b")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert "a.b" in docs.columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) > 0


def test_stages_pass_on_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "n_tokens", "ids", "decoded"]

import random

import pytest

from airloom.llm import bpe

VOCABULARY = bpe.public_vocabulary()
ODD = [
    None, "", " ", "á ́b", "<|startoftext|>x y<|endoftext|>", "İSTANBUL ΣΑΣ", "x" * 10000, "it's we're I'll 'S nb sp\x0b\x0cq\x85z",
    "日本語 テキスト 123456 ½", "\n\n\t a" * 3000, "e" + "́" * 500 + " b", "<|start oftext|>", "a\x1cb\x1fc", "é" * 5000,
]


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return " ".join(map(str, ids)).encode(), tokenizer.decode(ids, skip_special_tokens=False).encode(), len(ids)


@pytest.mark.parametrize("limit", [3, 100000])
def test_equals_the_library(monkeypatch, limit):
    monkeypatch.setattr(bpe, "MAX_WORDS", limit)
    bpe.loaded.cache_clear()
    rng = random.Random(1)
    pool = ["the", "thing's", "Éa", "x1", "!!", "\n", "  ", "<|", "ß", "don't", "\t", "🙂", "a-b"]
    texts = ODD + [" ".join(rng.choice(pool) for _ in range(rng.randrange(400))) for _ in range(40)]
    coder, own = bpe.Coder(VOCABULARY), bpe.tokenizer(VOCABULARY)
    for t in texts:
        assert coder.encode(t) == expected(own, t)


def test_chunks_are_content_defined():
    rng = random.Random(2)
    body = bytes(rng.randrange(97, 123) for _ in range(60000))
    a, b = bpe.chunks(body), bpe.chunks(b"prefix " + body)
    assert b"".join(a) == body and b"".join(b) == b"prefix " + body
    assert len(set(a) & set(b)) >= len(a) - 8 and max(map(len, a)) <= bpe.MAX_CHUNK


def test_cuts_don_t_depend_on_blocks(monkeypatch):
    raw = random.Random(4).randbytes(50000)
    whole = bpe.cuts(raw)
    monkeypatch.setattr(bpe, "HASH_BLOCK", 1000)
    assert bpe.cuts(raw) == whole


def test_frames(spark):
    passage = " ".join(f"shared{i} passage" for i in range(400))
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50 + i, f"start {i} {passage} end {i}") for i in range(4)] + [(None, "no id"), (50, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'x' as ids")
    assert bpe.shared_chunks(df).count() > 3
    assert len(bpe.dictionary(df, VOCABULARY, 2)) <= 2
    own = bpe.tokenizer(VOCABULARY)
    got = bpe.encode(df, VOCABULARY)
    want = sorted((d if d is not None else -1, own.encode(t or "", add_special_tokens=False).ids) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in got.collect()) == want
    back = {r.doc_id: r.decoded for r in bpe.decode(got.filter("doc_id between 0 and 40"), VOCABULARY).collect()}
    for i, t in enumerate(ODD):
        assert back[i].encode() == expected(own, t)[1]
    assert bpe.digests(df.limit(0), VOCABULARY).count() == 0

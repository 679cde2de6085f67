import zlib

import numpy as np

from airloom.llm import importance, language_id
from airloom.llm.registry import queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries()["op9_output_codes"](spark, SF).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_decoding_matches_brute_force():
    rng = np.random.default_rng(5)
    means = rng.random((5, 1 << language_id.BITS)) ** 8
    means /= means.sum(axis=1, keepdims=True)
    decoder = language_id.Decoder(list("abcde"), means)
    profiles = 0.7 * means[rng.integers(0, 5, 40)] + 0.3 * means[rng.integers(0, 5, 40)]
    best, score, unsure = decoder.predict(profiles)
    for p, b, s, u in zip(profiles, best, score, unsure):
        loss = []
        for word in decoder.code:
            margins = [((p * w).sum() - mid) / half for w, mid, half in zip(decoder.w, decoder.middle, decoder.half)]
            loss.append(sum(k * np.log(1 + np.exp(-3 * m * bit)) for k, m, bit in zip(decoder.weight, margins, word)))
        share = np.exp(-3 * np.array(loss)) / np.exp(-3 * np.array(loss)).sum()
        assert b == np.argmin(loss) and abs(s - share.max()) < 1e-9 and u == (sorted(share)[-2] > 0.5 * share.max())


def test_codewords_differ():
    for n in (1, 2, 4, 6, 9, 40):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code}) == n and code.shape[0] == n


def test_undetermined_and_odd_rows(spark):
    rows = [(1, "the cat and the dog " * 30, "en"), (2, "der hund und die katze " * 30, "de"), (3, None, "en"), (4, "123 !!", None), (None, "the dog", "en"), (6, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as language_x")
    decoder = language_id.fitted(df)
    got = {r.doc_id: r.language.lang_pred for r in language_id.identified(df, decoder).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", None: "en", 6: "und"}
    empty = language_id.fitted(df.limit(0))
    assert {r.language.lang_pred for r in language_id.identified(df, empty).collect()} == {"und"}


def test_good_documents_are_kept(spark):
    rows = {r.doc_id: r for r in queries()["op1_gumbel_resampling"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    share = lambda q, t: np.mean([rows[r.doc_id].kept for r in labels if r.quality == q and r.toxic == t])
    assert share(1, 0) > 0.97 and share(0, 0) < 0.2


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(0)
    keys = np.concatenate([rng.normal(size=3000), np.zeros(500)])
    df = spark.createDataFrame([(float(x),) for x in keys], "key double").cache()
    for k in (1, 7, 1500, 3500):
        least = np.sort(keys)[::-1][k - 1]
        assert importance.kth_largest(df, k) == (least, (keys > least).sum())


def plain_grams(text):
    """Buckets of words and word pairs, one word at a time."""
    h = [importance.word_hashes([w])[0][0] for w in (text or "").lower().encode().split()]
    with np.errstate(over="ignore"):
        pairs = [importance.mixed(np.array([a * importance.ODD + b]))[0] for a, b in zip(h, h[1:])]
    return [int(x % np.uint64(importance.BUCKETS)) for x in h + pairs]


def test_models_weights_and_sample_match_brute_force(spark):
    texts = ["A b c a", "", None, "x " * 1000, "é ß", "a b b c", "a b c d e f g " * 9] + ["the same"] * 4
    ids = [0, 1, 2, 3, 4, 5, None, 7, 7, 7, 7]
    rows = [(i, t, 1) for i, t in zip(ids, texts)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").coalesce(1)
    good = spark.createDataFrame([(0,), (5,), (None,)], "doc_id long")
    raw, target = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    for i, t, _ in rows:
        for b in plain_grams(t):
            raw[b] += 1
            target[b] += i in (0, 5)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(importance.models(df, good), ratio)
    got = importance.weighed(df, ratio).collect()
    assert all(abs(r.log_weight - sum(ratio[b] for b in plain_grams(t))) < 1e-6 for r, (_, t, _) in zip(got, rows))
    for share in (0.0, 0.003, 0.31, 0.5, 1.0):
        k = int(np.ceil(share * len(rows)))
        kept = [r for r in importance.resampled(df, good, share).collect()]
        assert sum(r.kept for r in kept) == k
        assert min([r.key for r in kept if r.kept], default=np.inf) >= max([r.key for r in kept if not r.kept], default=-np.inf)
    assert importance.resampled(df.limit(0), df.select("doc_id"), 0.5).count() == 0
    assert importance.resampled(df, df.limit(0).select("doc_id"), 1.0).filter("kept").count() == len(rows)

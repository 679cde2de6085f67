"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a binary classifier that tells the languages with a one from those with a
zero by byte n-grams (log odds of their shares in the two groups). A text's margins on all bits are compared with each
codeword by a logistic loss, bits weighted by how far apart they hold the languages; the nearest codeword wins. The
score is the winner's share of ``exp(-loss)``; a text is ambiguous if the runner-up's share comes close.

Learnt from at most about ``TRAIN_ROWS`` labelled documents (taken by hash), each with equal weight. Texts without a
letter, null texts and any text when there is nothing to learn from give ``und`` with score 0; very long texts are read whole. Of equal
losses the first language by name wins. Rows are judged one by one, so repeated rows don't matter; other columns are not read.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, table

TRAIN_ROWS = 20_000
BITS = 13
LETTER = re.compile(r"[^\W\d_]")
#: Signs and digits of ASCII become blanks.
FOLD = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
BLOCK = 1 << 20


def profile(text):
    """Counts of hashed two- and three-byte n-grams of a whole text, as shares; None without a letter."""
    if not text or not any(m.group().isalpha() for m in LETTER.finditer(text)):
        return None
    raw = b" ".join(text.lower().encode("utf-8", "replace").translate(FOLD).split())
    raw = b" " + raw + b" "
    total = np.zeros(1 << BITS)
    for at in range(0, len(raw), BLOCK):
        b = np.frombuffer(raw[at : at + BLOCK + 2], np.uint8).astype(np.uint32)
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        for g, salt in ((two, 2654435761), (three, 2246822519)):
            total += np.bincount((g * np.uint32(salt)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total / total.sum()


def codewords(n):
    """A matrix of -1 and 1, languages by bits: of some random ones without a constant bit, the one of greatest least distance."""
    if n == 1:
        return np.ones((1, 1))
    width = int(np.ceil(12 * np.log2(n)))
    best, most = None, -1
    for seed in range(64):
        m = np.where(np.random.default_rng(seed).random((n, 4 * width)) < 0.5, -1.0, 1.0)
        m = m[:, np.abs(m.sum(axis=0)) < n][:, :width]
        least = (m.shape[1] - (m @ m.T)[np.triu_indices(n, 1)]).min()
        if least > most:
            best, most = m, least
    return best


class Decoder:
    """Made from each language's mean profile."""

    def __init__(self, languages, means):
        self.languages = languages
        self.code = codewords(len(languages)) if languages else np.zeros((0, 0))
        if len(languages) < 2:
            return
        smooth = means + 1e-6
        one, zero = self.code.T > 0, self.code.T < 0
        groups = [(smooth[o].mean(axis=0), smooth[z].mean(axis=0)) for o, z in zip(one, zero)]
        self.w = np.array([np.log(a / b) for a, b in groups])
        at = means @ self.w.T  # margins of the languages themselves
        low = np.array([at[o, k].min() for k, o in enumerate(one)])
        high = np.array([at[z, k].max() for k, z in enumerate(zero)])
        self.middle, gap = (low + high) / 2, np.maximum(low - high, 1e-3)
        self.half, self.weight = gap / 2, gap / gap.sum()

    def predict(self, profiles):
        """(index of the nearest codeword, score, ambiguous) of each profile."""
        if len(self.languages) == 1:
            return np.zeros(len(profiles), int), np.ones(len(profiles)), np.zeros(len(profiles), bool)
        margin = (profiles @ self.w.T - self.middle) / self.half
        loss = (np.logaddexp(0, -3 * margin[:, None, :] * self.code[None]) * self.weight).sum(axis=2)
        p = np.exp(-3 * (loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        return p.argmax(axis=1), top[:, -1], top[:, -2] > 0.5 * top[:, -1]


def fitted(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Decoder:
    """A decoder from the rows' ``text`` and ``lang``."""
    session(docs)
    rows = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = max(1, rows.count())
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) < train_rows)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("total", T.DoubleType())])

    def sums(batches):
        total = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                p = profile(text)
                if p is not None:
                    n, own = total.get(lang, (0, 0.0))
                    total[lang] = n + 1, own + p
        for lang, (n, own) in total.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1).astype(np.int32), "total": np.append(own[at], n)})

    found = sample.mapInPandas(sums, kind).groupBy("lang", "bucket").agg(F.sum("total").alias("total")).toPandas()  # a row for each language and bucket; -1 counts texts
    languages = sorted(found["lang"].unique())
    means = np.zeros((len(languages), 1 << BITS))
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        inside = own["bucket"].to_numpy() >= 0
        means[k, own["bucket"].to_numpy()[inside]] = own["total"].to_numpy()[inside] / own["total"].to_numpy()[~inside][0]
    return Decoder(languages, means)


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def identified(docs: DataFrame, decoder: Decoder) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous`` in a struct column ``language``."""

    @F.pandas_udf(PREDICTED)
    def predict(text: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang_pred": "und", "score": 0.0, "ambiguous": True}, index=range(len(text)))
        if decoder.languages:
            for at in range(0, len(text), 256):
                some = [(k, p) for k, p in enumerate(map(profile, text.iloc[at : at + 256]), at) if p is not None]
                if some:
                    rows = [k for k, _ in some]
                    best, score, unsure = decoder.predict(np.array([p for _, p in some]))
                    out.loc[rows, "lang_pred"] = [decoder.languages[i] for i in best]
                    out.loc[rows, "score"], out.loc[rows, "ambiguous"] = score, unsure
        return out

    return docs.withColumn("language", predict("text"))


def op9_output_codes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    decoder = fitted(docs.filter(~held))
    return identified(docs.select("doc_id", "text", held.alias("held_out")), decoder).select("doc_id", "held_out", "language.*")

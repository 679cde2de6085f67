"""Importance resampling with hashed n-gram models.

Words and word pairs, hashed to ``BUCKETS``, give two multinomial models: of the target (labelled good) and of all
text. A document's log weight is the sum of the log ratios of its n-grams, the log of the likelihood ratio. Gumbel noise is added,
drawn from a hash of the row, so that a lost task draws the same again; the ``k`` largest sums are a sample without replacement by weight.

``k`` is a share of the rows, rounded up, and just so many are kept: the k-th largest sum is found by histograms that close
in on it, and of rows that tie with it (repeated rows have equal noise) those that come first in the written table are kept. Null and
empty texts have log weight zero; very long texts are weighed whole. Without labels the two models are equal. Other columns are not read.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, small, table, written
from .textops import ODD, by_bytes, mixed, word_hashes

BUCKETS = 1 << 14
#: Bytes of text hashed at a time; each needs some forty bytes of arrays.
HASH_BYTES = 2 << 20
#: Target ids are broadcast up to this many rows (16 MB); beyond it the join shuffles.
MAX_BROADCAST_IDS = 1_000_000
BINS = 1000


def grams(raws):
    """(bucket of each n-gram, the place of its text in ``raws``) of lower-cased byte strings."""
    h, counts = word_hashes(raws)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[1:] == owner[:-1]
    pairs = mixed(h[:-1] * ODD + h[1:])[inside]
    of = np.concatenate([owner, owner[:-1][inside]])
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64), of


def pieces(texts):
    """(first place, ``grams``) of some texts at a time."""
    at = 0
    for raws in by_bytes(((x or "").encode("utf-8", "replace").lower() for x in texts), HASH_BYTES):
        yield at, len(raws), *grams(raws)
        at += len(raws)


def models(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability by bucket; ``good`` has the target's ``doc_id``."""
    session(docs)
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "raw", "target")])
    ids = small(written(good.select(F.col("doc_id").alias("_good")).filter("_good is not null").distinct()), MAX_BROADCAST_IDS)
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_good"), "left").select("text", F.col("_good").isNotNull().alias("good"))

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch["good"].to_numpy()
            for at, _, bucket, of in pieces(batch["text"]):
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[at + of]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})

    found = rows.mapInPandas(count, kind).groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()  # BUCKETS rows at most
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, r, t in found:
        raw[bucket] += r
        target[bucket] += t
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > BUCKETS else np.zeros(BUCKETS)


def weighed(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``(doc_id, row, log_weight, key)``: the key is the log weight plus Gumbel noise; ``row`` numbers the rows."""

    @F.pandas_udf(T.DoubleType())
    def log_weight(text: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0), *[np.bincount(of, ratio[bucket], minlength=n) for _, n, bucket, of in pieces(text)]]))

    noise = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit("gumbel"))
    u = (F.shiftrightunsigned(noise, 11).cast("double") + 0.5) / float(1 << 53)
    return docs.select("doc_id", log_weight("text").alias("log_weight"), (-F.log(-F.log(u))).alias("noise")).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), "log_weight", (F.col("log_weight") + F.col("noise")).alias("key")
    )


def kth_largest(rows: DataFrame, k: int, key: str = "key"):
    """(the k-th largest key of a written table, how many are larger): each pass counts ``BINS`` ranges and goes on in the one that holds it."""
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    while lo is not None and lo < hi:
        width = (hi - lo) / BINS
        inside = rows.filter((F.col(key) >= lo) & (F.col(key) <= hi))
        at = F.least(F.lit(BINS - 1), F.floor((F.col(key) - lo) / F.lit(width)))
        bins = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        for b in sorted(bins.collect(), key=lambda b: -b.bin):  # BINS rows at most
            if above + b.n >= k:
                lo, hi = b.lo, b.hi
                break
            above += b.n
        else:
            break
    return lo, above


def resampled(docs: DataFrame, good: DataFrame, share: float) -> DataFrame:
    """``(doc_id, log_weight, key, kept)``; ``share`` of the rows, rounded up, are kept."""
    rows = written(weighed(docs, models(docs, good)))
    k = math.ceil(share * rows.count())
    if not k:
        return rows.withColumn("kept", F.lit(False)).drop("row")
    least, above = kth_largest(rows, k)
    ties = rows.filter(F.col("key") == F.lit(least)).select((-F.col("row")).cast("double").alias("first"))
    last, _ = kth_largest(ties, k - above, "first")
    return rows.withColumn("kept", (F.col("key") > F.lit(least)) | ((F.col("key") == F.lit(least)) & (-F.col("row") >= F.lit(last)))).drop("row")


def op1_gumbel_resampling(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    good = labels.filter("quality = 1 and toxic = 0")
    n, n_good = labels.agg(F.count(F.lit(1)), F.count(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1))).first()
    return resampled(table(spark, sf_dir, "documents"), good, n_good / n if n_good else 1.0)

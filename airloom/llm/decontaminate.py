"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions alone.

Texts are lower-cased and cut into words of letters and digits. Each mask selects some of a few
consecutive words; the hash of the selected words is a seed, so a substituted word that the mask ignores
doesn't hide a match. Test seeds and training seeds are joined; each hit fixes how an item lies on a document, and the
words of both are compared around it: a document is contaminated if some ``window`` aligned words
(the item's own length if that is shorter) agree in ``min_share`` or more.

The seeds miss nothing that the comparison accepts at 20 words and a share of 0.8: the masks are chosen so that in every item of ten
words or more each placement of the allowed substitutions leaves a seed whole, whatever stands around the item. Items of five to nine
words, which allow one, have a seed without each word; shorter ones are one seed. Documents get the seeds of the short lengths that the items have.

The comparison reads only the documents with hits, picked by their ids (a broadcast up to ``MAX_BROADCAST_IDS``, else a shuffle join).

Null and empty texts have no seeds and match nothing; very long texts are read whole. Repeated items and repeated documents give the same
rows as one. Documents of one id are one document: a hit in any is a hit. Of equally good placements the one with more seeds, then the
first, is returned. Other columns are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session, small, table, written

#: Fixed masks for items of ``LONG`` words or more; found by a search over all patterns of substitutions.
MASKS = ["111011", "1101011", "11100101"]
LONG = 10
#: Test seeds are broadcast up to this many rows (about 40 MB); beyond it the join shuffles.
MAX_BROADCAST_SEEDS = 1_000_000
#: Ids of documents with hits are broadcast up to this many (about 40 MB).
MAX_BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def short_masks(n: int) -> list[str]:
    """The masks for items of ``n`` words, fewer than ``LONG``: one for each word that may be substituted."""
    return ["1" * n] if n < 5 else ["1" * k + "0" + "1" * (n - k - 1) for k in range(n)]


def seeds(df: DataFrame, key: str, masks: list[str], text: str = "text") -> DataFrame:
    """``(key, at, seed)``: one row for each mask at each position where it fits."""
    w, span = F.col("w"), max(map(len, masks))  # a word is hashed once, so the copies for the masks are of numbers
    shifted = F.arrays_zip(*[F.slice(w, k + 1, F.size(w)).alias(f"w{k}") for k in range(span)])
    spans = (
        df.select(key, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("w"))
        .filter(F.size("w") >= min(map(len, masks)))
        .select(key, F.posexplode(shifted).alias("at", "s"))
    )
    hashes = [
        F.when(F.col(f"s.w{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(mask), *[F.col(f"s.w{k}") for k, x in enumerate(mask) if x == "1"])) for mask in masks
    ]
    return spans.select(key, "at", F.explode(F.array(*hashes)).alias("seed")).filter("seed is not null")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, shift)``: an item's first word would lie ``shift`` words into the document; each placement once."""
    sized = written(items.withColumn("n", F.size(words(F.col("text")))))
    short = [r.n for r in sized.filter(F.col("n").between(1, LONG - 1)).select("n").distinct().orderBy("n").collect()]
    test = seeds(sized.filter(F.col("n") >= LONG), "item_id", MASKS)
    for n in short:
        test = test.union(seeds(sized.filter(F.col("n") == n), "item_id", short_masks(n)))
    test = written(test.select("item_id", F.col("at").alias("item_at"), "seed").distinct())
    test = small(test, MAX_BROADCAST_SEEDS)
    return (
        seeds(docs, "doc_id", MASKS + [m for n in short for m in short_masks(n)])
        .join(test, "seed")
        .groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.count(F.lit(1)).alias("n_seeds"))
    )


def contaminated(docs: DataFrame, items: DataFrame, window: int = 20, min_share: float = 0.8) -> DataFrame:
    """``(doc_id, item_id, shift, n_seeds, matched, compared)``: each verified pair, where it agrees best."""
    session(docs)
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    found = written(hits(docs, items))
    item_words = items.select(F.col("item_id").alias("_item"), words(F.col("text")).alias("iw"))
    placed = found.join(written(item_words), F.col("item_id").eqNullSafe(F.col("_item")))
    begin, skip = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    ids = small(written(found.select(F.col("doc_id").alias("_hit")).distinct()), MAX_BROADCAST_IDS)
    doc_words = written(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_hit")), "left_semi").select(F.col("doc_id").alias("_doc"), words(F.col("text")).alias("_words")))
    cut = (
        placed.drop("_item")
        .join(doc_words, F.col("doc_id").eqNullSafe(F.col("_doc")))
        .select("doc_id", "item_id", "shift", "n_seeds", F.size("iw").alias("n_item"), F.slice("iw", skip + 1, F.size("iw")).alias("iw"), F.slice("_words", begin + 1, F.size("iw")).alias("dw"))
        .withColumn("n", F.least(F.size("iw"), F.size("dw")))
        .withColumn("same", F.zip_with(F.slice("iw", 1, F.col("n")), F.slice("dw", 1, F.col("n")), lambda a, b: (a == b).cast("int")))
        .withColumn("compared", F.least(F.lit(window), F.col("n_item")))
        .filter(F.col("n") >= F.col("compared"))
        .drop("iw", "dw")
    )
    cut = written(cut)  # the agreements are worked out once, not again for each window
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(1), F.col("n") - F.col("compared") + 1),
            lambda i: F.aggregate(F.slice("same", i, F.col("compared")), F.lit(0), lambda s, x: s + x),
        )
    )
    verified = cut.withColumn("matched", best).filter(F.col("matched") >= min_share * F.col("compared"))
    top = F.max(F.struct("matched", "n_seeds", (-F.col("shift")).alias("_before"), "compared")).alias("t")
    return verified.groupBy("doc_id", "item_id").agg(top).select(
        "doc_id", "item_id", (-F.col("t._before")).alias("shift"), "t.n_seeds", "t.matched", "t.compared"
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no test item is found, with their own columns."""
    bad = written(contaminated(docs, items).select(F.col("doc_id").alias("bad")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    return rows.join(bad, F.col("d.doc_id").eqNullSafe(F.col("bad")), "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])


def op10_spaced_seeds(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Ranked lexical search by a threshold-seeded join.

Each query term keeps three numbers of the corpus: how many documents hold it, its greatest impact and its ``k``-th impact. ``k`` documents
reach a term's ``k``-th impact, so the greatest of an item's is a lower bound of its ``k``-th score. An item's terms are put in order from rare to
frequent; where the greatest impacts from a term on sum up to less than the bound, a document that holds none of the terms before can't
be among the ``k`` best. So only the terms before generate candidates, a candidate whose own part and that sum stay below the bound is dropped, and the others
get their exact score from all terms. A task raises its bounds by the scores that it has seen.

Documents are turned into rows of term counts once, for the terms of the items only. Items are taken in blocks of about ``BLOCK_TERMS`` terms, so that
what a task holds of them is bounded, however many there are; documents are taken in steps of about ``STEP`` (document, item) contributions.

Null, empty and term-free texts are no documents and, as items, get no rows. Each row is a document or an item of its own, so repeated rows are ranked
side by side; equal scores go by ascending id, null ids last. Very long texts are counted whole, by blocks of bytes. Other columns are not read.
"""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import session, table, written

K = 50
#: Terms of the items of one block, on average; contributions that a task works out at a time; bytes of a text that are cut at a time.
BLOCK_TERMS, STEP, BLOCK_BYTES = 500_000, 2_000_000, 4 << 20
#: The tasks' best documents of an item are first thinned in so many parts.
PARTS = 64
#: Bytes that belong to terms stay (A-Z in lower case), all others turn into blanks. Bytes from 0x80 on are parts of characters outside ASCII.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
FOUND = "item long, item_id long, score long, doc_id long"


def counted(text, block=BLOCK_BYTES):
    """(number of terms, Counter of the terms as bytes) of a whole text."""
    raw, n, found, at = (text or "").encode("utf-8", "replace").translate(TERM_BYTES), 0, Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + block)
        words = raw[at : end if end >= 0 else len(raw)].split()
        n, at = n + len(words), end if end >= 0 else len(raw)
        found.update(words)
    return n, found


def item_terms(items: DataFrame) -> DataFrame:
    """The written table ``(item, item_id, terms)`` of the items that have terms; ``item`` numbers the rows."""

    @F.pandas_udf("array<string>")
    def terms(text: pd.Series) -> pd.Series:
        return text.map(lambda x: [t.decode("utf-8", "replace") for t in counted(x)[1]])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), terms("text").alias("terms"))
    return written(rows.filter(F.size("terms") > 0))


def term_counts(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """The written table ``(doc_id, n, terms, tfs)`` of the documents that have terms: the number of all terms, and the counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches):
        place = shared.value
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                n, found = counted(text)
                own = found.keys() & place.keys()
                lengths.append(n)
                terms.append([place[t] for t in own])
                tfs.append([found[t] for t in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n long, terms array<int>, tfs array<long>").filter("n > 0"))


def with_lengths(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Adds ``m``, the measure of a document's length."""
    return counts.withColumn("m", F.expr(f"100 - 50 + (cast(50 * n as decimal(20, 0)) * cast({n_docs} as decimal(18, 0))) div cast({n_terms} as decimal(18, 0))"))


def term_statistics(counts: DataFrame, n_docs: int, k: int) -> DataFrame:
    """The written table ``(term, df, w, top, kth)``: documents, weight, greatest and k-th impact (0 if fewer documents hold the term).

    Documents are counted by term and impact before anything is sorted; an impact without its weight is below a million, which bounds a term's rows.
    """
    each = counts.select("m", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select(F.col("e.terms").alias("term"), F.expr("(1000000000 * e.tfs) div (1000 * e.tfs + 20 * m)").alias("x"))
    steps = each.groupBy("term", "x").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("x")))
    stats = steps.withColumn("so_far", so_far).groupBy("term").agg(F.sum("n").alias("df"), F.max("x").alias("top"), F.max(F.when(F.col("so_far") >= k, F.col("x"))).alias("kth"))
    w = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    return written(stats.select("term", "df", w.alias("w"), (w * F.col("top")).alias("top"), (w * F.coalesce("kth", F.lit(0))).alias("kth")))


class Plan:
    """A block's (item, term) pairs in order of the term, with the bounds that prune them."""

    def __init__(self, items, stats, n_terms):
        df, self.w, top, kth = (np.zeros(n_terms, np.int64) for _ in range(4))
        for a, c in ((df, "df"), (self.w, "w"), (top, "top"), (kth, "kth")):
            a[stats["term"].to_numpy()] = stats[c].to_numpy()
        item = np.repeat(np.arange(len(items)), [len(x) for x in items])
        term = np.concatenate(items).astype(np.int64)
        order = np.lexsort((term, df[term], item))  # rare terms first
        item, term = item[order], term[order]
        before = np.cumsum(top[term]) - top[term]
        ends = np.cumsum([len(x) for x in items])
        self.suffix = (before[ends - 1] + top[term[ends - 1]])[item] - before
        self.least = np.ones(len(items), np.int64)
        np.maximum.at(self.least, item, kth[term])
        order = np.argsort(term, kind="stable")
        self.item, self.term, self.suffix = item[order], term[order], self.suffix[order]
        self.start = np.searchsorted(self.term, np.arange(n_terms + 1))

    def split(self, least):
        """Pairs that generate candidates, and for each item the sum of the greatest impacts of its other terms."""
        on = self.suffix >= least[self.item]
        rest = np.zeros(len(least), np.int64)
        np.maximum.at(rest, self.item[~on], self.suffix[~on])
        return on, rest


def contributions(plan, on, doc, term, impact):
    """(doc, item, impact) of each pair of ``on`` whose term a document holds."""
    counts = np.concatenate(([0], np.cumsum(on)))
    pairs = np.flatnonzero(on)
    lo, n = counts[plan.start[term]], counts[plan.start[term + 1]] - counts[plan.start[term]]
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(doc, n), plan.item[pairs[at]], np.repeat(impact, n)


def scored(plan, least, doc, term, impact):
    """(doc, item, exact score) of all that may be among the best."""
    on, rest = plan.split(least)
    n = len(least)
    d, i, x = contributions(plan, on, doc, term, impact)
    key, of = np.unique(d * n + i, return_inverse=True)
    part = np.zeros(len(key), np.int64)
    np.add.at(part, of, x)
    stay = part + rest[key % n] >= least[key % n]
    key, part = key[stay], part[stay]
    if len(key) and not on.all():
        own = np.isin(doc, key // n)
        d, i, x = contributions(plan, ~on, doc[own], term[own], impact[own])
        at = np.minimum(np.searchsorted(key, d * n + i), len(key) - 1)
        hit = key[at] == d * n + i
        np.add.at(part, at[hit], x[hit])
    best = part >= least[key % n]
    return key[best] // n, key[best] % n, part[best]


def best_of(item, score, ids, k):
    """Places of each item's k best in the order of scores, then ids (an id that is no number last)."""
    order = np.lexsort((ids["id"], ids["none"], -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < k]


def best_documents(counts: DataFrame, plan: Plan, items: list, k: int, step: int) -> DataFrame:
    """Each task's best documents of each item, exactly scored."""
    shared = counts.sparkSession.sparkContext.broadcast((plan, np.array([x[0] for x in items], np.int64), [x[1] for x in items]))
    kind = np.dtype([("none", bool), ("id", np.int64)])

    def search(batches):
        plan, keys, item_ids = shared.value
        least = plan.least.copy()
        item, score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        for batch in batches:
            terms, tfs = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
            doc = np.repeat(np.arange(len(batch)), terms.value_lengths().to_numpy())
            term, m = terms.flatten().to_numpy().astype(np.int64), batch.column("m").to_numpy()
            impact = plan.w[term] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[doc]))
            own = np.zeros(len(batch), kind)
            own["none"], own["id"] = batch.column("doc_id").is_null().to_numpy(False), batch.column("doc_id").fill_null(0).to_numpy()
            steps = np.cumsum(plan.start[term + 1] - plan.start[term]) // step
            cuts = np.searchsorted(doc, doc[np.flatnonzero(np.diff(steps)) + 1]) if len(doc) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(doc)]):
                d, i, s = scored(plan, least, doc[lo:hi], term[lo:hi], impact[lo:hi])
                item, score, ids = np.concatenate((item, i)), np.concatenate((score, s)), np.concatenate((ids, own[d]))
                best = best_of(item, score, ids, k)
                item, score, ids = item[best], score[best], ids[best]
                full = np.flatnonzero(np.bincount(item, minlength=len(least)) == k)
                least[full] = np.maximum(least[full], score[np.searchsorted(item, full, "right") - 1])
        for lo in range(0, len(item), 10_000):
            i = item[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array([item_ids[x] for x in i], pa.int64()), pa.array(score[lo : lo + 10_000]), pa.array(ids["id"][lo : lo + 10_000], mask=ids["none"][lo : lo + 10_000])], ["item", "item_id", "score", "doc_id"])

    return counts.select("doc_id", "m", "terms", "tfs").filter(F.size("terms") > 0).mapInArrow(search, FOUND)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, step: int = STEP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each row of ``items(item_id, text)``."""
    spark = session(docs)
    queries = item_terms(items)
    n_blocks = -(-(queries.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    found = [spark.createDataFrame([], FOUND)]
    for b in range(n_blocks):
        block = queries.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).collect()  # about block_terms terms
        place = {t: i for i, t in enumerate(sorted({t for x in block for t in x.terms}))}
        if not place:
            continue
        counts = term_counts(docs, {t.encode(): i for t, i in place.items()})
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        if n_docs:
            counts = with_lengths(counts, n_docs, n_terms)
            stats = term_statistics(counts, n_docs, k).toPandas()
            plan = Plan([np.array([place[t] for t in x.terms]) for x in block], stats, len(place))
            found.append(best_documents(counts, plan, [(x.item, x.item_id) for x in block], k, step))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return rows.select("item_id", "rank", "doc_id", "score")


def op13_threshold_seeded_search(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

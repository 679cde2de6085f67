"""Repeated word windows by level-wise doubling.

Windows of a short length are hashed first. Those found in two documents survive; two survivors that overlap or touch
make a window of up to twice the length, and only such candidates are looked at on
the next level, until the wanted length is reached or no candidate survives. For 13 words the levels are 7 and 13.
On the last level a window goes if a document of smaller id has it too.

Before the last level hashes are narrow and only pick candidates: a chance agreement costs work, never a word. On the last level
the candidates' hashes are made anew from all their words, 128 bits each.

Entries (document, position, hash) travel packed: a task sends one row of byte arrays to each bucket of hashes, and a
bucket's answer is packed by groups of documents. Before that, each task settles what its own documents show: a window
that a task holds in many documents is sent once, so a passage that a third of the corpus shares loads no bucket.
The numbers of buckets and groups follow the corpus' size, which bounds the memory of each.

Null and empty texts have no words. Null ids count as one document after all others. Rows of equal id are one document
for the comparison; each row's own text is cut, so repeated rows keep the same words. Of documents that share a window the one of
smallest id keeps it. Very long texts are cut whole; a task holds the hashes of one text at least. Other columns are not read.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, small, table, written
from .textops import ODD, mixed, word_hashes, words_of

BASE = 8
#: Entries of a bucket, and words of a task's working set; they bound a Python worker's memory.
BUCKET = 1_000_000
WORKING_SET = 600_000
#: Documents with candidates are picked by a broadcast of their keys up to this many (about 16 bytes each); beyond it each text is shuffled once more.
MAX_BROADCAST_KEYS = 1_000_000
NO_ID = (1 << 63) - 1
#: Bytes of a hash that a bucket sees before the last level.
NARROW = 4
#: A second factor and start for the hashes of the last level.
ODD2, START2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
PACKED = T.StructType([T.StructField("part", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in ("ids", "keys", "counts", "pos", "hash", "more")])
STARTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("starts", T.BinaryType())])


def levels(window):
    """Window lengths, each at most twice the one before."""
    out = [window]
    while out[0] > BASE:
        out.insert(0, (out[0] + 1) // 2)
    return out


def planes(x, kind, width=None):
    """Byte planes of an array: the high bytes of small numbers compress to nothing."""
    raw = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def unplaned(raw, kind, n):
    got = np.frombuffer(raw, np.uint8).reshape(-1, n).T if n else np.zeros((0, 1), np.uint8)
    full = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    full[:, : got.shape[1]] = got
    return full.reshape(-1).view(kind)


def packed(part, ids, keys, pos, hashes, width, more=None):
    """One row for each part; entries are in order of document and position, and stay so. ``more`` is the hashes' second half, if any."""
    order = np.argsort(part, kind="stable")
    part, ids, keys, pos, hashes, more = part[order], ids[order], keys[order], pos[order], hashes[order], None if more is None else more[order]
    edges = np.flatnonzero(np.diff(part)) + 1 if len(part) else []
    for lo, hi in zip([0, *edges], [*edges, len(part)]):
        if lo == hi:
            continue
        i, k, p = ids[lo:hi], keys[lo:hi], pos[lo:hi]
        first = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (k[1:] != k[:-1]))))
        step = np.diff(p, prepend=0)
        step[first] = p[first]
        yield (
            int(part[lo]),
            planes(np.diff(i[first], prepend=0), np.int64),
            planes(k[first], np.int64),
            planes(np.diff(first, append=hi - lo), np.uint32),
            planes(step, np.uint32),
            planes(hashes[lo:hi], np.uint64, width),
            b"" if more is None else planes(more[lo:hi], np.uint64),
        )


def unpacked(pdf):
    """(ids, keys, pos, hashes, second halves) of all rows."""
    out = []
    for ids, keys, counts, pos, hashes, more in zip(*[pdf[c] for c in PACKED.names[1:]]):
        n = len(ids) // 8
        count = unplaned(counts, np.uint32, n).astype(np.int64)
        total = int(count.sum())
        step = np.cumsum(unplaned(pos, np.uint32, total).astype(np.int64))
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        before = np.where(first > 0, step[first - 1], 0)
        own = np.repeat(np.cumsum(unplaned(ids, np.int64, n)), count), np.repeat(unplaned(keys, np.int64, n), count), step - np.repeat(before, count)
        out.append((*own, unplaned(hashes, np.uint64, total), unplaned(more, np.uint64, total)))
    return [np.concatenate(x) for x in zip(*out)]


def settled(ids, hashes, more, last):
    """(hit, send): what these entries alone decide, and what others must see.

    Before the last level a hash is hit if two documents have it; one entry stands for it elsewhere. On the last
    level an entry is hit if a smaller id has its hash, both halves; the others must be compared elsewhere.
    """
    order = np.lexsort((more, hashes)) if last else np.argsort(hashes, kind="stable")
    h, m = hashes[order], more[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (m[1:] != m[:-1]))))
    group = np.repeat(np.arange(len(first)), np.diff(first, append=len(h)))
    own = ids[order]
    low = np.minimum.reduceat(own, first)
    hit, send = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if last:
        hit[order] = own > low[group]
        return hit, ~hit
    hit[order] = (low < np.maximum.reduceat(own, first))[group]
    send[order[first]] = True
    return hit, send | ~hit


class Level:
    """How the entries of one level travel: the last one's with full hashes; answers carry hashes only for a further level that is made from them."""

    def __init__(self, lengths, k, n_parts, narrow):
        self.length, self.last, self.n_parts, self.narrow = lengths[k], k == len(lengths) - 1, n_parts, narrow
        self.carried = 0 if k >= len(lengths) - 2 else 6 if n_parts <= 1 << 16 else 8

    def bucket(self, hashes):
        return ((hashes >> np.uint64(40)) % np.uint64(self.n_parts)).astype(np.int32)

    def seen(self, hashes, bucket):
        """What a bucket can tell of hashes of which it sees the low bytes."""
        return (hashes & np.uint64((1 << 8 * self.narrow) - 1)) | bucket.astype(np.uint64) << np.uint64(32)

    def mail(self, ids, keys, pos, hashes, more):
        """Packed rows of a working set: requests to buckets (parts from 0 on), and answers it has itself (parts below 0)."""
        if not len(ids):
            return
        hit, send = settled(ids, hashes, more, self.last)
        bucket = self.bucket(hashes)
        yield from packed(bucket[send], ids[send], keys[send], pos[send], hashes[send], 8 if self.last else self.narrow, more[send] if self.last else None)
        yield from self.answers(ids[hit], keys[hit], pos[hit], self.seen(hashes[hit], bucket[hit]))

    def answers(self, ids, keys, pos, hashes):
        """Rows to groups of documents, numbered from -1 downwards."""
        group = (mixed(ids.view(np.uint64) ^ keys.view(np.uint64)) % np.uint64(self.n_parts)).astype(np.int32)
        return packed(-1 - group, ids, keys, pos, hashes, self.carried)

    def settle(self, pdf):
        """A bucket's answers; what tasks had found themselves passes."""
        if pdf["part"].iloc[0] < 0:
            return pdf
        ids, keys, pos, hashes, more = unpacked(pdf)
        hit, _ = settled(ids, hashes, more, self.last)
        at = np.flatnonzero(hit)
        at = at[np.lexsort((pos[at], keys[at], ids[at]))]
        return frame(self.answers(ids[at], keys[at], pos[at], self.seen(hashes[at], np.full(len(at), pdf["part"].iloc[0]))))


def frame(rows):
    return pd.DataFrame(rows, columns=PACKED.names)


def from_words(rows: DataFrame, level: Level) -> DataFrame:
    """Packed requests and answers for the windows of ``rows(id, key, text)``: all, or those that begin at ``starts``."""
    some = "starts" in rows.columns

    def windows(ids, keys, starts, words, counts):
        h, owner = np.concatenate(words), np.repeat(np.arange(len(counts)), counts)
        start = np.cumsum(counts) - counts
        n = len(h) - level.length + 1
        if n < 1:
            return frame([])
        inside = owner[:n] == owner[level.length - 1 :]
        if some:
            asked = np.zeros(len(h), bool)
            for s, c, x in zip(start, counts, starts):
                at = positions(x)
                asked[s + at[at < c]] = True
            inside &= asked[:n]
        at = np.flatnonzero(inside)
        code, more = np.zeros(len(at), np.uint64), np.full(len(at), START2 * level.last)
        for k in range(level.length):
            code = code * ODD + h[at + k]
            if level.last:
                more = mixed(more + h[at + k]) * ODD2
        own = owner[at]
        return frame(level.mail(ids[own], keys[own], at - start[own], mixed(code), more))

    def send(batches):
        held, size = [], 0
        for batch in batches:
            batch = batch.iloc[np.lexsort((batch["key"].to_numpy(), batch["id"].to_numpy()))]
            h, counts = word_hashes([(x or "").encode("utf-8", "replace") for x in batch["text"]])
            held.append((batch["id"].to_numpy(), batch["key"].to_numpy(), batch["starts"].to_numpy() if some else counts, h, counts))
            size += len(h)
            if size >= WORKING_SET:
                yield windows(*[np.concatenate(x) if k != 3 else x for k, x in enumerate(zip(*held))])
                held, size = [], 0
        if held:
            yield windows(*[np.concatenate(x) if k != 3 else x for k, x in enumerate(zip(*held))])

    return rows.mapInPandas(send, PACKED).groupBy("part").applyInPandas(lambda pdf: level.settle(pdf), PACKED)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``id`` (nulls last) and ``key``, the text's hash, which part rows of equal id."""
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "key": F.xxhash64("text")})


def by_document(pdf):
    """(ids, keys, pos, hashes) in order of document and position, each once, and a number for each document."""
    ids, keys, pos, hashes, _ = unpacked(pdf)
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos, hashes = ids[order], keys[order], pos[order], hashes[order]
    other = np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
    once = other | np.concatenate(([True], pos[1:] != pos[:-1]))
    return ids[once], keys[once], pos[once], hashes[once], np.cumsum(other)[once]


def pairs(pos, doc, step):
    """Places of the entries that have another ``step`` words later, and the places of those."""
    at = doc * (int(pos.max()) + step + 1) + pos
    other = np.minimum(np.searchsorted(at, at + step), len(at) - 1)
    both = np.flatnonzero(at[other] == at + step)
    return both, other[both]


def doubled(survivors: DataFrame, step: int, level: Level) -> DataFrame:
    """Packed requests and answers for the windows of which both halves survived, ``step`` words apart, made from the halves' hashes."""

    def extend(pdf):
        ids, keys, pos, hashes, doc = by_document(pdf)
        both, other = pairs(pos, doc, step)
        code = mixed(hashes[both] * ODD + mixed(hashes[other]))
        return frame(level.mail(ids[both], keys[both], pos[both], code, np.zeros(len(both), np.uint64)))

    return survivors.groupBy("part").applyInPandas(extend, PACKED).groupBy("part").applyInPandas(lambda pdf: level.settle(pdf), PACKED)


def starts_of(found: DataFrame, step: int = 0) -> DataFrame:
    """The written table ``(id, key, starts)`` of the entries that have another ``step`` words later."""

    def gather(pdf):
        ids, keys, pos, _, doc = by_document(pdf)
        if step:
            at, _ = pairs(pos, doc, step)
            ids, keys, pos, doc = ids[at], keys[at], pos[at], doc[at]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        return pd.DataFrame({"id": ids[first], "key": keys[first], "starts": [planes(x, np.uint32) for x in np.split(pos, first[1:])][: len(first)]})

    return written(found.groupBy("part").applyInPandas(gather, STARTS))


def positions(starts):
    return unplaned(starts, np.uint32, len(starts) // 4).astype(np.int64)


def joined(docs: DataFrame, starts: DataFrame, how: str) -> DataFrame:
    starts = starts.withColumnsRenamed({"id": "_id", "key": "_key"})
    return docs.join(starts, (docs.id == F.col("_id")) & (docs.key == F.col("_key")), how)


def repeated_windows(docs: DataFrame, window: int = 13, narrow: int = NARROW) -> DataFrame:
    """``(id, key, starts)`` of the documents that have windows which a document of smaller id has too."""
    session(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lengths, rows = levels(window), keyed(docs).select("id", "key", "text")
    level = [Level(lengths, k, max(1, min(1 << 20, size // (6 * BUCKET) + 1)), narrow) for k in range(len(lengths))]
    found = from_words(rows, level[0])
    for k in range(1, len(lengths) - 1):
        found = doubled(found, lengths[k] - lengths[k - 1], level[k])
    if len(lengths) > 1:
        candidates = starts_of(found, lengths[-1] - lengths[-2])
        ids = small(written(candidates.select(F.col("id").alias("_some"), F.col("key").alias("_of"))), MAX_BROADCAST_KEYS)
        some = rows.join(ids, (F.col("id") == F.col("_some")) & (F.col("key") == F.col("_of")), "left_semi")
        found = from_words(joined(some, candidates, "inner").select("id", "key", "text", "starts"), level[-1])
    return starts_of(found)


def kept_words(text, starts, window):
    """(words, which of them stay) of one text."""
    words = words_of(text)
    stay = np.ones(len(words), bool)
    if starts is not None:
        at = positions(starts)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        stay = np.cumsum(edge)[:-1] <= 0
    return words, stay


def with_starts(docs: DataFrame, window: int, narrow: int = NARROW) -> DataFrame:
    return joined(keyed(docs), repeated_windows(docs, window, narrow), "left")


def remove_repeats(docs: DataFrame, window: int = 13, narrow: int = NARROW) -> DataFrame:
    """``(doc_id, text)``: the kept words joined by spaces."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([b" ".join([w for w, s in zip(*kept_words(x, y, window)) if s]).decode() for x, y in zip(text, starts)])

    return with_starts(docs.select("doc_id", "text"), window, narrow).select("doc_id", cut("text", "starts").alias("text"))


def op6_window_doubling(spark, sf_dir):
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    @F.pandas_udf(kind)
    def digest(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(text, starts):
            words, stay = kept_words(x, y, 13)
            rows.append((len(words), int((~stay).sum()), hashlib.sha256(b" ".join([w for w, s in zip(words, stay.tolist()) if s])).hexdigest()))
        return pd.DataFrame(rows, columns=kind.names)

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_starts(docs, 13).select("doc_id", digest("text", "starts").alias("d")).select("doc_id", "d.*")

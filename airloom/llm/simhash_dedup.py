"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two bits; the embedding is the vector of the segments' bit
counts. The Manhattan distance of two such vectors never exceeds the fingerprints' Hamming distance.
The vector is kept in unary (each segment's bits sorted), so Manhattan distance is a bit count of an XOR.
Grid: the 32 axes form eight blocks or more. If the distance is at most four, all blocks but four agree exactly, so
fingerprints are put in the cells of all choices of that many blocks (70 of four of eight), and only those that share a cell meet. A pair
is taken in the first choice in which it meets, if the lower bound and then the exact distance hold. The number of blocks follows from the
count of distinct fingerprints: more blocks mean more cells for each, of which each holds fewer by chance. Links don't depend on it.

Exact copies are one vertex, so a group of copies costs one fingerprint. Null and empty texts have the zero
fingerprint and are linked like any other. Null ids get their group's component and never are its smallest id, unless all are null.
Very long texts are read whole, 65,536 shingles at a time. Repeated rows get equal fingerprints and components. A bit that just half of
the shingles have is zero. Other columns are not read.

Two-bit segments are the coarsest that serve: the counts of four blocks of them carry about 24 bits, so a cell holds few fingerprints
by chance; wider segments lose most of that, and a cell's pairs grow with the square of its fingerprints.
"""

from itertools import combinations
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, table, written
from .components import components
from .near_dedup import near_unique  # noqa: F401
from .textops import simhash

BITS = 4
#: Numbers of blocks to choose from.
BLOCKS = (8, 10, 12)
#: Bits by which one segment parts uniform fingerprints: two counts agree with a chance of 3/8.
SEGMENT_BITS = log2(8 / 3)
#: A row that is shuffled costs about as much as so many pairs that meet.
ROW = 16
LOW = 0x5555555555555555


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks(n: int) -> list[int]:
    """The blocks as masks over the embedding: whole segments, as even as they come."""
    ends = [2 * (32 * k // n) for k in range(n + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(ends, ends[1:])]


def choices(n: int) -> list[int]:
    """The blocks that must agree, as masks."""
    return [sum(own) for own in combinations(blocks(n), n - BITS)]


def blocks_for(count: int) -> int:
    """The number of blocks that costs the least for so many distinct fingerprints."""

    def cost(n):
        return sum(ROW + count / 2 * 2 ** (-SEGMENT_BITS * m.bit_count() / 2) for m in choices(n))

    return min(BLOCKS, key=cost)


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series([signed(simhash(x)) for x in text], dtype="int64")


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary: the low bit says one or more, the high bit says two."""
    half = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(half).bitwiseAND(F.lit(LOW))
    full = fp.bitwiseAND(half).bitwiseAND(F.lit(LOW))
    return some.bitwiseOR(F.shiftleft(full, 1))


def first_cell(x: Column, n: int) -> Column:
    """The first choice of blocks, as a mask, in which two embeddings agree; x is their XOR."""
    mask, before = F.lit(0).cast("long"), F.lit(0)
    for block in map(signed, blocks(n)):
        equal = x.bitwiseAND(F.lit(block)) == 0
        mask = mask.bitwiseOR(F.when(equal & (before < n - BITS), F.lit(block)).otherwise(F.lit(0).cast("long")))
        before = before + equal.cast("int")
    return mask


def links(fps: DataFrame, n: int | None = None) -> DataFrame:
    """``(a, b)`` for each pair of distinct fingerprints at ``BITS`` or fewer differing bits; ``fps`` has one row each. ``n`` blocks, by default as their count asks.

    Cells are merged, never broadcast: Spark takes the exploded table to be as small as the fingerprints' file."""
    n = n or blocks_for(fps.count())
    cells = fps.select("fp", embedding(F.col("fp")).alias("e"), F.explode(F.array(*[F.lit(signed(m)) for m in choices(n)])).alias("mask"))
    cells = cells.select("fp", "mask", F.col("e").bitwiseAND(F.col("mask")).alias("cell"))
    a, b = cells.alias("a"), cells.alias("b")
    x = embedding(F.col("a.fp")).bitwiseXOR(embedding(F.col("b.fp")))
    meet = (
        (F.col("a.mask") == F.col("b.mask"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(x) <= BITS)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= BITS)
        & (first_cell(x, n) == F.col("a.mask"))
    )
    return a.join(b.hint("merge"), meet).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def grouped(rows: DataFrame) -> DataFrame:
    """Adds ``component_id`` to rows that have ``doc_id`` and ``fp``; the rows must be a written table."""
    firsts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(written(links(firsts.select("fp"))))
    to = written(firsts.join(roots, firsts.fp == roots.v, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    ids = to.groupBy("root").agg(F.min("first").alias("component_id"))
    of = written(to.join(ids, "root").select("fp", "component_id"))
    return rows.join(of, "fp")


def op8_simhash_popcount(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = written(docs.select("doc_id", fingerprint("text").alias("fp")))
    return grouped(rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

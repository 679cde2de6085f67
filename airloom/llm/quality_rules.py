"""Quality rules with host-level verdicts.

Every text is measured in one pass; a document fails the base rule (too short or too repetitive) or one
of the soft rules (symbols, repeated lines). Failures are counted by host and each host's rate is shrunk to
the corpus by a beta prior fitted to all hosts (method of moments, hosts weighed by their documents). A host is
rejected if its rate is above the corpus rate by ``margin`` at least, but for a chance of about one in twenty by its beta
posterior; it then loses its documents. The verdicts are joined back to the documents.

Null or empty texts have no words and so fail the base rule; very long texts are measured whole. Documents without a host form
one host of their own. Repeated rows are judged row by row. Columns other than the id, text and host are not read, whatever
their names. With one host alone the corpus rate is its own, so it stays.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, table, written
from .textops import BLANKS, repeated_cover

SYMBOLS = "#*$%&|<>"
#: The prior weighs at least and at most so many documents: a host of a few documents is never rejected for them alone,
#: and hosts of equal rates don't freeze the verdict on one that differs.
LEAST_STRENGTH, MOST_STRENGTH = 10.0, 1000.0
#: How far above the corpus rate a host's rate must lie to be rejected.
MARGIN = 0.15
#: Standard deviations of the posterior between the shrunk rate and the bound that is compared: one in twenty.
SURE = 1.645
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def measure(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        len(lines),
        repeated_cover(words, 3),
    )


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in MEASURES]))
def measured(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in text], columns=MEASURES)


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def rule_failed(m: str = "m", max_symbols: float = 0.2, max_dup_lines: float = 0.5) -> Column:
    """Any rule: the base rule, symbols per word, or the share of repeated lines."""
    return (
        base_failed(m)
        | (F.col(f"{m}.n_symbols") > max_symbols * F.col(f"{m}.n_words"))
        | (F.col(f"{m}.n_dup_lines") > max_dup_lines * F.col(f"{m}.n_lines"))
    )


def host_verdicts(failures: DataFrame, host: str = "source", margin: float = MARGIN) -> DataFrame:
    """``(host, n_docs, n_failed, shrunk_rate, least_rate, host_rejected)`` from one boolean ``failed`` per document.

    The beta prior's mean is the corpus rate; its strength comes from the spread of the hosts' rates beyond
    what chance gives. Hosts of equal rates get a strong prior, very different hosts a weak one.
    """
    hosts = written(
        failures.groupBy(F.col(host).alias("host")).agg(
            F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")
        )
    )
    n = F.col("n_docs").cast("double")
    total, failed, n_hosts, squares = hosts.agg(F.sum(n), F.sum("n_failed"), F.count(F.lit(1)), F.sum(n * n)).first()
    mean = failed / total if total else 0.0
    spread = hosts.agg(F.sum(n * (F.col("n_failed") / n - mean) ** 2)).first()[0] or 0.0
    chance = mean * (1 - mean)
    beyond = (spread - chance * (n_hosts - 1)) / (total - squares / total) if n_hosts > 1 and total > n_hosts else 0.0
    strength = min(max(chance / beyond - 1, LEAST_STRENGTH), MOST_STRENGTH) if beyond > 0 else MOST_STRENGTH
    shrunk = (F.col("n_failed") + mean * strength) / (n + strength)
    least = F.col("shrunk_rate") - SURE * F.sqrt(F.col("shrunk_rate") * (1 - F.col("shrunk_rate")) / (n + strength + 1))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("least_rate", least).withColumn("host_rejected", F.col("least_rate") > mean + margin)


def judge(measures: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Adds ``kept``: the base rule holds and the document's host is not rejected."""
    verdict = hosts.select(F.col("host").alias("_host"), "host_rejected", "shrunk_rate", "least_rate")
    return measures.join(verdict, F.col(host).eqNullSafe(F.col("_host")), "left").withColumn(
        "kept", ~base_failed() & ~F.coalesce("host_rejected", F.lit(False))
    )


def quality_filter(docs: DataFrame, host: str = "source", margin: float = MARGIN) -> DataFrame:
    """The documents that pass, with their own columns. Texts are measured once; the documents wait for the verdicts in a written table."""
    session(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(host).alias("_of"), measured("text").alias("m"))
    rows = written(rows.select("d", "_of", "m", rule_failed().alias("failed")))
    hosts = host_verdicts(rows.select("_of", "failed"), "_of", margin)
    return judge(rows, written(hosts), "_of").filter("kept").select(*[F.col(f"d.`{c}`") for c in docs.columns])


def op7_quality_host_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = written(docs.select("doc_id", "source", measured("text").alias("m")))
    hosts = written(host_verdicts(rows.select("source", rule_failed().alias("failed"))))
    return judge(rows, hosts).select(
        "doc_id",
        *[f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"),
        "kept",
        F.round("shrunk_rate", 6).alias("shrunk_rate"),
        F.round("least_rate", 6).alias("least_rate"),
    )

"""URL filtering by fixed host rules and mined association rules.

A URL becomes a set of tokens: its host's labels, the words of labels with hyphens, its
path's segments (numbers as one token) and its query's keys. Tokens that the same labelled URLs have are one item, named by the smallest: a
family of URLs that share many keys is a few items, not a power set. FP-growth finds the combinations of items that are frequent among
URLs labelled bad; their support among all labelled URLs gives confidence. Rules below ``min_confidence`` or
``min_support`` go, and so do those of which a part is itself a rule. Rules are indexed by their rarest token: each URL
meets, by its tokens, only the rules of that token, and then all of a rule's tokens are checked.

A page is blocked if a mined rule matches its URL, unless a fixed rule fits; the longest fixed rule wins.
Null and empty URLs, and those without ``://``, have no tokens, fit no rule and are allowed. Each row is judged, repeated rows alike.
Very long URLs are read whole. With fewer than ``min_support`` bad URLs, or none labelled, nothing is mined. Other columns are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session, small, table, written

#: The host rules.
HOST_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
#: Longer path segments and query keys are tokens by a hash of all of them.
MAX_TOKEN = 64
#: Rules are broadcast up to this many; beyond it the join shuffles.
MAX_BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules, what: int) -> Column:
    """The longest fitting rule (``what`` 1) or its verdict (0); null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        of, _, rest = rule[1].partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule[what])).otherwise(out)
    return out


def bounded(kind: str, text: Column) -> Column:
    """A token of a path segment or query key: the text itself, or a hash if it is long."""
    return F.when(F.length(text) > MAX_TOKEN, F.concat(F.lit(kind + "#:"), F.hex(F.xxhash64(text)))).otherwise(F.concat(F.lit(kind + ":"), text))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.transform(F.split(x, "-"), lambda w: F.concat(F.lit("w:"), w))))
    segments = F.transform(F.split(path, "/"), lambda x: bounded("p", F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(
        F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: bounded("q", F.substring_index(x, "=", 1))
    )
    named = F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), words, segments, keys)
    return F.array_distinct(F.filter(named, lambda x: F.length(x) > 2))


def matches(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``(key, rule)`` for each URL (``key``, ``tokens``) and rule (``rule``: its tokens) that matches; through the rules' rarest tokens."""
    often = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    each = rules.select("rule", F.explode("rule").alias("token")).join(often, "token")
    index = written(each.groupBy("rule").agg(F.min(F.struct("often", "token")).alias("rare"), F.count(F.lit(1)).alias("n")).filter(F.size("rule") == F.col("n")).select("rule", F.col("rare.token").alias("token")))
    return (
        urls.select(key, "tokens", F.explode("tokens").alias("token"))
        .join(small(index, MAX_BROADCAST_RULES), "token")
        .filter(F.size(F.array_except("rule", "tokens")) == 0)
        .select(key, "rule")
    )


def items_of(rows: DataFrame, min_support: int) -> DataFrame:
    """The written table ``(token, item)`` of the tokens that ``min_support`` bad rows have; tokens of the same ``rows(row, tokens, bad)`` are one item.

    Sets of rows are told apart by their size and 128 bits. An item has no more tokens than a URL."""
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count_if("bad").alias("n_bad"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    same = seen.filter(F.col("n_bad") >= min_support).groupBy("n", "x", "y").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return written(same.select(F.explode("tokens").alias("token"), "item"))


def as_items(rows: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """``(key, tokens, counts)`` of ``rows(key, tokens)`` that have any item: the items, and how many tokens of each they have."""
    each = rows.select(key, F.explode("tokens").alias("token")).join(small(items, MAX_BROADCAST_RULES), "token")
    held = each.groupBy(key, "item").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("counts"))
    return held.select(key, F.map_keys("counts").alias("tokens"), "counts")


def mined_items(rows: DataFrame, items: DataFrame, min_support: int, min_confidence: float) -> DataFrame:
    """``(rule, support, confidence)``, the rules being sets of items; minimal ones only."""
    from pyspark.ml.fpm import FPGrowth

    spark = session(rows)
    held = written(as_items(rows, items, "row").join(rows.select("row", "bad"), "row").drop("counts"))
    bad = held.filter("bad")
    n_bad = bad.count()
    if n_bad < min_support:
        return spark.createDataFrame([], "rule array<string>, support long, confidence double")
    model = FPGrowth(itemsCol="tokens", minSupport=(min_support - 0.5) / n_bad, minConfidence=0.0).fit(bad.select("tokens"))
    sets = written(model.freqItemsets.select(F.array_sort("items").alias("rule"), F.col("freq").alias("support")))
    total = matches(held.select("row", "tokens"), sets.select("rule"), "row").groupBy("rule").agg(F.count(F.lit(1)).alias("total"))
    sure = written(sets.join(total, "rule").withColumn("confidence", F.col("support") / F.col("total")).filter(F.col("confidence") >= min_confidence).drop("total"))
    parts = F.filter(
        F.concat(F.transform("rule", lambda x: F.array(x)), F.transform("rule", lambda x: F.array_except("rule", F.array(x)))),
        lambda p: (F.size(p) > 0) & (F.size(p) < F.size("rule")),
    )
    longer = sure.select("rule", F.explode(parts).alias("part")).join(sure.select(F.col("rule").alias("part")), "part", "left_semi").select("rule").distinct()
    return sure.join(longer, "rule", "left_anti")


def numbered(labelled: DataFrame) -> DataFrame:
    return written(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"))


def mined(labelled: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(rule, support, confidence)`` from ``labelled(tokens, bad)``, each rule in its tokens; minimal rules only. A rule of items is one rule for
    each choice of a token of each."""
    rows = numbered(labelled)
    items = items_of(rows, min_support)
    found = mined_items(rows, items, min_support, min_confidence)
    tokens = items.groupBy("item").agg(F.collect_list("token").alias("any"))
    each = found.select(F.monotonically_increasing_id().alias("of"), "*").select("*", F.explode("rule").alias("item")).join(tokens, "item")
    each = each.groupBy("of", "support", "confidence").agg(F.collect_list("any").alias("any"))
    grown = F.aggregate("any", F.array(F.array().cast("array<string>")), lambda made, x: F.flatten(F.transform(made, lambda m: F.transform(x, lambda t: F.array_append(m, t)))))
    return each.select(F.explode(grown).alias("rule"), "support", "confidence").select(F.array_sort("rule").alias("rule"), "support", "confidence")


def judged(pages: DataFrame, labelled: DataFrame, rules=HOST_RULES) -> DataFrame:
    """``pages`` (``page_id``, ``url``) with host, path, rule, verdict and the number of mined rules that match."""
    urls = written(pages.select("url").filter("url is not null").distinct().withColumn("tokens", tokens(F.col("url"))))
    rows = numbered(labelled)
    items = items_of(rows, MIN_SUPPORT)
    found = written(mined_items(rows, items, MIN_SUPPORT, MIN_CONFIDENCE))
    held = written(as_items(urls, items, "url"))
    choices = F.aggregate("rule", F.lit(1).cast("long"), lambda n, x: n * F.element_at("counts", x))
    hit = matches(held, found.select("rule"), "url").join(held.select("url", "counts"), "url")
    hit = written(hit.groupBy("url").agg(F.sum(choices).alias("n_mined")))
    rows = pages.join(hit.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left")
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("n_mined", F.lit(0)).alias("n_mined"))
    host, path = F.col("host"), F.col("path")
    method = F.when(F.col("n_mined") > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", fitting(host, path, rules, 1).alias("rule"), F.coalesce(fitting(host, path, rules, 0), method).alias("verdict"), "n_mined")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(tokens, bad)``: pages with a label of their id; bad if low quality or toxic."""
    rows = pages.select("page_id", "url").join(labels.select("doc_id", "quality", "toxic"), F.col("page_id") == F.col("doc_id"))
    t = tokens(F.col("url"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return rows.select(t.alias("tokens"), bad.alias("bad")).filter(F.size("tokens") > 0)


def op2_association_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, labelled_urls(pages, table(spark, sf_dir, "labels")))

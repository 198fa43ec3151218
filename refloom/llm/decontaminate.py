"""Benchmark decontamination: a broadcast hash set of test n-grams, and every window of the training words looked up.

DataFrame functions only; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

WINDOW = 13
#: A document is contaminated where its hit words are at least this share (1 in SHARE) of its words.
SHARE = 20
#: What separates words in lower-cased text, as a character class.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The set of windows is broadcast up to this many rows (about 30 MB); a larger one is joined by shuffling.
BROADCAST_ROWS = 300_000
#: A hash that every document's list ends with, so that documents without hits come through the join as well.
END = -7046029254386353131


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; null and wordless texts have none."""
    parts = F.split(F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, " ")), " ")
    return F.when(parts[0] == "", F.array().cast("array<string>")).otherwise(parts)


def window_hashes(w: Column, n: int) -> Column:
    """Hash of every n consecutive words, in order."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, n)))


def _placed(hashes: Column, width: int) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), (i + 1).alias("start"), F.lit(width).alias("width")))


def windows_of(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """item_id, width, hash, gram (the words): the distinct windows of the items; a shorter item is one window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    width = F.least(F.lit(n), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - width + 1)
    w = items.select("item_id", width.alias("width"), F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("gram"))
    return w.distinct().withColumn("hash", F.xxhash64("gram"))


def hits(docs: DataFrame, benchmark: DataFrame, key: str, text: str, n: int = WINDOW) -> DataFrame:
    """For every row of docs, known by its unique key: n_words, spans (array of struct(start, width), by start),
    items (sorted ids as strings) of the benchmark windows that occur in it.

    Window hashes are looked up in the set, and a hit is verified word by word against the window itself.  A set of
    up to BROADCAST_ROWS windows is broadcast, and each document is read once; only hits and one row per document are
    shuffled.  Of a larger set, (key, place, hash) of every window are shuffled, without the words, and the documents with
    hits are joined to them afterwards.  Long documents and passages that many documents share give as many rows as they have
    hits, never pairs of documents; a window that very many documents have is split by Spark's skew join.
    """
    grams = windows_of(benchmark, n)
    widths = sorted(r[0] for r in grams.select("width").distinct().collect())  # at most n numbers
    grams = grams.groupBy("hash", "width", "gram").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    small = grams.count() <= BROADCAST_ROWS
    d = docs.select(F.col(key).alias("_key"), words(F.col(text)).alias("w")).withColumn("n_words", F.size("w"))
    lists = [_placed(window_hashes(F.col("w"), k), k) for k in widths]
    end = F.array(F.struct(F.lit(END).alias("hash"), F.lit(0).alias("start"), F.lit(0).alias("width")))
    verified = F.slice("w", F.greatest("start", F.lit(1)), F.col("width")) == F.col("gram")
    span = F.when(F.col("width") > 0, F.struct("start", "width")).alias("span")
    if small or not widths:
        none = docs.sparkSession.range(1).select(F.lit(END).alias("hash"), F.lit(0).alias("width"), F.array().cast("array<string>").alias("gram"), F.array().cast("array<string>").alias("items"))
        placed = d.select("_key", "w", "n_words", F.explode(F.concat(*lists, end)).alias("x")).select("_key", "w", "n_words", "x.*")
        found = placed.join(F.broadcast(grams.union(none) if widths else none), ["hash", "width"]).filter((F.col("width") == 0) | verified)
        found = found.select("_key", "n_words", span, "items")
    else:
        placed = d.select("_key", F.explode(F.concat(*lists)).alias("x")).select("_key", "x.*")
        found = placed.join(grams, ["hash", "width"]).join(d.select("_key", "w"), "_key").filter(verified)
        empty = F.lit(None).cast("array<string>")
        found = found.select("_key", F.lit(0).alias("n_words"), span, "items").union(d.select("_key", "n_words", F.lit(None).cast("struct<start:int,width:int>"), empty))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return found.groupBy("_key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), items.alias("items"))


def covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by start."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["width"] - F.greatest(s["start"], a["end"]))).cast("long").alias("n"), F.greatest(a["end"], s["start"] + s["width"]).cast("int").alias("end")
    )
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end")), step, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str, text: str = "text", n: int = WINDOW, share: int = SHARE) -> DataFrame:
    """key, n_words, n_hit, items, contaminated for every row of docs; key must be unique.

    Null texts have no words and no hits; an item that is null or has no words has no window; an item without an id
    marks words but is not listed; repeated items count once; an empty benchmark gives no hits.
    """
    h = hits(docs, benchmark, key, text, n).withColumn("n_hit", covered(F.col("spans")))
    return h.select(F.col("_key").alias(key), F.col("n_words").cast("long").alias("n_words"), "n_hit", "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows are keyed by their place in the scan, so that repeated or null ids stay apart; ids of one scan are used once
    docs = table(spark, sf_dir, "documents").select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("_row"), "text")
    d = decontaminate(docs, table(spark, sf_dir, "benchmark"), "_row")
    ids = F.sha2(F.array_join("items", ","), 256)
    return d.select("_row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")

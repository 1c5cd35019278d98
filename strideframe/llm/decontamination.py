"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Each benchmark item gives windows of consecutive words. A window counts as contained only when all of
its words stand in a row, so its necessary prefix is one token: the rarest of its words by their
counts in the documents. Documents are joined on that token alone: their words pass a bitmap of the
prefix tokens, of fixed size, and those that remain meet the windows with no more than the words around
them. A candidate must leave room for the words before and after it (position and length bounds), and then
all words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged

WINDOW_WORDS = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the bitmap of prefix tokens: half a megabyte whatever the tables hold.
BITMAP_BITS = 1 << 22
KEY = ["doc_id", "text_key"]


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, letters and everything beyond ASCII, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """Distinct windows: item_id, window_id, words. An item of fewer words, but not none, is one window."""
    words = items.select(items["item_id"], words_of(F.coalesce(items["text"], F.lit(""))).alias("all_words")).filter("size(all_words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all_words") - n + 1, F.lit(1)))
    return words.select("item_id", "all_words", F.explode(starts).alias("at")).select(
        "item_id", F.slice("all_words", F.col("at"), F.least(F.size("all_words"), F.lit(n))).alias("words")
    ).withColumn("window_id", F.sha2(F.concat_ws(" ", "words"), 256))


def prefix_tokens(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """The rarest word of each window and its offset: window_id, words, n_words, token, offset. Words are counted
    within the tasks before they move."""
    each = windows.select("window_id", "words", F.posexplode("words").alias("offset", "word")).withColumn("token", F.xxhash64("word"))
    counts = texts.select(F.explode("doc_words").alias("word")).select(F.xxhash64("word").alias("token")).groupBy("token").count()
    met = counts.join(each.select("token").distinct(), "token")
    return each.join(met, "token", "left").groupBy("window_id").agg(
        F.first("words").alias("words"), F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"),
    ).select("window_id", "words", F.size("words").alias("n_words"), "rarest.token", "rarest.offset")


def _bitmap(prefixes: DataFrame, bits: int) -> DataFrame:
    """One row: the bitmap of the tokens as an array of longs."""
    at = F.pmod("token", F.lit(bits))
    longs = prefixes.select(F.floor(at / 64).cast("long").alias("id"), F.expr(f"shiftleft(1L, cast(pmod(token, {bits}) % 64 as int))").alias("bit"))
    longs = longs.groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = prefixes.sparkSession.range(bits // 64).join(longs, "id", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("bitmap"))


def occurrences(texts: DataFrame, prefixes: DataFrame, n: int, bits: int) -> DataFrame:
    """Verified occurrences of windows in documents: doc_id, text_key, window_id, start, n_words."""
    spot = F.pmod("token", F.lit(bits))
    word = F.get(_bitmap(prefixes, bits).scalar(), F.floor(spot / 64).cast("int"))
    exploded = texts.select(*KEY, "doc_words", F.posexplode("doc_words").alias("pos", "word")).withColumn("token", F.xxhash64("word"))
    low = F.greatest(F.col("pos") - n + 1, F.lit(0))
    near = exploded.filter(F.getbit(word, (spot % 64).cast("int")) == 1).select(
        *KEY, "token", "pos", low.alias("low"), F.slice("doc_words", low + 1, F.lit(2 * n - 1)).alias("around"), F.size("doc_words").alias("size")
    )
    start = F.col("pos") - F.col("offset")
    return near.join(prefixes, "token").filter((start >= 0) & (start + F.col("n_words") <= F.col("size"))).filter(
        F.slice("around", start - F.col("low") + 1, F.col("n_words")) == F.col("words")
    ).select(*KEY, "window_id", start.alias("start"), "n_words")


def judged(docs: DataFrame, items: DataFrame, n: int = WINDOW_WORDS, bits: int = BITMAP_BITS) -> DataFrame:
    """What ``contamination`` returns, with ``text_key``, a hash of each row's text."""
    text = F.coalesce(docs["text"], F.lit(""))
    texts = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("text_key"), words_of(text).alias("doc_words"))
    windows = staged(item_windows(items, n), "item-windows")
    prefixes = staged(prefix_tokens(texts, windows.select("window_id", "words").dropDuplicates(["window_id"])), "prefix-tokens")
    found = staged(occurrences(texts, prefixes, n, bits).distinct(), "window-occurrences")
    before = Window.partitionBy(*KEY).orderBy("start", "n_words", "window_id").rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.col("start") + F.col("n_words")).over(before)
    fresh = F.col("start") + F.col("n_words") - F.greatest(F.col("start"), F.coalesce(until, F.lit(0)))
    hits = found.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy(*KEY).agg(F.sum("fresh").alias("n_hit"))
    owners = windows.select("window_id", F.col("item_id").cast("string").alias("item_id")).distinct()
    listed = found.select(*KEY, "window_id").distinct().join(owners, "window_id").groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    same = F.col("h.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("h.text_key") == F.col("l.text_key"))
    marks = hits.alias("h").join(listed.alias("l"), same, "left").select("h.doc_id", "h.text_key", "n_hit", "items")
    marks = staged(marks, "contaminated")
    discard(windows, prefixes, found)
    counted = texts.select(*KEY, F.size("doc_words").cast("long").alias("n_words")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_key") == F.col("m.text_key"))
    n_words, n_hit = F.col("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.join(marks.alias("m"), same, "left").select(
        "d.doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= n_words)).alias("contaminated"), "d.text_key",
    )


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW_WORDS, bits: int = BITMAP_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words. Every row is judged by its own text, rows without an id and rows that share
    one too. Null item ids are left out of the list of items, their windows count. Empty tables: no
    documents give no rows, no items give no hits. Other columns are ignored. ``bits`` is the size of the
    bitmap, which changes the work only. The operator runs Spark jobs when it is called.
    """
    return judged(docs, items, n, bits).drop("text_key")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns. Null ids and texts, repeated
    rows, empty tables and columns of any other name are allowed."""
    bad = judged(docs, items).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (key == bad["bad_key"]), "left_anti")

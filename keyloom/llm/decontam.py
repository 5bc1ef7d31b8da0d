"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A *window* is ``size`` consecutive words of an item (a shorter item is one window). A document contains a
window only if it contains the window's prefix under any order of tokens; as containment must be whole, a
prefix of one token is enough, and the order is by rarity: the word with the fewest occurrences in the
documents stands first. So

1. words of the benchmark are counted over all documents (map-side first),
2. each distinct window keeps its rarest word and that word's place in the window,
3. document words are joined with those prefix words; length and position leave one place where the window
   could stand, and only a place inside the document goes on,
4. the words at that place are compared with the window, exactly,
5. places are gathered by document and the covered words counted.

The windows are broadcast in slices of at most ``SLICE`` rows and about ``SLICE_BYTES`` bytes of words, so the
broadcast is bounded whatever the size of the benchmark: each slice costs one pass over the documents, whose rows are
then numbered once in a staged table. Item ids are no part of it: a window has a number, and the ids of its items are
joined to the few verified places. Documents are never shuffled; what is shuffled is a row for each document with its
verified places.

Words: after lower-casing A-Z, runs of characters other than ``\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F``. Full
Unicode lower case serves as a wider key in the join; the comparison restores the exact rule.

Defined results: a null or empty text has no words and is clean; items without words or with a null id take
no part; repeated item rows count once by id; every document row gives one row, repeated or not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is no word character, with A-Z still in their own case.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SLICE = 100_000
SLICE_BYTES = 32 << 20


def _split(text: Column) -> Column:
    """Words in their own case; an empty string may stand first and last."""
    return F.split(F.coalesce(text, F.lit("")), GAPS)


def _exact(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def item_windows(benchmark: DataFrame, size: int, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows ``(win, items)``: words in exact form, and the ids of the items that hold them."""
    words = F.filter(_split(_exact(F.col(text_col).cast("string"))), lambda w: w != "")
    items = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, size))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items"))


def _word_counts(base: DataFrame, vocabulary: DataFrame, slice_rows: int) -> DataFrame:
    """Occurrences ``(w, n)`` in all documents of each word of the vocabulary that occurs at all."""
    each = base.select(F.explode_outer("_words").alias("w")).select(F.lower("w").alias("w"))
    if vocabulary.count() <= slice_rows:
        each = each.join(F.broadcast(vocabulary), "w", "left_semi")
        return each.groupBy("w").agg(F.count("*").alias("n"))
    return each.groupBy("w").agg(F.count("*").alias("n")).join(vocabulary, "w", "left_semi")


def _places(rows: DataFrame, prefix: DataFrame) -> DataFrame:
    """Verified places ``(_row, id, n_words, start, n, win)``, and a row without a place for each document."""
    ends = rows.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("joined"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("win"))
    table = F.broadcast(prefix.select("key", "at", "joined", "n", "win").unionByName(ends))
    each = rows.select("_row", "id", "n_words", "_words", F.posexplode_outer(F.concat("_words", F.array(F.lit("")))).alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    # A place before the first or after the last word holds no window: bounds come before the comparison.
    inside = (start >= 0) & (start + F.col("n") <= F.size("_words"))
    got = F.translate(F.array_join(F.slice("_words", F.greatest(start, F.lit(0)) + 1, F.col("n")), " "), UPPER, LOWER)
    same = F.col("joined").isNull() | (inside & (got == F.col("joined")))
    hit = each.join(table, (F.lower("word") == F.col("key")) & same)
    return hit.select("_row", "id", "n_words", F.when(F.col("joined").isNotNull(), start).alias("start"), "n", "win")


def contamination(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_rows: int = SLICE) -> DataFrame:
    """For each row of ``docs``: its id, ``n_words, n_hit, n_items`` and ``items`` (ids as sorted strings)."""
    stage = Stage(docs.sparkSession, "decontam")
    # numbered as it is written, and read with these numbers from then on
    windows = stage.put("windows", item_windows(benchmark, size, id_col=item_col, text_col=item_text_col).withColumn("number", F.monotonically_increasing_id()))
    n, n_bytes = windows.agg(F.count("*"), F.sum(F.length(F.array_join("win", " ")).cast("long") + 64)).first()
    slices = max(1, -(-n // slice_rows), -(-(n_bytes or 0) // SLICE_BYTES))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    if slices > 1:  # several passes must see the same numbers
        base = stage.put("docs", base.withColumn("_row", F.monotonically_increasing_id()))
    base = base.withColumn("_words", _split(F.col("_text"))).drop("_text")

    vocabulary = windows.select(F.explode("win").alias("w")).select(F.lower("w").alias("w")).distinct()
    counted = stage.put("counts", _word_counts(base, vocabulary, slice_rows))

    placed = windows.select("win", "number", F.posexplode("win").alias("at", "word")).withColumn("w", F.lower("word"))
    rarity = F.struct(F.coalesce("n", F.lit(0)), "at")
    best = placed.join(counted, "w", "left").groupBy("number").agg(F.min_by(F.struct("w", "at"), rarity).alias("p"), F.first("win").alias("win"))
    prefix = best.select(F.col("p.w").alias("key"), F.col("p.at").alias("at"), F.array_join("win", " ").alias("joined"), F.size("win").alias("n"), F.col("number").alias("win"))
    prefix = stage.put("prefix", prefix)

    lead = F.when(F.element_at("_words", 1) == "", 1).otherwise(0)
    tail = F.when((F.size("_words") > 1) & (F.element_at("_words", -1) == ""), 1).otherwise(0)
    number = F.col("_row") if slices > 1 else F.monotonically_increasing_id().alias("_row")
    rows = base.select("id", "_words", (F.size("_words") - lead - tail).cast("long").alias("n_words"), number)
    found = [_places(rows, prefix if slices == 1 else prefix.filter(F.pmod(F.xxhash64("joined"), F.lit(slices)) == k)) for k in range(slices)]
    whole = reduce(DataFrame.unionByName, found).groupBy("_row", "id", "n_words").agg(
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "n"))).alias("places"),
        F.collect_set("win").alias("wins"),
    )
    whole = stage.put("places", whole)
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["n"] - 1))))
    some = whole.filter(F.size("wins") > 0).select("_row", F.explode("wins").alias("number")).join(windows.select("number", "items"), "number")
    items = some.select("_row", F.explode("items").alias("item")).groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = whole.join(items, "_row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(F.col("id").alias(id_col), "n_words", F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")

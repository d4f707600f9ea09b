"""Benchmark decontamination as a prefix-filtered join, in DataFrame operations only.

Every window of item words (``width`` words, or all of a shorter item) is a set of positioned
tokens. A document holds the window only if it holds the window's rarest token at the same
offset, so that token alone is the join key (the prefix that exact containment needs). Rarity is
counted over all documents for the tokens of the benchmark. A document position that carries
the key is compared only if the window fits between the document's ends (the length and the
positional bound); then the words of the window are compared one by one, inside the join.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialised, small_side

WIDTH = 10
#: What separates words: ASCII without letters and digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else. Pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, window) for each distinct window of each item; an item without words has none."""
    w = items.select(F.col("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    return w.select("item_id", F.explode(starts).alias("at"), "w").select("item_id", F.slice("w", F.col("at"), F.lit(width)).alias("window")).distinct()


#: Rows and bytes of windows (or of their words) that are broadcast at most.
MOST_ROWS, MOST_BYTES = 200_000, 64 << 20


def is_small(df: DataFrame, size: Column, rows: int, most_bytes: int = MOST_BYTES) -> bool:
    """Whether ``df`` may be broadcast: by its rows and by the bytes that ``size`` adds up to."""
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return found.n <= rows and found.b <= most_bytes


def prefix_index(windows: DataFrame, docs_words: DataFrame, most: int) -> DataFrame:
    """One row per distinct window: ``wid``, its rarest token as ``key``, and the token's offset.

    Tokens tie in favour of the earlier offset.
    """
    each = materialised(windows.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    placed = each.select("wid", F.posexplode("window").alias("offset", "token"))
    vocabulary = materialised(placed.select("token").distinct(), "vocabulary")
    hint = F.broadcast if is_small(vocabulary, F.octet_length("token") + 16, most) else lambda df: df  # counts have a row a word of the vocabulary at most
    counts = materialised(docs_words.select(F.explode("w").alias("token")).join(hint(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n")), "counts")
    ranked = placed.join(hint(counts), "token", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token")).alias("rarest"))
    return each.join(ranked, "wid").select("wid", "window", F.col("rarest.token").alias("key"), F.col("rarest.offset").alias("offset"))


def occurrences(docs: DataFrame, items: DataFrame, width: int = WIDTH, most: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(places, owners). ``places``: doc_id, text_key, n_words and, for every place where a window occurs in
    a document, at, length, wid; each document also has one row with these three null. ``owners``: wid, item_id.

    ``at`` counts words from 1; ``text_key`` (hash of the text) tells rows with one id apart. An index of
    at most ``most`` windows and MOST_BYTES is broadcast, and each text is cut into words where it
    lies. Beyond that, positions (id, place, word) meet the index's keys in a shuffle, and only for
    what they fetch do texts move, once each, to be compared word by word.
    """
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    windows = materialised(item_windows(items, width), "item_windows")
    index = materialised(prefix_index(windows, tokens, most), "index")
    owners = windows.join(index.select("window", "wid"), "window").select("wid", "item_id")
    length = F.size("window")

    def inside(start: Column) -> Column:
        return (start >= 1) & (start + length - 1 <= F.size("w")) & (F.slice("w", F.greatest(F.lit(1), start), length) == F.col("window"))

    if is_small(index, F.octet_length(F.array_join("window", " ")) + 16 * F.size("window"), most):
        spots = tokens.select("doc_id", "text_key", "w", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("pos", "token"))
        start = F.col("pos") - F.col("offset")
        met = spots.join(F.broadcast(index), (F.col("token") == F.col("key")) & inside(start), "left").where("pos = 0 OR wid IS NOT NULL")
        return met.select("doc_id", "text_key", F.size("w").alias("n_words"), start.alias("at"), length.alias("length"), "wid"), owners
    marks = tokens.select("doc_id", "text_key", F.size("w").alias("n_words"))
    none = F.lit(None)
    spots = tokens.select("doc_id", "text_key", F.posexplode("w").alias("pos", "token")).join(index.select(F.col("key").alias("token")).distinct(), "token", "left_semi")
    fetched = spots.join(index.select("wid", "key", "offset"), F.col("token") == F.col("key")).select("doc_id", "text_key", (F.col("pos") + 1 - F.col("offset")).alias("at"), "wid").where("at >= 1")
    fetched = materialised(fetched, "fetched")
    texts = tokens.join(fetched.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).distinct(), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left_semi")
    once = texts.dropDuplicates(["doc_id", "text_key"])
    held = fetched.join(once.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "w"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")))
    met = held.join(index.select(F.col("wid").alias("_wid"), "window"), F.col("wid") == F.col("_wid")).where(inside(F.col("at")))
    found = met.select("doc_id", "text_key", F.size("w").alias("n_words"), "at", length.alias("length"), "wid")
    return found.unionByName(marks.select("*", none.cast("int").alias("at"), none.cast("int").alias("length"), none.cast("bigint").alias("wid"))), owners


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, most: int = MOST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_words, n_hit, item_ids (sorted strings).

    Words are runs of a-z, 0-9 and non-ASCII characters after A-Z is lower-cased; null texts have
    none. A word is hit if it lies in an occurrence of a window. Items without words and items
    with a null id never match; repeated items count once. Repeated and null document ids keep
    their rows; other columns are ignored. Empty tables give no hits or no rows. Texts of any
    length are read whole; ties between tokens of equal rarity don't change the result.
    """
    docs = docs.select("doc_id", "text")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null")
    places, owners = occurrences(docs, items, width, most)
    places = materialised(places, "places")
    met = places.where("wid IS NOT NULL").select("doc_id", "text_key", "at", "length", "wid").distinct()
    covered = met.select("doc_id", "text_key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("pos")).distinct()
    hits = covered.groupBy("doc_id", "text_key").agg(F.count("*").alias("n_hit"))
    found = met.select("doc_id", "text_key", "wid").distinct().join(owners, "wid").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    hit = hits.join(found, hits.doc_id.eqNullSafe(found.doc_id) & (hits.text_key == found.text_key)).select(hits.doc_id.alias("_id"), hits.text_key.alias("_key"), "n_hit", "item_ids")
    base = places.where("wid IS NULL").select("doc_id", "text_key", F.col("n_words").cast("bigint").alias("n_words"))
    joined = base.join(hit, base.doc_id.eqNullSafe(hit._id) & (base.text_key == hit._key), "left")
    return joined.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without any window of an item, with all their columns.

    Null texts and ids, repeated rows and empty tables are as in ``contamination``; rows that repeat an id
    are judged by their own text. No column of ``docs`` but the two is read.
    """
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null")
    places, _ = occurrences(docs.select("doc_id", "text"), items, width)
    hit = small_side(materialised(places.where("wid IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "hit"))
    return docs.join(hit, docs.doc_id.eqNullSafe(hit._id) & (F.xxhash64(docs.text) == hit._key), "left_anti")

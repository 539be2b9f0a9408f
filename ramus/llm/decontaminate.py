"""Benchmark decontamination: prefix-filtered join of item windows with documents.

All of it is DataFrame expressions. A window (10 consecutive words of an item) must
occur whole in a text, which is a containment of 1, so one token of the window is a
sufficient prefix: its rarest. Rarity is the token's number of occurrences in all
documents; only words that items have are counted. The documents' words then
join the prefix tokens alone, most words find none, and few windows have to be
compared. The length bound (the text has room for the window) and the positional
bound (the window starts at the token's place less its place in the window) come
before the exact comparison of all the window's words.

The items' side is as large as the benchmark. It is broadcast while its size, which
is counted, is under BROADCAST_ROWS; else the same join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramus.llm.shared import Safe, once
from ramus.operators.storage import Tables

BROADCAST_ROWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(word: Column) -> Column:
    """A-Z lowered; other letters stay as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def raw_words(text: Column) -> Column:
    """Words, upper case still in them."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """words (of one window), items (the ids of those that have it)."""
    words = items.select(F.col(id_col).cast("string").alias("item"), F.transform(raw_words(F.col(text_col)), fold).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")).groupBy("words").agg(F.collect_set("item").alias("items"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: rec (struct of ``keep``, by default all the input's columns), hit (array of the
    places of hit words), items, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and blank texts, and items without words, have no windows. An item with
    fewer than ``size`` words is one window. Items with one id are one item; a null
    item id counts as the empty string. Rows are told apart by id and a hash of
    their text, so repeated rows all get their results. Empty tables of documents
    give no rows, of items no hits. Columns may have any names.
    """
    t, b = Safe(docs, keep), Safe(items)
    windows = item_windows(b.rows.select(F.coalesce(b.col(item_id).cast("string"), F.lit("")).alias("_i"), b.col(item_text).alias("_t")), "_i", "_t", size)
    store = Tables(docs.sparkSession, "decontaminate")
    windows = store.put("windows", windows)
    n_windows = windows.count()
    text, row_id = F.coalesce(t.col(text_col), F.lit("")), t.col(id_col)
    # The text travels once: in rec if it is kept, else beside it.
    base = t.rows.select(t.rec, F.xxhash64(row_id, text).alias("uid"), F.xxhash64(F.lit(1), text, row_id).alias("sum"), *([] if t.holds(text_col) else [text.alias("_text")]))
    text = F.col("rec")[t.field(text_col)] if t.holds(text_col) else F.col("_text")
    # The number of words is made below the generator, which else would copy the whole array to each of its rows.
    split = base.select("uid", "sum", raw_words(text).alias("_w")).select("uid", "sum", F.size("_w").alias("n"), "_w")
    # The outer form, as Spark gives the inner one a filter that splits every text again; words aren't null.
    tokens = split.select("uid", "sum", "n", F.posexplode_outer("_w").alias("pos", "raw")).filter("raw IS NOT NULL").select("uid", "sum", "n", "pos", fold(F.col("raw")).alias("word"))
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    # A vocabulary too large to broadcast meets the words' counts, not each of the documents' words.
    many = n_windows * size > BROADCAST_ROWS
    counts = tokens.groupBy("word").count().join(vocabulary, "word", "left_semi") if many else tokens.select("word").join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").count()
    # The rarest word of each window; ties by the word, then by its first place.
    ranked = windows.select("words", "items", F.posexplode("words").alias("at", "word")).join(counts, "word", "left")
    rarest = ranked.groupBy("words").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "at")).alias("r"), F.first("items").alias("items"))
    prefix = store.put("prefix", rarest.filter("r.count > 0").select("r.word", "r.at", "words", "items"))
    room = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.size("words") <= F.col("n"))
    near = tokens.join(_small(prefix, n_windows), "word").filter(room)
    candidate = F.struct((F.col("pos") - F.col("at")).alias("start"), "words", "items")
    near = near.groupBy("uid", "sum").agg(F.collect_list(candidate).alias("near"))
    found = base.join(near, ["uid", "sum"], "left")
    found = once(found, [*found.columns], _w=raw_words(text))
    # Only texts with candidates have their words lowered.
    found = once(found, ["rec", "near"], n_words=F.size("_w").cast("long"), _w=F.when(F.size("near") > 0, F.transform("_w", fold)))
    true = F.filter("near", lambda c: F.slice("_w", c.start + 1, F.size(c.words)) == c.words)
    true = once(found, ["rec", "n_words"], true=F.coalesce(true, F.array().cast(found.schema["near"].dataType)))
    hit = F.array_distinct(F.flatten(F.transform("true", lambda c: F.sequence(c.start, c.start + F.size(c.words) - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("true", lambda c: c["items"]))))
    out = once(true, ["rec", "n_words"], hit=hit, items=items)
    return t.out(out).select("rec", "hit", "items", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))

"""How the sources of each language differ from one another and from the language, in exact integers.

Plain relational. Regexp matches are exploded and counted by language, source and term;
the terms that enough documents of a language hold are its vocabulary; each occurring
(language, source) group meets the vocabulary, so that terms which it lacks have a count
of 0; smoothed rates in parts of 10^9 follow from the counts. Pairs of sources meet on
(language, term), once in one order, and their triangular divergences are added up;
windows rank them.

Scale: what is shuffled are counts, added up before the shuffle, and rates, dealt by
(language, term), so that a language or source with a third of all documents is spread
over all tasks. The vocabulary meets the groups in salted parts, both sides of known
counts. Rows grow with (groups x vocabulary) and (pairs of sources x vocabulary of
their language); the latter are added up before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ramus.llm.shared import Safe
from ramus.operators.storage import Tables

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that hold a term of its vocabulary; terms ranked for each group; parts in a whole.
MIN_DOCUMENTS, TOP, PARTS = 10, 10, 1_000_000_000
#: Terms of the vocabulary in one salted part.
SALTED_TERMS = 4096


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (rows that hold it). docs: lang, source, text."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    split = docs.select("lang", "source", words.alias("_w"))
    # A row's terms, and its different terms, in one explosion.
    kinds = split.select("lang", "source", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("df"), F.col("_w").alias("w")), F.struct(F.lit(0).alias("n"), F.lit(1).alias("df"), F.array_distinct("_w").alias("w")))).alias("_k"))
    terms = kinds.select("lang", "source", "_k.n", "_k.df", F.explode("_k.w").alias("term"))
    return terms.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _rate(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(PARTS (n + 2) / (total + 2 v)), in decimals, since the product can exceed 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    above, below = (wide(n) + 2) * F.lit(PARTS).cast("decimal(10,0)"), wide(total) + wide(v) * 2
    return F.call_function("div", above, below) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: item is each other source of the language, value their divergence over
    the language's vocabulary (0 if it has none), all ranks. Part ``term``: item is a term
    that the group uses more than its language does, value its divergence from the
    language's rate, the first ``top`` ranks. Ranks go by value, largest first, then by
    the item's UTF-8 bytes, so there are no ties.

    Null texts, languages and sources read as empty; a text without terms still makes its
    group occur. Repeated rows count each, as documents too. An empty table gives no
    rows. Other columns aren't read and may have any names. Long texts are split whole.
    """
    t = Safe(docs)
    text = lambda c: F.coalesce(t.col(c).cast("string"), F.lit(""))
    rows = t.rows.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    store = Tables(docs.sparkSession, "divergence")
    groups = store.put("groups", rows.select("lang", "source").distinct())
    counts = store.put("counts", term_counts(rows))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("df").alias("df")).filter(F.col("df") >= min_documents)
    vocabulary = store.put("vocabulary", kept.select("lang", "term", "all"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total"))
    # Counts of kept terms, and each group's sum of them.
    used = store.put("used", counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n"))
    store.drop("counts")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").select("lang", "source", "v", F.coalesce("total", F.lit(0)).cast("long").alias("total"), "lang_total")
    salts = max(1, vocabulary.count() // SALTED_TERMS)
    salted = sized.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    every = vocabulary.withColumn("_s", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    crossed = every.join(salted, ["lang", "_s"]).select("lang", "term", "source", "v", "total", "lang_total", "all", F.lit(0).cast("long").alias("n"))
    counted = used.join(sized, ["lang", "source"]).select("lang", "term", "source", "v", "total", "lang_total", F.lit(0).cast("long").alias("all"), "n")
    # Zeros and counts of a term meet where its sources are paired: one shuffle for both.
    dense = crossed.unionByName(counted).repartition("lang", "term").groupBy("lang", "term", "source").agg(*(F.max(c).alias(c) for c in ("v", "total", "lang_total", "all", "n")))
    rates = store.put("rates", dense.select("lang", "term", "source", "n", _rate(F.col("n"), F.col("total"), F.col("v")).alias("p"), _rate(F.col("all"), F.col("lang_total"), F.col("v")).alias("q")))
    a, b = rates.select("lang", "term", F.col("source").alias("a"), "p"), rates.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"))
    sums = a.join(b, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(_divergence(F.col("p"), F.col("q"))).alias("value"))
    # Languages without a vocabulary: pairs of value 0.
    bare = groups.join(langs, "lang", "left_anti")
    none = bare.select("lang", F.col("source").alias("a")).join(bare.select("lang", F.col("source").alias("b")), "lang").filter("a < b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    both = sums.unionByName(none).select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_x"))
    pairs = both.select("lang", "_x.source", F.lit("pair").alias("part"), "_x.item", "value")
    terms = rates.filter("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    first = terms.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(first).select("lang", "source", "part", "item", "value", "rank")

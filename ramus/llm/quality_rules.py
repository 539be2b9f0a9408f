"""Quality rules whose cut-offs follow each language's and source's own distribution.

All of it is DataFrame expressions. Four measures of a text (symbols to word
characters, repeated lines, repeated words, characters to a word) are gathered in
KLL quantile sketches for each (language, source). The sketches are mergeable: map
tasks send one small sketch for each group, whatever the group's rows, and a
group with too few rows to judge takes the sketch merged over its language, or over
everything. A text is rejected where a measure lies beyond the Tukey fence of its
group: the upper (or lower) quartile and ``fence`` times the range between the
quartiles, and a least distance, so that a group of nearly equal texts rejects none
for a trifle. Quartiles ignore up to a quarter of bad rows in a group.

Sketches of up to K values are exact; beyond it their rank error is under 0.1 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramus.llm.shared import Safe, once
from ramus.operators.storage import Tables

K = 4096
#: Fixed base rules.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: The measures with the least distance from the quartile to a fence, upper and lower (None: no fence).
MEASURES = {"symbols": (0.05, None), "dup_lines": (0.4, None), "repeats": (0.3, None), "word_length": (2.0, 2.0)}
#: A group needs so many texts to have fences of its own.
MIN_GROUP = 100


def _repeated(n: Column, trigrams: Column) -> Column:
    """Words in trigrams found twice or more. Only texts with a repeated one sort (hash, place) pairs."""
    pairs = F.sort_array(F.transform(trigrams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s: F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h))
    # transform() binds the sorted pairs to a variable, so that they are made once.
    found = F.transform(F.array(pairs), lambda s: same(s))[0]
    covered = F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    return F.when((n < 3) | (F.size(F.array_distinct(trigrams)) == n - 2), F.lit(0)).otherwise(F.size(covered)).cast("long")


def text_measures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    A trigram is known by a 64-bit hash of its words within its own text.
    """
    keep = docs.columns if keep is None else keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = once(docs, keep, _w=F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), _l=lines, n_symbols=F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
    w = F.col("_w")
    trigrams = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    first = once(
        split, [*keep, "n_symbols"], n_words=F.size(w).cast("long"), word_chars=F.char_length(F.array_join(w, "")).cast("long"), _g=trigrams,
        n_lines=F.size("_l").cast("long"), n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
    )
    return once(first, [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"], n_repeat_words=_repeated(F.col("n_words"), F.col("_g")))


def _with_verdict_inputs(measured: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return measured.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
        "symbols": ratio("n_symbols", "word_chars"), "dup_lines": ratio("n_dup_lines", "n_lines"), "repeats": ratio("n_repeat_words", "n_words"), "word_length": ratio("word_chars", "n_words"),
    })


def fences(measured: DataFrame, fence: float = 3.0, group: tuple[str, str] = ("_lang", "_source"), min_group: int = MIN_GROUP) -> DataFrame:
    """For each (language, source): {measure}_hi and {measure}_lo. measured: group columns and measures of texts that pass the base rules."""
    lang, source = group
    own = measured.groupBy(lang, source).agg(F.count("*").alias("_n"), *(F.kll_sketch_agg_double(m, F.lit(K)).alias(m) for m in MEASURES))
    # A row for each group, read three times below; the texts are measured once for them.
    own = Tables(measured.sparkSession, "sketches").put("own", own)
    by_lang = own.groupBy(lang).agg(F.sum("_n").alias("_ln"), *(F.kll_merge_agg_double(m).alias(f"_l_{m}") for m in MEASURES))
    every = own.agg(*(F.kll_merge_agg_double(m).alias(f"_a_{m}") for m in MEASURES))
    # As many rows as there are groups; one row of all.
    levels = own.join(by_lang, own[lang].eqNullSafe(by_lang[lang]), "inner").drop(by_lang[lang]).join(F.broadcast(every), F.lit(True))
    out = []
    for m, (up, down) in MEASURES.items():
        sketch = F.when(F.col("_n") >= min_group, F.col(m)).when(F.col("_ln") >= min_group, F.col(f"_l_{m}")).otherwise(F.col(f"_a_{m}"))
        q1, q3 = F.kll_sketch_get_quantile_double(sketch, F.lit(0.25)), F.kll_sketch_get_quantile_double(sketch, F.lit(0.75))
        out.append((q3 + fence * (q3 - q1) + up).alias(f"{m}_hi"))
        out.append((q1 - fence * (q3 - q1) - down if down is not None else F.lit(float("-inf"))).alias(f"{m}_lo"))
    return levels.select(lang, source, *out)


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, fence: float = 3.0) -> DataFrame:
    """One row per input row: rec (struct of ``keep``, by default all the input's
    columns), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.

    Null and blank texts have no words and fail the base rules. A null language or
    source is a group of its own. Repeated rows count each; the sketches are of the
    texts that pass the base rules. An empty table gives no rows. Where ``keep`` has
    the text, texts are measured twice, for the sketches and for the verdict, so that
    no text is moved or stored; else the measures are written to a table in between.
    """
    t = Safe(docs, keep)
    group = [t.col(lang_col).alias("_lang"), t.col(source_col).alias("_source")]
    base = t.rows.select(t.rec, *group, t.col(text_col).alias("_text"))
    measured = _with_verdict_inputs(text_measures(base, "_text", ["rec", "_lang", "_source"]))
    if t.holds(text_col):
        slim = _with_verdict_inputs(text_measures(t.rows.select(*group, t.col(text_col).alias("_text")), "_text", ["_lang", "_source"]))
    else:
        measured = slim = Tables(docs.sparkSession, "measures").put("measures", measured)
    limits = Tables(docs.sparkSession, "fences").put("fences", fences(slim.filter(~F.col("base_failed")), fence))
    return t.out(judge(measured, limits)).select("rec", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The measured rows with ``kept``. The fences join on the group; Spark broadcasts them only while they are small."""
    limits = limits.withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    joined = measured.join(limits, measured["_lang"].eqNullSafe(limits["_l"]) & measured["_source"].eqNullSafe(limits["_s"]), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(F.col(m) <= F.col(f"{m}_hi"), F.lit(True)) & F.coalesce(F.col(m) >= F.col(f"{m}_lo"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)

"""Operator 10: quality rules with thresholds learned per language and source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molsift.llm.common import SPACE, words_of
from molsift.session import hint_if_small, materialise

# The symbols that count as such.
SYMBOLS = "[#*$%&|<>]"
# Per measure: the slack added to the upper fence, and to the lower one (None:
# no lower fence). Shares are in thousandths, word length in hundredths. A text
# of three lines with one repeated has 333 duplicate lines in a thousand.
MEASURES = {"symbols_pm": (50, None), "dup_lines_pm": (400, None), "repeats_pm": (300, None),
            "upper_pm": (150, None), "word_len": (400, 250)}


def text_counts(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines of each text."""
    d = docs.select(*keep, F.coalesce(docs[text], F.lit("")).alias("_t"))
    d = d.withColumn("_w", words_of(F.col("_t"))).withColumn("n_words", F.size("_w").cast("long"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_l", lines)
    # Hashes of all 3-word windows; only texts in which two agree need their places.
    windows = F.expr("""if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, n_words - 3),
                        i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))""")
    d = d.withColumn("_g", windows).withColumn("_twice", F.size(F.array_distinct("_g")) < F.size("_g"))
    d = d.withColumn("_o", F.expr("if(_twice, sort_array(transform(_g, (h, i) -> struct(h, i))), null)"))
    d = d.withColumn("_p", F.expr("""transform(filter(sequence(0, size(_o) - 1), j ->
        (j > 0 and _o[j].h = _o[greatest(j - 1, 0)].h) or (j < size(_o) - 1 and _o[j].h = _o[least(j + 1, size(_o) - 1)].h)), j -> _o[j].i)"""))
    covered = F.expr("size(array_distinct(concat(_p, transform(_p, x -> x + 1), transform(_p, x -> x + 2))))")
    names = [c for c in d.columns if not c.startswith("_") and c != "n_words"]
    return d.select(
        *names, "n_words",
        F.length(F.regexp_replace("_t", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_twice"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"))


def _measures() -> list[Column]:
    def share(part, whole, unit=1000):
        return F.coalesce(F.expr(f"{unit} * {part} div nullif({whole}, 0)"), F.lit(0)).cast("long")
    return [share("n_symbols", "word_chars").alias("symbols_pm"), share("n_dup_lines", "n_lines").alias("dup_lines_pm"),
            share("n_repeat_words", "n_words").alias("repeats_pm"), share("n_upper", "word_chars").alias("upper_pm"),
            share("word_chars", "n_words", 100).alias("word_len")]


def sketch(rows: DataFrame, group: list[str]) -> DataFrame:
    """Quantile sketches of the measures: ``group``, measure, bucket, n.

    A bucket is the value with all but its six leading bits cleared, so a
    sketch has some hundred buckets whatever it counts, a quantile is off by at
    most 1/32 of its value, and sketches merge by adding up buckets.
    """
    pairs = ", ".join(f"'{m}', {m}" for m in MEASURES)
    long = rows.select(*group, F.expr(f"stack({len(MEASURES)}, {pairs}) as (measure, v)"))
    cut = "greatest(0, length(bin(v)) - 6)"
    bucket = F.expr(f"shiftleft(shiftright(v, {cut}), {cut})")
    return long.groupBy(*group, "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, group: list[str], slack: dict, spread: float = 3.0) -> DataFrame:
    """Fences from the quartiles of each sketch: ``group``, measure, docs, low, high."""
    by = W.partitionBy(*group, "measure")
    up = by.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    q = sketches.withColumn("_c", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(by))
    at = [F.min(F.when(F.col("_c") * 4 >= F.col("_all") * k, F.col("bucket"))) for k in (1, 3)]
    q = q.groupBy(*group, "measure").agg(F.first("_all").alias("docs"), at[0].alias("q1"), at[1].alias("q3"))
    add = {side: F.coalesce(*[F.when(F.col("measure") == m, F.lit(s[side])) for m, s in slack.items()]) for side in (0, 1)}
    width = F.lit(spread) * (F.col("q3") - F.col("q1"))
    return q.select(*group, "measure", "docs", (F.col("q3") + width + add[0]).alias("high"),
                    (F.col("q1") - width - add[1]).alias("low"))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                  min_docs: int = 200, slack: dict | None = None) -> DataFrame:
    """Judge every document by fixed base rules and by learned thresholds.

    Returns one row per input row: ``key``, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept and n_outside (measures
    outside their fences). Thresholds come from quantile sketches of the
    documents that pass the base rules, one sketch per language, source and
    measure: fences lie three interquartile ranges and a slack outside the
    quartiles. A (language, source) with fewer than ``min_docs`` documents takes
    the merged sketch of its language, or that of all documents.

    A null or empty text has no words and fails the base rules; null languages
    and sources are groups of their own; repeated rows and null keys are rows
    like any other; an empty table gives no rows. Other columns are not read.
    """
    slack = slack or MEASURES
    keep = [docs[key].alias("k"), docs[lang].alias("g_lang"), docs[source].alias("g_source")]
    rows = text_counts(docs, text, keep)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = materialise(rows.select("*", failed.alias("base_failed"), *_measures()), "rules-rows")
    fine = materialise(sketch(rows.filter(~F.col("base_failed")), ["g_lang", "g_source"]), "rules-sketches")
    levels = [["g_lang", "g_source"], ["g_lang"], []]
    found = [fences(fine.groupBy(*g, "measure", "bucket").agg(F.sum("n").alias("n")), g, slack) for g in levels]
    names = [f.select(*[F.col(c).alias(f"{c}{i}") for c in g], F.col("measure").alias(f"m{i}"), F.col("docs").alias(f"docs{i}"),
                      F.col("low").alias(f"low{i}"), F.col("high").alias(f"high{i}")) for i, (f, g) in enumerate(zip(found, levels))]
    best = names[0].join(names[1], F.col("g_lang0").eqNullSafe(F.col("g_lang1")) & (F.col("m0") == F.col("m1"))).join(names[2], F.col("m0") == F.col("m2"))

    def pick(c):
        return F.when(F.col("docs0") >= min_docs, F.col(f"{c}0")).when(F.col("docs1") >= min_docs, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))

    limits = best.groupBy(F.col("g_lang0"), F.col("g_source0")).agg(
        *[F.max(F.when(F.col("m0") == m, pick(c))).alias(f"{m}_{c}") for m in slack for c in ("low", "high")])
    limits = materialise(limits, "rules-limits")
    rows = rows.join(hint_if_small(limits), F.col("g_lang").eqNullSafe(F.col("g_lang0")) & F.col("g_source").eqNullSafe(F.col("g_source0")), "left")
    outside = reduce(lambda a, b: a + b, [
        F.coalesce(((F.col(m) > F.col(f"{m}_high")) | F.coalesce(F.col(m) < F.col(f"{m}_low"), F.lit(False))).cast("int"), F.lit(0)) for m in slack])
    return rows.withColumn("n_outside", outside).select(
        F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_outside") == 0)).alias("kept"), "n_outside")

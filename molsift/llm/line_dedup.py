"""Operator 2: near-duplicate lines by a deletion-neighbourhood join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molsift.llm.common import SPACE, SPACE_CHARS, WORD, unused_names, words_of
from molsift.session import broadcast_below, hint_if_small, materialise


def _half_keys(words: str) -> Column:
    """Hashes of the leading and trailing halves of a line's words.

    Lines one word edit apart share all words before the edit and all after
    it, so one of the two runs has at least half of the words that stay. The
    two lengths cover partners of equal, larger and smaller size.
    """
    return F.expr(f"""flatten(transform(array_distinct(array((size({words}) - 1) div 2, size({words}) div 2)), h -> array(
        xxhash64(slice({words}, 1, cast(h as int)), h, 0),
        xxhash64(slice({words}, cast(size({words}) - h + 1 as int), cast(h as int)), h, 1))))""")


def _variants(words: str) -> Column:
    """Keys of a line and of the line without its 1st, 2nd, ... word.

    A key is the exclusive or of hashes of (word, place), so leaving out a word
    is what is before it, and what is after it at places one less; both come
    from running values in one pass over the line.
    """
    return F.expr(f"""aggregate({words}, named_struct('i', 0, 'all', 0L, 'moved', 0L, 'out', cast(array() as array<struct<p: bigint, m: bigint>>)),
        (x, w) -> named_struct('i', x.i + 1, 'all', x.all ^ xxhash64(w, x.i), 'moved', x.moved ^ xxhash64(w, x.i - 1),
            'out', array_append(x.out, named_struct('p', x.all, 'm', x.moved ^ xxhash64(w, x.i - 1)))),
        x -> concat(array(x.all), transform(x.out, o -> o.p ^ x.moved ^ o.m)))""")


def _one_edit(a: str, b: str) -> Column:
    """Whether word arrays a and b are at most one word edit apart."""
    def less(x, y):
        return f"""exists(sequence(1, size({x})), i -> concat(slice({x}, 1, i - 1), slice({x}, i + 1, size({x}))) = {y})"""
    return F.expr(f"""case when size({a}) = size({b}) then size(filter(zip_with({a}, {b}, (x, y) -> x <> y), z -> z)) <= 1
        when size({a}) = size({b}) + 1 then {less(a, b)} when size({b}) = size({a}) + 1 then {less(b, a)} else false end""")


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Lines that repeat an earlier one: (k, no, near), and all rows as (k, n_lines).

    Lines come in the order of key (nulls last) and line number. A line is
    dropped if an earlier one has the same words, or (from ``min_words`` words
    on) is one word edit away: a word replaced, added or left out.
    """
    # The text's hash tells rows of one key apart.
    rows = docs.select(docs[key].alias("k"), F.xxhash64(docs[text]).alias("h"), F.split(F.coalesce(docs[text], F.lit("")), "\n").alias("l"))
    # Blank lines go by a cheap test first, so that words are cut once per line.
    lines = rows.select("k", "h", F.posexplode("l").alias("no", "line")).filter(F.col("line").rlike(WORD))
    lines = lines.select("k", "h", "no", F.split(F.btrim("line", F.lit(SPACE_CHARS)), f"{SPACE}+").alias("w"))
    lines = lines.select("k", "h", "no", F.xxhash64("w").alias("c1"), F.xxhash64(F.lit(7), "w").alias("c2"),
                         F.when(F.size("w") >= min_words, _half_keys("w")).alias("halves"))
    lines = materialise(lines, "line-rows")
    place = F.struct(F.col("k").isNull().alias("last"), F.col("k").alias("k"), F.col("no").alias("no"))
    # One class per distinct line; the earliest place of each, pre-aggregated.
    classes = lines.groupBy("c1", "c2").agg(F.min(F.struct(place.alias("p"), "h")).alias("at"), F.any_value("halves").alias("halves"), F.count("*").alias("n"))
    classes = classes.select("c1", "c2", "at.p", "at.h", "halves", "n")
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "line-classes")

    # Classes that share a half with another one may have a partner.
    halves = classes.filter("halves is not null").select("id", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("half")
    some = halves.join(shared, "half", "left_semi").select("id").distinct()
    chosen = materialise(classes.join(some, "id", "left_semi").select("id", "p", "h", F.col("p.k").alias("k"), F.col("p.no").alias("no")), "line-chosen")

    # Their words, from the texts again; then all variants within the edit bound.
    per_doc = chosen.groupBy(F.col("k").alias("ck"), F.col("h").alias("ch")).agg(F.collect_list(F.struct("no", "id", "p")).alias("want"))
    per_doc = broadcast_below(materialise(per_doc, "line-wanted"), 64 << 20)
    found = rows.join(per_doc, rows.k.eqNullSafe(per_doc.ck) & (rows.h == per_doc.ch)).select("l", F.explode("want").alias("x"))
    found = found.select("x.id", "x.p", words_of(F.expr("get(l, x.no)")).alias("w")).filter(F.size("w") >= min_words)
    found = materialise(found.dropDuplicates(["id"]), "line-words")
    variants = found.select("id", "p", F.posexplode(_variants("w")).alias("cut", "v"))
    variants = materialise(variants, "line-variants")

    # Equal variants meet in aggregates, never in pairs: the earliest whole line,
    # the earliest shortened one, and the earliest one cut at each place.
    first = F.struct("p", "id")
    whole = F.col("cut") == 0
    by_v = variants.groupBy("v").agg(F.min(F.when(whole, first)).alias("whole"), F.min(F.when(~whole, first)).alias("part"), F.count("*").alias("m")).filter("m > 1").drop("m")
    by_cut = variants.filter(~whole).groupBy("v", "cut").agg(F.min(first).alias("same"), F.count("*").alias("m")).filter("m > 1").drop("m")
    met = variants.join(by_v, "v").join(by_cut, ["v", "cut"], "left")
    partner = F.least(F.when(whole, F.col("part")).otherwise(F.col("whole")), F.when(~whole, F.col("same")))
    near = (met.select("id", "p", partner.alias("q")).filter(F.col("q.p") < F.col("p"))
            .groupBy("id").agg(F.min("q").alias("q")).select("id", F.col("q.id").alias("with")))
    words = found.select("id", "w")
    near = near.join(words, "id").join(words.select(F.col("id").alias("with"), F.col("w").alias("w2")), "with").filter(_one_edit("w", "w2"))
    near = materialise(near.select("id", F.lit(True).alias("near")), "line-near")

    touched = classes.select("id", "c1", "c2", "p", "n").join(near, "id", "left").filter(F.col("near") | (F.col("n") > 1))
    hit = lines.select("k", "no", "c1", "c2").join(touched.select("c1", "c2", "p", F.coalesce("near", F.lit(False)).alias("near")), ["c1", "c2"])
    dropped = hit.filter(F.col("near") | (place != F.col("p"))).select("k", "no", (place == F.col("p")).alias("near"))
    return dropped, rows.select("k", F.size("l").alias("n_lines"))


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5) -> DataFrame:
    """What line dedup does to every document: ``key``, n_lines, n_exact, n_near, dropped.

    ``dropped`` lists the numbers (from 0) of dropped lines. Null and empty
    texts have one blank line, which stays, as all blank lines do; rows of
    equal keys are at the same place, and each drops what any of them drops;
    null keys come last; an empty table gives no rows. Other columns are not read.
    """
    dropped, rows = dropped_lines(docs, key, text, min_words)
    per_doc = dropped.distinct().groupBy(F.col("k").alias("dk")).agg(
        F.sort_array(F.collect_list("no")).alias("dropped"), F.count_if(~F.col("near")).alias("n_exact"), F.count_if("near").alias("n_near"))
    per_doc = hint_if_small(materialise(per_doc, "line-dropped"))
    return rows.join(per_doc, rows.k.eqNullSafe(per_doc.dk), "left").select(
        F.col("k").alias(key), F.col("n_lines").cast("long").alias("n_lines"), F.coalesce("n_exact", F.lit(0)).alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 5) -> DataFrame:
    """``docs`` without the lines that ``dropped_lines`` names; all columns stay."""
    dropped, _ = dropped_lines(docs, key, text, min_words)
    gone_key, gone_lines = unused_names(docs, "_gone_key", "_gone")
    gone = dropped.groupBy(F.col("k").alias(gone_key)).agg(F.collect_set("no").alias(gone_lines))
    kept = F.array_join(F.filter(F.split(docs[text], "\n"), lambda _, i: ~F.array_contains(gone_lines, i)), "\n")
    joined = docs.join(gone, docs[key].eqNullSafe(gone[gone_key]), "left")
    cut = F.when(F.col(gone_lines).isNull(), docs[text]).otherwise(kept)
    return joined.select(*[cut.alias(c) if c == text else docs[c] for c in docs.columns])

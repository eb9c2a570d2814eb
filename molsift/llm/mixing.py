"""Operator 3: mix sources to target weights, with a distributed prefix sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molsift.llm.common import hash_bucket, numbered, unused_names, word_count
from molsift.session import broadcast_below, hint_if_small, materialise

# Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def place_hash(key: Column, seed: int) -> Column:
    """31 random bits of a key, by MD5, so that any SQL engine can repeat them."""
    return F.shiftright(F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), 1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """Targets of ``sizes`` (source, n_rows, size): sid, source, n_rows, size, target.

    All sizes together are shared out by weight. A source stops at
    ``max_epochs`` times its size and the rest is shared again by weight, until
    none is above. That is one water level L with target = min(L * weight,
    max_epochs * size); each round is one aggregate over the sources and raises
    L, and a round that caps no further source ends the search.
    """
    ranked = numbered(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "sid", "mix-sources")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    ranked = materialise(ranked.select("sid", "source", "n_rows", "size", turn.cast("long").alias("w"),
                                       (F.col("size") * max_epochs).alias("most")), "mix-ranked")
    level, capped = 0.0, -1
    total = ranked.agg(F.sum("size")).first()[0] or 0
    while True:
        full = F.col("most") < F.lit(level) * F.col("w")
        got = ranked.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("w"))),
                         F.count(F.when(full, 1))).first()
        if got[2] == capped or not got[1]:
            break
        capped, level = got[2], (total - (got[0] or 0)) / got[1]
    return ranked.select("sid", "source", "n_rows", "size",
                         F.least(F.lit(level) * F.col("w"), F.col("most").cast("double")).alias("target"))


def _placed(docs: DataFrame, key: str, text: str, source: str, weights, max_epochs: int, seed: int, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (_k, _n, _h, before: words of their source placed before them) with their source's plan, and the plan."""
    rows = docs.select(docs[key].alias("_k"), docs[source].alias("_s"), word_count(docs[text]).alias("_n"))
    rows = materialise(rows.withColumn("_h", place_hash(F.col("_k"), seed)), "mix-rows")
    plan = source_targets(rows.groupBy(F.col("_s").alias("source"))
                          .agg(F.count("*").alias("n_rows"), F.sum("_n").alias("size")), weights, max_epochs)
    budget = F.floor("target").cast("long")
    plan = plan.withColumn("epochs", F.when(F.col("size") > 0, F.floor(budget / F.col("size"))).otherwise(0).cast("long"))
    plan = plan.select("sid", "source", "target", "epochs", F.col("size").alias("source_size"),
                       (budget - F.col("epochs") * F.col("size")).alias("rest"),
                       F.ceil(F.col("n_rows") / bucket_rows).cast("long").alias("n_buckets"))
    rows = rows.join(hint_if_small(plan), F.col("_s").eqNullSafe(F.col("source")))
    rows = rows.withColumn("_b", hash_bucket(F.col("_h"), F.col("n_buckets")))
    before = W.partitionBy("sid").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (rows.groupBy("sid", "_b").agg(F.sum("_n").alias("_sum"))
               .select("sid", "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off")))
    inside = W.partitionBy("sid", "_b").orderBy("_h", "_k", "_n").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, ["sid", "_b"])
    return rows.withColumn("before", F.col("_off") + F.col("_in")), plan


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                weights=WEIGHTS, max_epochs: int = 3, seed: int = 17, bucket_rows: int = 10_000) -> DataFrame:
    """How much of every document the mix takes.

    Returns one row per input row: ``key``, size (words), source_size, target
    (of its source), taken (words, repeats counted) and copies (whole epochs).
    Every row gets a random place in its source from a hash of its key. A
    source's budget floor(target) is cut exactly: whole epochs of the source
    first, then rows by place until the rest is used up; the row on the cut
    gives the words that are left. So the words taken from a source add up to
    its budget, and no row gives more than ``max_epochs`` times its size.

    The prefix sums are distributed: within a source the places are cut into
    ranges of about ``bucket_rows`` rows (so a source with a third of all rows
    is many ranges), sums of ranges are added up per source, and rows only
    within their range.

    Null or empty texts have size 0 and give 0 words; a null source is a source
    of its own and comes last; repeated rows and null keys are rows like any
    other (equal rows are interchangeable); an empty table gives no rows. Other
    columns, whatever their names, are not read.
    """
    rows, _ = _placed(docs, key, text, source, weights, max_epochs, seed, bucket_rows)
    extra = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("rest") - F.col("before")))
    return rows.select(F.col("_k").alias(key), F.col("_n").alias("size"), "source_size", "target",
                       (F.col("epochs") * F.col("_n") + extra).cast("long").alias("taken"),
                       F.col("epochs").alias("copies"))


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                  weights=WEIGHTS, max_epochs: int = 3, seed: int = 17, bucket_rows: int = 10_000) -> DataFrame:
    """The mix itself: the rows of ``docs``, with all columns, as often as the mix takes them.

    Documents stay whole here: the one on a source's cut is taken once more if
    half of it is within the budget. The places of all rows shrink to one cut
    per source, and each row decides by itself on which side it is, so texts
    are not shuffled.
    """
    rows, plan = _placed(docs, key, text, source, weights, max_epochs, seed, bucket_rows)
    place = F.struct(F.col("_h").alias("h"), F.col("_k").alias("k"), F.col("_n").alias("n"))
    cuts = rows.filter(2 * F.col("before") + F.col("_n") > 2 * F.col("rest")).groupBy("sid").agg(F.min(place).alias("_cut"))
    name, epochs, cut, times, one = unused_names(docs, "_source", "_epochs", "_cut", "_times", "_one")
    cuts = plan.join(cuts, "sid", "left").select(F.col("source").alias(name), F.col("epochs").alias(epochs), F.col("_cut").alias(cut))
    cuts = broadcast_below(materialise(cuts, "mix-cuts"))
    mine = F.struct(place_hash(docs[key], seed).alias("h"), docs[key].alias("k"), word_count(docs[text]).alias("n"))
    n = F.col(epochs) + F.when(F.col(cut).isNull() | (mine < F.col(cut)), 1).otherwise(0)
    joined = docs.join(cuts, docs[source].eqNullSafe(F.col(name))).withColumn(times, F.array_repeat(F.lit(0), n.cast("int")))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(times).alias(one)).drop(one)

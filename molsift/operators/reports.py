"""Aggregate reports: E2-E8, E16, G3. One pass each, by
Spark's partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import pct


def property_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Totals, success/failure counts and percentages, and min/max/mean
    of each property over the successful rows, as a ``(metric, value)`` table.

    A row succeeds when every listed property is non-NULL.
    """
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    aggs = [F.count(F.lit(1)).cast("double").alias("total"),
            F.count_if(ok).cast("double").alias("success")]
    for c in cols:
        v = F.when(ok, F.col(c))
        aggs += [F.min(v).cast("double").alias(f"min_{c}"),
                 F.max(v).cast("double").alias(f"max_{c}"),
                 F.avg(v).alias(f"avg_{c}")]
    one = df.agg(*aggs).withColumn("failed", F.col("total") - F.col("success"))
    one = one.withColumns({"success_pct": pct("success", "total"),
                           "failed_pct": pct("failed", "total")})
    metrics = ["total", "success", "failed", "success_pct", "failed_pct"] + \
        [f"{s}_{c}" for c in cols for s in ("min", "max", "avg")]
    return one.unpivot([], metrics, "metric", "value")


def quality_report(df: DataFrame, status_col: str = "status", key_col: str = "smiles") -> DataFrame:
    """Total, valid, invalid and empty counts, failure rate and the number
    of distinct valid keys (status NULL means valid)."""
    s = F.col(status_col)
    valid = s.isNull()
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(valid).alias("valid"),
        F.count_if(s == F.lit("SMILES is empty")).alias("empty"),
        F.count_if(s.isNotNull() & (s != F.lit("SMILES is empty"))).alias("invalid"),
        F.count_distinct(F.when(valid, F.col(key_col))).alias("unique_valid"),
    ).withColumn("failure_rate", F.round(pct(F.col("total") - F.col("valid"), "total"), 6))


def summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column min, max, mean, sample and population sigma, count, in one scan."""
    stats = {"n": F.count, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp, "std_pop": F.stddev_pop}
    one = df.agg(*[(f(c).cast("double") if name in ("min", "max") else f(c)).alias(f"{name}_{i}")
                   for i, c in enumerate(cols) for name, f in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in stats]) for i, c in enumerate(cols)])
    return one.select(F.inline(rows))


def group_mean(df: DataFrame, key: str, target: str, alias: str = "mean_target") -> DataFrame:
    """E5: mean target per molecule (one hash aggregate with map-side combine)."""
    return df.groupBy(key).agg(F.avg(target).alias(alias), F.count(F.lit(1)).alias("n"))


def _range_scalars(df: DataFrame, col: str):
    r = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    return r.select("lo").scalar(), r.select("hi").scalar()


def bin_index(x, lo, hi, n: int, edge: str = "closed"):
    """Equal-width bin of ``x`` on [lo, hi] with ``n`` bins.

    ``closed``: the maximum falls in the last bin. ``own``: the maximum gets
    bin ``n`` of its own (the digitize convention). A zero-width range puts
    every value in bin 0.
    """
    raw = F.floor((x - lo) * F.lit(float(n)) / (hi - lo)).cast("int")
    if edge == "closed":
        raw = F.least(raw, F.lit(n - 1))
    return F.when(hi == lo, F.lit(0)).otherwise(raw)


def bin_counts(df: DataFrame, col: str, n: int, edge: str = "closed") -> DataFrame:
    """Counts per equal-width bin, zero-count bins kept, with edges."""
    lo, hi = _range_scalars(df, col)
    x = F.col(col).cast("double")
    counts = (df.where(x.isNotNull()).select(bin_index(x, lo, hi, n, edge).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    last = n if edge == "own" else n - 1
    bins = (df.sparkSession.range(0, last + 1).select(F.col("id").cast("int").alias("bin")))
    width = (hi - lo) / F.lit(float(n))
    return (bins.join(F.broadcast(counts), "bin", "left")  # at most n+1 rows
            .select("bin", (lo + F.col("bin") * width).alias("lo_edge"),
                    F.when(F.col("bin") >= n, hi).otherwise(lo + (F.col("bin") + 1) * width)
                    .alias("hi_edge"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("count")))


def adaptive_bins(df: DataFrame, col: str, candidates=(5, 4, 3, 2), min_count: int = 2,
                  edge: str = "closed") -> DataFrame:
    """The largest bin count whose every bin holds ``min_count`` rows.

    One pass: every row is counted under each candidate bin count at once.
    Returns one row ``n_bins`` (NULL when no candidate qualifies).
    """
    lo, hi = _range_scalars(df, col)
    x = F.col(col).cast("double")
    exploded = df.where(x.isNotNull()).select(
        x.alias("x"), F.explode(F.array(*[F.lit(k) for k in candidates])).alias("k"))
    binned = exploded.select("k", F.when(hi == lo, F.lit(0)).otherwise(
        F.floor((F.col("x") - lo) * F.col("k").cast("double") / (hi - lo)).cast("int")).alias("b"))
    if edge == "closed":
        binned = binned.withColumn("b", F.least(F.col("b"), F.col("k") - 1))
    per_bin = binned.groupBy("k", "b").agg(F.count(F.lit(1)).alias("c"))
    n_buckets = F.col("k") + (1 if edge == "own" else 0)
    ok = (per_bin.groupBy("k").agg(F.min("c").alias("min_c"), F.count(F.lit(1)).alias("nb"))
          .where((F.col("min_c") >= min_count) & (F.col("nb") == n_buckets)))
    return ok.agg(F.max("k").alias("n_bins"))


def histogram(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """``n`` equal-width bins, the last one closed; zero bins kept."""
    return bin_counts(df, col, n, edge="closed")


def bit_moments(df: DataFrame, bits_col: str, n_rows=None) -> DataFrame:
    """Per fingerprint bit, mean p and population sigma sqrt(p(1-p))
    of the 0/1 feature, from the sparse on-bit arrays."""
    total = n_rows if n_rows is not None else df.select(F.count(F.lit(1)).cast("double")).scalar()
    counts = df.select(F.explode(F.array_distinct(bits_col)).alias("bit")) \
        .groupBy("bit").agg(F.count(F.lit(1)).alias("on"))
    p = F.col("on") / total
    return counts.select("bit", "on", p.alias("mean"), F.sqrt(p * (F.lit(1.0) - p)).alias("sd"))


def extremes(df: DataFrame, key: str, value: str) -> DataFrame:
    """Highest and lowest value with their keys (smallest key on ties)."""
    return df.agg(
        F.max(value).alias("max_value"),
        F.min_by(key, F.struct(-F.col(value), F.col(key))).alias("key_at_max"),
        F.min(value).alias("min_value"),
        F.min_by(key, F.struct(F.col(value), F.col(key))).alias("key_at_min"),
        F.count(F.lit(1)).alias("n"))

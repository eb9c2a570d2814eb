"""Scores of predictions: confusion, regression metrics, ROC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import running_sum


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of all four (label, pred) pairs of 0 and 1, zeros kept."""
    pairs = [F.count_if((F.col(label) == y) & (F.col(pred) == p)).alias(f"{y}_{p}") for y in (0, 1) for p in (0, 1)]
    wide = df.groupBy(*by).agg(*pairs) if by else df.agg(*pairs)
    rows = F.array(*[F.struct(F.lit(y).alias(label), F.lit(p).alias(pred), F.col(f"{y}_{p}").alias("n")) for y in (0, 1) for p in (0, 1)])
    return wide.select(*by, F.inline(rows))


def accuracy(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction is the label."""
    right = F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy")
    return df.groupBy(*by).agg(right, F.count(F.lit(1)).alias("n")) if by else df.agg(right, F.count(F.lit(1)).alias("n"))


def regression_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """r2, mse, mae and n. r2 = 1 - squared error over squared deviation from the mean."""
    err = F.col(label) - F.col(pred)
    whole = df.where(F.col(label).isNotNull() & F.col(pred).isNotNull())
    aggs = [F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop(label).alias("_var"), F.count(F.lit(1)).alias("n")]
    out = whole.groupBy(*by).agg(*aggs) if by else whole.agg(*aggs)
    return out.withColumn("r2", F.when(F.col("_var") > 0, 1 - F.col("mse") / F.col("_var"))).drop("_var")


def fold_summary(df: DataFrame, metric: str) -> DataFrame:
    """Mean and population sigma of a metric over folds."""
    return df.agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_pop(metric), F.lit(0.0)).alias("std"), F.count(metric).alias("folds"))


def roc_curve(df: DataFrame, label: str, score: str, by: str) -> DataFrame:
    """One point per fold and distinct score, ties together: score, tp, fp, tpr, fpr.

    The running counts go over ranges of the score, so that a fold is not one task.
    """
    counts = df.groupBy(by, score).agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_n"))
    run = running_sum(counts, [by], [F.col(score).desc()], ["_p", "_n"])
    totals = df.groupBy(F.col(by).alias("_by")).agg(F.sum(label).alias("_tp"), F.sum(1 - F.col(label)).alias("_tn"))
    out = run.join(totals, F.col(by).eqNullSafe(F.col("_by")))
    return out.select(by, score, F.col("cum__p").alias("tp"), F.col("cum__n").alias("fp"), "_p", "_n",
                      F.try_divide("cum__p", "_tp").alias("tpr"), F.try_divide("cum__n", "_tn").alias("fpr"))


def auc(points: DataFrame, by: str) -> DataFrame:
    """Area under the curve of each fold, as the trapezoids between its points.

    A step adds its negatives times the positives before it plus half of its
    own, so that no point needs the one before it.
    """
    area = F.sum(F.col("_n") * (F.col("tp") - F.col("_p") / 2))
    return points.groupBy(by).agg(F.try_divide(area, F.max("tp") * F.max("fp")).alias("auc"))


def interpolate(points: DataFrame, grid: Column, by: str, x: str, y: str) -> DataFrame:
    """linear interpolation of each series of ``points`` at every value of the ascending array ``grid``.

    Outside the points the end values hold; where points share an x, the last
    (largest) y counts to the right of it. Points without x or y are left out.

    Points shrink to the first and last of each grid interval, by an aggregate;
    what is carried over interval borders is one row per grid value, so no
    window is longer than the grid, however many points a series has.
    """
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    whole = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = (whole.groupBy(F.col(by).alias("_by"), F.size(F.filter(grid, lambda g: g < F.col(x))).alias("_slot"))
            .agg(F.max(point).alias("_last"), F.min(point).alias("_first")))
    asked = whole.select(by).distinct().select(by, F.posexplode(F.concat(grid, F.array(F.lit(None).cast("double")))).alias("_k", "_at"))
    rows = asked.join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_k") == F.col("_slot")), "left")
    order = Window.partitionBy(by).orderBy("_k")  # one row per grid value
    low = F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, 0))
    high = F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing))
    found = rows.withColumns({"_lo": low, "_hi": high}).where(F.col("_at").isNotNull())
    slope = (F.col("_hi.y") - F.col("_lo.y")) / (F.col("_hi.x") - F.col("_lo.x"))
    value = (F.when(F.col("_lo").isNull(), F.col("_hi.y")).when(F.col("_hi").isNull() | (F.col("_lo.x") == F.col("_at")), F.col("_lo.y"))
             .otherwise(F.col("_lo.y") + slope * (F.col("_at") - F.col("_lo.x"))))
    return found.select(by, F.col("_at").alias(x), value.alias(y))


def mean_roc(points: DataFrame, by: str, n: int = 100) -> DataFrame:
    """Mean and population sigma of the folds' true positive rates on a grid of ``n`` points.

    Every curve starts at (0, 0); the first mean is 0 and the last 1.
    """
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / F.lit(float(n - 1)))
    start = points.select(by).distinct().select(by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    curve = points.select(by, "fpr", "tpr").unionByName(start)
    at = interpolate(curve, grid, by, "fpr", "tpr").groupBy("fpr").agg(F.avg("tpr").alias("tpr"), F.stddev_pop("tpr").alias("std"))
    return at.withColumn("tpr", F.when(F.col("fpr") == 0, 0.0).when(F.col("fpr") == 1, 1.0).otherwise(F.col("tpr")))


def mean_auc(curve: DataFrame) -> DataFrame:
    """Area under a mean curve (as many rows as its grid has)."""
    w = Window.orderBy("fpr")
    step = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return curve.select(step.alias("a")).agg(F.sum("a").alias("auc"))

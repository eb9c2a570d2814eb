"""Composite score: features, moments, z-scores, weights, sigmoid.

The statistics are a one-row aggregate used as scalar subqueries, so the
score is one lazy plan: a partial/final aggregate feeding a codegen
projection. No cross join and no driver round trip unless frozen
statistics are asked for (streaming, J1).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import sigmoid, threshold_label
from ..sources.tables import require_columns

# The published composite-score weights (result of the logistic
# fit) for -LogP, HBD+HBA and logS, and the intercept.
STOTAL_WEIGHTS = {"neg_logp": 0.0124, "hbd_hba": 0.2086, "logs": 2.4509}
STOTAL_INTERCEPT = -0.4345


def score_features(df: DataFrame, logp: str = "logp", hbd: str = "hbd", hba: str = "hba",
                   logs: str = "logs") -> DataFrame:
    """``neg_logp = -logp`` and ``hbd_hba = hbd + hba`` (NULL if either is)."""
    require_columns(df, [logp, hbd, hba, logs])
    return df.withColumns({"neg_logp": -F.col(logp),
                           "hbd_hba": F.col(hbd) + F.col(hba)})


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with mean, population sigma and non-null count per column.

    Spark's partial/final ``avg``/``stddev_pop`` merge sums and counts
    per partition, with a numerically stable variance.
    A column with no value gets mean 0; sigma <= 0 or undefined becomes 1.
    """
    aggs = []
    for c in cols:
        aggs += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"),
                 F.stddev_pop(c).alias(f"{c}_sd_raw"),
                 F.count(c).alias(f"{c}_n")]
    m = df.agg(*aggs)
    return m.select(*[x for c in cols for x in (
        F.col(f"{c}_mean"),
        F.when(F.coalesce(F.col(f"{c}_sd_raw"), F.lit(0.0)) > 0, F.col(f"{c}_sd_raw"))
        .otherwise(F.lit(1.0)).alias(f"{c}_sd"),
        F.col(f"{c}_n"))])


def _stat_columns(df: DataFrame, cols: Sequence[str],
                  stats: Mapping[str, tuple[float, float]] | None) -> dict[str, tuple[Column, Column]]:
    if stats is not None:
        return {c: (F.lit(float(stats[c][0])), F.lit(float(stats[c][1]))) for c in cols}
    m = moments(df, cols)
    return {c: (m.select(f"{c}_mean").scalar(), m.select(f"{c}_sd").scalar()) for c in cols}


def frozen_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Evaluate E1 once (a single one-row job) and return ``{col: (mean, sd)}``."""
    row = moments(df, cols).first()
    return {c: (row[f"{c}_mean"], row[f"{c}_sd"]) for c in cols}


def zscore(df: DataFrame, cols: Sequence[str],
           stats: Mapping[str, tuple[float, float]] | None = None,
           prefix: str = "z_") -> DataFrame:
    """``(x - mean) / sigma_pop`` per column; statistics fitted on ``df``
    unless given (fit on train, apply to test)."""
    sc = _stat_columns(df, cols, stats)
    return df.withColumns({f"{prefix}{c}": (F.col(c) - sc[c][0]) / sc[c][1] for c in cols})


def composite_score(df: DataFrame, weights: Mapping[str, float] = STOTAL_WEIGHTS,
                    intercept: float = STOTAL_INTERCEPT, stats=None,
                    score_col: str = "stotal", prob_col: str = "predicted_probability",
                    label_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Z-score the weighted features, add the linear score and
    its sigmoid; the originals come first, new columns last (B2).

    ``weights`` maps feature column -> weight and so carries its own feature
    list (three terms for the fixed weights, four with delta).
    """
    original = df.columns
    feats = list(weights)
    z = zscore(df, feats, stats=stats, prefix="_z_")
    s = F.lit(float(intercept))
    for c, w in weights.items():
        s = s + F.lit(float(w)) * F.col(f"_z_{c}")
    out = z.withColumn(score_col, s).withColumn(prob_col, sigmoid(score_col))
    new_cols = [score_col, prob_col]
    if label_col:
        out = out.withColumn(label_col, threshold_label(prob_col, threshold))
        new_cols.append(label_col)
    return out.select(*original, *new_cols)


def stotal(df: DataFrame, logp="logp", hbd="hbd", hba="hba", logs="logs", stats=None) -> DataFrame:
    """The library-scale composite score: B6 then B7-B10 with the fixed weights."""
    feats = score_features(df, logp, hbd, hba, logs)
    weights = {"neg_logp": STOTAL_WEIGHTS["neg_logp"], "hbd_hba": STOTAL_WEIGHTS["hbd_hba"],
               logs: STOTAL_WEIGHTS["logs"]}
    return composite_score(feats, weights, STOTAL_INTERCEPT, stats=stats).drop("neg_logp", "hbd_hba")

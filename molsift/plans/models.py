"""Model queries on ``v_feat``, ``v_lab`` and ``embeddings``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import smiles as S
from ..functions.scalar import yes_no
from ..operators import models as M
from ..operators.evaluation import accuracy, regression_metrics
from ..operators.splits import kfold
from ..operators.trees import boost, forest
from ..session import materialise
from ..sources.views import table, v_env, v_feat, v_lab
from .registry import query

FEATURES = ["f1", "f2", "f3", "f4"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def sides(spark, sf):
    f = v_feat(spark, sf)
    return f.where("part_set = 'train'"), f.where("part_set = 'test'")


@query("linear_fit", "I2 E15", sql="""SELECT round(regr_slope(label, f1), 6) AS slope, round(regr_intercept(label, f1), 6) AS intercept FROM v_feat WHERE part_set = 'train'""")
def q_linear_fit(spark, sf):
    """One feature, so that the closed form of SQL can be the twin."""
    train, _ = sides(spark, sf)
    m = M.fit_linear(train, ["f1"])
    return spark.createDataFrame([(round(float(m.coefficients[0]), 6), round(float(m.intercept), 6))], "slope double, intercept double")


@query("scaled_features", "I1", sql="""WITH s AS (SELECT avg(f1) m1, stddev_pop(f1) s1, avg(f3) m3, stddev_pop(f3) s3 FROM v_feat WHERE part_set = 'train')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((f1 - m1) / s1, 6) AS z_f1, round((f3 - m3) / s3, 6) AS z_f3 FROM v_feat, s WHERE part_set = 'test'""")
def q_scaled_features(spark, sf):
    train, test = sides(spark, sf)
    z = M.Scaler.fit(train, ["f1", "f3"]).transform(test)
    return z.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("z_f1", 6).alias("z_f1"), F.round("z_f3", 6).alias("z_f3"))


@query("ridge_scores", "I3 I13 E10 F2")
def q_ridge_scores(spark, sf):
    train, test = sides(spark, sf)
    folds = kfold(train.withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), 5, "k")
    model, alpha, _ = M.fit_ridge_cv(folds, FEATURES, "fold")
    return M.evaluate_split(model, train, test, FEATURES).withColumn("alpha", F.lit(alpha))


@query("ridge_on_fingerprints", "I3 C9 I13 E10")
def q_ridge_on_fingerprints(spark, sf):
    """Ridge over 1,024 circular bits, penalty chosen over five folds, metrics per fold side."""
    price = table(spark, sf, "part").select(F.col("p_partkey").alias("mol_id"), F.col("p_retailprice").cast("double").alias("label"))
    bits = S.fingerprint(S.mol_graph(v_env(spark, sf))).select("mol_id", "bits").join(price, "mol_id")
    rows = materialise(bits.withColumn("fold", F.pmod(F.col("mol_id") * 7919 + 42, F.lit(5)).cast("int")), "ridge-bits")
    weights, alpha, _ = M.ridge_on_bits(rows, "bits", "label", 1024, "fold")
    scored = M.predict_bits(weights, rows, "bits").withColumn("part_set", F.concat(F.lit("fold "), F.col("fold").cast("string")))
    return regression_metrics(scored, "label", "prediction", ["part_set"]).withColumn("alpha", F.lit(alpha))


@query("tree_sweep", "I4 I13")
def q_tree_sweep(spark, sf):
    train, test = sides(spark, sf)
    rows = M.sweep_tree(train, test, FEATURES)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "depth int, nodes int, train_r2 double, test_r2 double, gap double")


def forest_of(spark, sf, folds: int):
    """The forest of the survey: 200 trees without a limit of depth that matters, and as many per fold."""
    rows = v_feat(spark, sf).select(*FEATURES, "label", "part_set", F.xxhash64(*KEY).alias("drawn_by"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    if folds:
        rows = kfold(rows, folds, "k")
    return forest(rows, FEATURES, "label", F.col("drawn_by"), F.col("part_set") == "train", trees=200, depth=30, fold="fold" if folds else None, folds=folds,
                  keep=["label", "part_set"])


@query("forest_scores", "I5 I13 E10 E11")
def q_forest_scores(spark, sf):
    """Metrics of the train and test rows, and of the held-out rows of each of five folds."""
    scored, _ = forest_of(spark, sf, 5)
    part = F.when(F.col("fit") == 0, F.col("part_set")).otherwise(F.concat(F.lit("fold "), F.col("fit").cast("string")))
    return regression_metrics(scored.withColumn("part_set", part), "label", "prediction", ["part_set"])


@query("importance_stats", "E15 I5")
def q_importance_stats(spark, sf):
    """Statistics of the forest's importances, which add up to 1."""
    _, importances = forest_of(spark, sf, 0)
    x = F.col("importance")
    wide = importances.agg(F.avg(x).alias("mean"), F.max(x).alias("max"), F.min(x).alias("min"), F.avg(F.abs(x)).alias("mean_abs"),
                           F.count_if(x != 0).cast("double").alias("nonzero"), F.sum(x).alias("sum"))
    return wide.unpivot([], wide.columns, "statistic", "value")


@query("boosting_scores", "I6 I13")
def q_boosting_scores(spark, sf):
    train, test = sides(spark, sf)
    return M.evaluate_split(M.fit_gbt(train, FEATURES), train, test, FEATURES)


@query("deep_boosting_scores", "I7 I13 E10 E15")
def q_deep_boosting_scores(spark, sf):
    """200 trees of depth 6, rows and columns 0.8, L1 0.1, L2 1.0: metrics, with the largest importance beside them."""
    scored, _, importances = boost(v_feat(spark, sf), FEATURES, "label", KEY, F.col("part_set") == "train")
    top = max(importances, key=lambda c: (importances[c], c))
    metrics = regression_metrics(scored, "label", "prediction", ["part_set"])
    return metrics.withColumns({"top_feature": F.lit(top), "top_importance": F.lit(importances[top])})


@query("logistic_weights", "I9 E15")
def q_logistic_weights(spark, sf):
    lab = v_lab(spark, sf).withColumn("label", yes_no("water_soluble"))
    return M.fit_weights(lab, ["x", "score"])[2]


@query("pooled_accuracy", "I10 E9")
def q_pooled_accuracy(spark, sf):
    lab = v_lab(spark, sf).withColumn("label", yes_no("water_soluble"))

    def fit(train):
        model, scaler, _ = M.fit_weights(train, ["x", "score"])
        return lambda df: M.predict(model, scaler.transform(df), scaler.columns).withColumn("prediction", F.col("prediction").cast("int"))
    return accuracy(M.cross_validate(lab, fit, "fold", 10), "label", "prediction")


# A small perceptron, 64 inputs, 4 and 2 hidden units.
def _small(rows: int, columns: int, shift: int) -> np.ndarray:
    return np.array([[((i * 7 + j * 3 + shift) % 11 - 5) / 10 for j in range(columns)] for i in range(rows)])


SMALL = [M.Layer(_small(4, 64, 0), _small(1, 4, 1)[0]), M.Layer(_small(2, 4, 2), _small(1, 2, 3)[0]), M.Layer(_small(1, 2, 4), _small(1, 1, 5)[0])]


def _dot(weights, value: str) -> str:
    return " + ".join(f"({w!r}) * {value % j}" for j, w in enumerate(weights.tolist()))


def _layer(layer, value: str, relu: bool) -> list[str]:
    lines = [f"({_dot(w, value)} + ({b!r}))" for w, b in zip(layer.w, layer.b.tolist())]
    return [f"greatest(0, {x})" for x in lines] if relu else lines


_H1 = ", ".join(f"{e} AS a{i}" for i, e in enumerate(_layer(SMALL[0], "CAST(embedding[%d + 1] AS DOUBLE)", True)))
_H2 = ", ".join(f"{e} AS b{i}" for i, e in enumerate(_layer(SMALL[1], "a%d", True)))


@query("perceptron_scores", "I11", sql=f"""WITH h AS (SELECT vec_id, {_H1} FROM embeddings), g AS (SELECT vec_id, {_H2} FROM h)
SELECT vec_id, round({_layer(SMALL[2], 'b%d', False)[0]}, 6) AS prediction FROM g""")
def q_perceptron_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    return M.score_mlp(e, SMALL, "embedding", "vec_id").withColumn("prediction", F.round("prediction", 6))


@query("perceptron_losses", "I12")
def q_perceptron_losses(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("y", F.col("label").cast("double"))
    _, losses = M.fit_mlp(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "embedding", "y", (64, 512, 256, 1))
    return spark.createDataFrame([(i, x) for i, x in enumerate(losses)], "epoch int, loss double")

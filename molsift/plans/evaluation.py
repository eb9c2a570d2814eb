"""Splits, folds and scores on ``v_lab``, ``v_feat``, ``orders`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import threshold_label, verdict, yes_no
from ..operators import evaluation as E
from ..operators import splits as S
from ..operators.models import attach
from ..operators.molecules import dedupe_first
from ..operators.reports import adaptive_bins, bin_counts, group_mean, histogram
from ..operators.scoring import composite_score, score_features
from ..sources.views import table, v_feat, v_lab, v_score
from .registry import query

R6 = 6


def labelled(spark, sf):
    lab = v_lab(spark, sf)
    return lab.withColumns({"label": yes_no("water_soluble"), "pred": (F.col("score") >= 0.5).cast("int")})


LAB = "lab AS (SELECT *, CASE WHEN trim(water_soluble) = 'Yes' THEN 1 ELSE 0 END AS label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM v_lab)"


@query("label_text", "B11 B12", sql=f"WITH {LAB} SELECT doc_id, label, CASE WHEN score >= 0.5 THEN 'Yes' ELSE 'No' END AS said FROM lab")
def q_label_text(spark, sf):
    return labelled(spark, sf).select("doc_id", "label", threshold_label("score").alias("said"))


@query("four_term_score", "B9 B6 B7", sql="""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, hba, -logp AS a, hbd + hba AS b, logs AS c, CAST(l_partkey % 11 AS DOUBLE) AS d FROM v_score),
m AS (SELECT avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc, avg(d) md, stddev_pop(d) sd FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(-0.5 + 0.1 * (a - ma) / sa + 0.2 * (b - mb) / sb + 0.3 * (c - mc) / sc - 0.4 * (d - md) / sd, 6) AS s FROM f, m""")
def q_four_term_score(spark, sf):
    v = score_features(v_score(spark, sf)).withColumn("delta", (F.col("l_partkey") % 11).cast("double"))
    weights = {"neg_logp": 0.1, "hbd_hba": 0.2, "logs": 0.3, "delta": -0.4}
    out = composite_score(v, weights, -0.5, score_col="s")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("s", R6).alias("s"))


@query("complete_rows", "B4", sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, hbd FROM v_score WHERE hbd IS NOT NULL AND logs IS NOT NULL")
def q_complete_rows(spark, sf):
    rows, _ = S.drop_missing(v_score(spark, sf), ["hbd", "logs"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "hbd")


@query("mean_per_key", "E5", sql="SELECT l_partkey, round(avg(label), 6) AS mean_target, count(*) AS n FROM v_feat GROUP BY l_partkey")
def q_mean_per_key(spark, sf):
    return group_mean(v_feat(spark, sf), "l_partkey", "label").withColumn("mean_target", F.round("mean_target", R6))


def _bins_sql(n):
    return f"""WITH r AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders),
 b AS (SELECT least(CAST(floor((o_totalprice - lo) * {n}.0 / (hi - lo)) AS INT), {n - 1}) AS bin FROM orders, r)
SELECT i.bin, coalesce(c.n, 0) AS count FROM (SELECT CAST(range AS INT) AS bin FROM range({n})) i LEFT JOIN (SELECT bin, count(*) n FROM b GROUP BY bin) c ON i.bin = c.bin"""


@query("price_bins", "E6", sql=_bins_sql(7))
def q_price_bins(spark, sf):
    return bin_counts(table(spark, sf, "orders"), "o_totalprice", 7).select("bin", "count")


@query("price_histogram", "E8", sql=_bins_sql(20))
def q_price_histogram(spark, sf):
    return histogram(table(spark, sf, "orders"), "o_totalprice").select("bin", "count")


@query("price_bin_count", "E7", sql="""WITH r AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders),
 e AS (SELECT k, least(CAST(floor((o_totalprice - lo) * k / (hi - lo)) AS INT), k - 1) AS b FROM orders, r, (VALUES (5), (4), (3), (2)) t(k)),
 p AS (SELECT k, b, count(*) c FROM e GROUP BY k, b), g AS (SELECT k, min(c) mc, count(*) nb FROM p GROUP BY k)
SELECT max(k) AS n_bins FROM g WHERE mc >= 2 AND nb = k""")
def q_price_bin_count(spark, sf):
    return adaptive_bins(table(spark, sf, "orders"), "o_totalprice")


@query("confusion_by_fold", "E9", sql=f"""WITH {LAB}, f AS (SELECT DISTINCT fold FROM lab)
SELECT f.fold, y.v AS label, p.v AS pred, count(lab.doc_id) AS n FROM f CROSS JOIN (VALUES (0), (1)) y(v) CROSS JOIN (VALUES (0), (1)) p(v)
LEFT JOIN lab ON lab.fold = f.fold AND lab.label = y.v AND lab.pred = p.v GROUP BY ALL""")
def q_confusion_by_fold(spark, sf):
    return E.confusion(labelled(spark, sf), "label", "pred", ["fold"])


@query("accuracy_by_fold", "E9", sql=f"WITH {LAB} SELECT fold, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM lab GROUP BY fold")
def q_accuracy_by_fold(spark, sf):
    return E.accuracy(labelled(spark, sf), "label", "pred", ["fold"]).withColumn("accuracy", F.round("accuracy", R6))


@query("accuracy_over_folds", "E11", sql=f"""WITH {LAB}, a AS (SELECT fold, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM lab GROUP BY fold)
SELECT round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std, count(*) AS folds FROM a""")
def q_accuracy_over_folds(spark, sf):
    s = E.fold_summary(E.accuracy(labelled(spark, sf), "label", "pred", ["fold"]), "accuracy")
    return s.withColumns({c: F.round(c, R6) for c in ("mean", "std")})


METRICS_SQL = """SELECT part_set, round(avg((label - f1) * (label - f1)), 6) AS mse, round(avg(abs(label - f1)), 6) AS mae,
 count(*) AS n, round(1 - avg((label - f1) * (label - f1)) / var_pop(label), 6) AS r2 FROM v_feat GROUP BY part_set"""


@query("regression_scores", "E10", sql=METRICS_SQL)
def q_regression_scores(spark, sf):
    m = E.regression_metrics(v_feat(spark, sf), "label", "f1", ["part_set"])
    return m.withColumns({c: F.round(c, R6) for c in ("mse", "mae", "r2")})


@query("fit_verdict", "I14 E10", sql=f"""WITH m AS ({METRICS_SQL.replace('round(', '(').replace(', 6)', ')')}),
 w AS (SELECT max(CASE WHEN part_set = 'train' THEN r2 END) AS tr, max(CASE WHEN part_set = 'test' THEN r2 END) AS te FROM m)
SELECT CASE WHEN tr > 0.85 THEN 'good' WHEN tr > 0.7 THEN 'average' ELSE 'poor' END AS fit, CASE WHEN te > 0.6 THEN 'good' ELSE 'poor' END AS generalises,
 round(tr - te, 6) AS gap FROM w""")
def q_fit_verdict(spark, sf):
    m = E.regression_metrics(v_feat(spark, sf), "label", "f1", ["part_set"])
    w = m.agg(*[F.max(F.when(F.col("part_set") == p, F.col("r2"))).alias(p) for p in ("train", "test")])
    return w.select(verdict("train", "test").alias("v"), F.round(F.col("train") - F.col("test"), R6).alias("gap")).select("v.*", "gap")


ROC = f"""{LAB}, c AS (SELECT fold, score, sum(label) p, sum(1 - label) n FROM lab GROUP BY fold, score),
 cum AS (SELECT fold, score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY fold) AS tp_all, sum(n) OVER (PARTITION BY fold) AS fp_all
 FROM c WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 roc AS (SELECT fold, score, p, n, CAST(tp AS BIGINT) tp, CAST(fp AS BIGINT) fp, CASE WHEN tp_all > 0 THEN tp / tp_all END AS tpr, CASE WHEN fp_all > 0 THEN fp / fp_all END AS fpr FROM cum)"""


def roc(spark, sf):
    return E.roc_curve(labelled(spark, sf), "label", "score", "fold")


@query("roc_points", "E12 F6", sql=f"WITH {ROC} SELECT fold, score, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc")
def q_roc_points(spark, sf):
    return roc(spark, sf).select("fold", "score", "tp", "fp", F.round("tpr", R6).alias("tpr"), F.round("fpr", R6).alias("fpr"))


@query("roc_auc", "E12", sql=f"""WITH {ROC}, s AS (SELECT fold, tpr, fpr, lag(tpr, 1, 0) OVER w AS t0, lag(fpr, 1, 0) OVER w AS f0 FROM roc WINDOW w AS (PARTITION BY fold ORDER BY score DESC))
SELECT fold, round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM s GROUP BY fold""")
def q_roc_auc(spark, sf):
    return E.auc(roc(spark, sf), "fold").withColumn("auc", F.round("auc", R6))


MEAN_ROC = f"""{ROC}, pts AS (SELECT fold, fpr, max(tpr) AS hi, min(tpr) AS lo FROM (SELECT fold, fpr, tpr FROM roc UNION ALL SELECT DISTINCT fold, 0.0, 0.0 FROM roc) GROUP BY fold, fpr),
 g AS (SELECT DISTINCT fold, CAST(r.range AS DOUBLE) / 99.0 AS x FROM roc, range(100) r),
 b AS (SELECT g.fold, g.x, max(a.fpr) AS x0, arg_max(a.hi, a.fpr) AS y0 FROM g JOIN pts a ON a.fold = g.fold AND a.fpr <= g.x GROUP BY g.fold, g.x),
 nx AS (SELECT g.fold, g.x, min(a.fpr) AS x1, arg_min(a.lo, a.fpr) AS y1 FROM g LEFT JOIN pts a ON a.fold = g.fold AND a.fpr > g.x GROUP BY g.fold, g.x),
 i AS (SELECT b.fold, b.x, CASE WHEN x1 IS NULL OR x0 = b.x THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (b.x - x0) END AS y FROM b JOIN nx ON b.fold = nx.fold AND b.x = nx.x),
 mean AS (SELECT x AS fpr, CASE WHEN x = 0 THEN 0.0 WHEN x = 1 THEN 1.0 ELSE avg(y) END AS tpr, stddev_pop(y) AS std FROM i GROUP BY x)"""


@query("mean_roc", "E13 F7", sql=f"WITH {MEAN_ROC} SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(std, 6) AS std FROM mean")
def q_mean_roc(spark, sf):
    m = E.mean_roc(roc(spark, sf), "fold")
    return m.select(*[F.round(c, R6).alias(c) for c in ("fpr", "tpr", "std")])


@query("mean_roc_auc", "E13", sql=f"""WITH {MEAN_ROC}, s AS (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM mean WINDOW w AS (ORDER BY fpr))
SELECT round(sum(a), 6) AS auc FROM s""")
def q_mean_roc_auc(spark, sf):
    return E.mean_auc(E.mean_roc(roc(spark, sf), "fold")).withColumn("auc", F.round("auc", R6))


@query("brand_numbers", "F1", sql="""SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY f) - 1 AS mol_number FROM (SELECT p_partkey, p_brand, min(p_partkey) OVER (PARTITION BY p_brand) AS f FROM part) t""")
def q_brand_numbers(spark, sf):
    return S.assign_ids(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


@query("contiguous_folds", "F2", sql="SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS fold FROM orders")
def q_contiguous_folds(spark, sf):
    return S.kfold(table(spark, sf, "orders").select("o_orderkey"), 7, "o_orderkey")


@query("stratified_folds", "F3", sql=f"""WITH {LAB} SELECT doc_id, label, (row_number() OVER (PARTITION BY label ORDER BY (doc_id * 7919 + 42) % 1000003, doc_id) - 1) % 10 AS fold FROM lab""")
def q_stratified_folds(spark, sf):
    return S.stratified_kfold(labelled(spark, sf).select("doc_id", "label"), "label", 10, "doc_id")


@query("random_split", "F4", sql="SELECT o_orderkey, CASE WHEN (o_orderkey * 7919 + 42) % 100 < 20 THEN 'test' ELSE 'train' END AS part_set FROM orders")
def q_random_split(spark, sf):
    return S.random_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("stratified_split", "F5", sql="""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey * 7919 + 42) % 1000003, o_orderkey) AS rn,
 count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part_set FROM r""")
def q_stratified_split(spark, sf):
    return S.stratified_split(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


@query("group_split", "F8 D6", sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN (l_partkey * 7919 + 42) % 100 < 20 THEN 'test' ELSE 'train' END AS side FROM v_feat""")
def q_group_split(spark, sf):
    train, test = S.group_split(v_feat(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_partkey")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


BINS_SQL = "least(CAST(floor((m - lo) * n / (hi - lo)) AS INT), n - 1)"


@query("stratified_group_split", "F8 E5 E7 F5 D6 H4", sql=f"""WITH k AS (SELECT l_partkey, sum(f1) / count(*) AS m, count(*) AS n_rows FROM v_feat GROUP BY l_partkey),
r AS (SELECT min(m) AS lo, max(m) AS hi FROM k),
c AS (SELECT n, b, count(*) AS c FROM (SELECT n, {BINS_SQL} AS b FROM k, r, (VALUES (5), (4), (3), (2)) t(n)) GROUP BY n, b),
w AS (SELECT max(n) AS n FROM (SELECT n FROM c GROUP BY n HAVING min(c) >= 2 AND count(*) = n)),
s AS (SELECT l_partkey, n_rows, {BINS_SQL} AS b FROM k, r, w),
t AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY (l_partkey * 7919 + 42) % 1000003, l_partkey) AS rn, count(*) OVER (PARTITION BY b) AS c FROM s)
SELECT l_partkey, CASE WHEN rn <= floor(c * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS side, n_rows, 0 AS n_both
FROM t""")
def q_stratified_group_split(spark, sf):
    """Side and rows of every key, and how many keys are on both sides."""
    train, test = S.stratified_group_split(v_feat(spark, sf), "l_partkey", "f1")
    both = S.overlap(train, test, "l_partkey").count()
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("l_partkey", "side").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_both", F.lit(both))


@query("split_overlap", "H4", sql="""SELECT l_suppkey FROM (SELECT l_suppkey FROM v_feat WHERE part_set = 'train' INTERSECT SELECT l_suppkey FROM v_feat WHERE part_set = 'test') t""")
def q_split_overlap(spark, sf):
    f = v_feat(spark, sf)
    return S.overlap(f.where("part_set = 'train'"), f.where("part_set = 'test'"), "l_suppkey")


@query("first_order", "H3", sql="""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) t WHERE rn = 1""")
def q_first_order(spark, sf):
    return dedupe_first(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("attached", "D7", sql="""WITH p AS (SELECT l_partkey, round(avg(f1), 6) AS prediction FROM v_feat WHERE part_set = 'train' GROUP BY l_partkey)
SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, f.l_suppkey, p.prediction FROM v_feat f LEFT JOIN p ON f.l_partkey = p.l_partkey WHERE f.part_set = 'test'""")
def q_attached(spark, sf):
    """Means of the training rows as predictions made elsewhere; test keys without one keep NULL."""
    f = v_feat(spark, sf)
    means = group_mean(f.where("part_set = 'train'"), "l_partkey", "f1", "prediction").select("l_partkey", F.round("prediction", R6).alias("prediction"))
    return attach(f.where("part_set = 'test'"), means, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "prediction")

"""Forest and boosting against plain versions on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molsift.operators import trees as T

COLS = ["a", "b", "c"]


def table(spark, n=400, seed=3, noise=0.1):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.integers(0, 20)), float(rng.normal()), float(rng.integers(0, 2)), None) for i in range(n)]
    rows = [(i, a, b, c, float(3 * (a > 9) + b * c + noise * rng.normal()), bool(i % 4), i % 3) for i, a, b, c, _ in rows]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, learn boolean, fold int").repartition(3), rows


def plain_tree(x, y, w, depth):
    """All features, one node at a time."""
    value, gain = np.zeros(len(y)), np.zeros(x.shape[1])

    def split(rows, left):
        s, t = w[rows].sum(), (w[rows] * y[rows]).sum()
        value[rows] = t / s
        best = (1e-9, None)
        for f in range(x.shape[1]) if left else ():
            for cut in sorted(set(x[rows[w[rows] > 0], f].tolist()))[:-1]:
                go = x[rows, f] <= cut
                lw, lt = w[rows[go]].sum(), (w[rows[go]] * y[rows[go]]).sum()
                g = lt ** 2 / lw + (t - lt) ** 2 / (s - lw) - t ** 2 / s
                if g > best[0] + 1e-9 * max(1, best[0]):
                    best = (g, (f, cut))
        if best[1]:
            f, cut = best[1]
            gain[f] += best[0]
            go = x[rows, f] <= cut
            split(rows[go], left - 1)
            split(rows[~go], left - 1)

    split(np.arange(len(y)), depth)
    return value, gain


@pytest.mark.parametrize("depth", [0, 1, 3, 30])
def test_tree_grown_by_levels(depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 12, (200, 3)).astype(np.uint8)
    y, w = rng.normal(size=200) + (x[:, 0] > 5), rng.poisson(1.0, 200).astype(float)
    value, gain = T.grow(x, y, w, depth, 3, rng)
    want, want_gain = plain_tree(x, y, w, depth)
    some = w > 0  # in small nodes two features may split equally well, which matters only to rows of weight 0
    assert np.allclose(value[some], want[some]) and np.isclose(gain.sum(), want_gain.sum())


def test_full_tree_keeps_the_labels_it_saw():
    rng = np.random.default_rng(0)
    x, y = rng.permutation(250)[:, None].astype(np.uint8), rng.normal(size=250)
    assert np.allclose(T.grow(x, y, np.ones(250), 300, 1, rng)[0], y)


def metrics(spark, scored):
    r = scored.select("y", "prediction", "learn", "fit", "fold").toPandas()
    one = r[(r.fit == 0) & ~r.learn]
    return 1 - ((one.y - one.prediction) ** 2).mean() / one.y.var(), r


def test_forest_learns_and_scores_every_row_once(spark):
    df, rows = table(spark)
    scored, importances = T.forest(df, COLS, "y", ["id"], F.col("learn"), trees=30, fold="fold", folds=3, at_once=7)
    r2, r = metrics(spark, scored)
    assert r2 > 0.8
    assert (r.fit == 0).sum() == len(rows)
    for i in (1, 2, 3):
        assert (r[r.fit == i].fold == i - 1).all() and (r.fit == i).sum() == sum(x[6] == i - 1 for x in rows)
    shares = {(x["fit"], x["feature"]): x["importance"] for x in importances.collect()}
    for fit in range(4):
        assert abs(sum(shares[fit, c] for c in COLS) - 1) < 1e-9
        assert max(COLS, key=lambda c: shares[fit, c]) == "a"


def test_forest_split_by_aggregates_first(spark):
    """Nodes of more than a few rows are split by histograms of all tasks; what is left is grown below."""
    df, rows = table(spark, 300)
    scored, importances = T.forest(df, COLS, "y", ["id"], F.col("learn"), trees=12, fold="fold", folds=1, in_task=80)
    r2, r = metrics(spark, scored)
    assert r2 > 0.75
    assert (r.fit == 0).sum() == len(rows) and (r.fit == 1).sum() == sum(x[6] == 0 for x in rows)
    shares = importances.where("fit = 0").collect()
    assert abs(sum(x["importance"] for x in shares) - 1) < 1e-9


def test_forest_by_aggregates_is_the_tree_of_one_task(spark):
    """With all features at every node, where the tree is split off doesn't matter."""
    df, _ = table(spark, 200)
    both = [T.forest(df, COLS, "y", ["id"], F.col("learn"), trees=3, depth=2, mtry=3, in_task=n)[0].select("id", "prediction").toPandas().sort_values("id") for n in (10_000, 40)]
    assert np.allclose(both[0].prediction, both[1].prediction)


def test_forest_without_rows(spark):
    df, _ = table(spark, 4)
    scored, _ = T.forest(df.where("a < 0"), COLS, "y", ["id"], F.col("learn"), trees=2)
    assert scored.collect() == []


def plain_boost(x, y, use, draw, trees, depth, eta, l1, l2, least):
    def soft(g):
        return np.sign(g) * max(abs(g) - l1, 0.0)

    score = np.full(len(y), y[use].mean())
    for t in range(trees):
        g, on = score - y, use & draw(t)
        new = np.zeros(len(y))

        def split(rows, left):
            mine = rows[on[rows]]
            gt, ht = g[mine].sum(), len(mine)
            new[rows] = -eta * soft(gt) / (ht + l2)
            best = (1e-6, None)
            for f in range(x.shape[1]) if left else ():
                for cut in range(int(x[:, f].max())):
                    go = x[mine, f] <= cut
                    hl, gl = go.sum(), g[mine[go]].sum()
                    if hl >= least and ht - hl >= least:
                        gain = soft(gl) ** 2 / (hl + l2) + soft(gt - gl) ** 2 / (ht - hl + l2) - soft(gt) ** 2 / (ht + l2)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, cut))
            if best[1]:
                f, cut = best[1]
                go = x[rows, f] <= cut
                split(rows[go], left - 1)
                split(rows[~go], left - 1)

        split(np.arange(len(y)), depth)
        score = score + new
    return score


@pytest.mark.parametrize("l1, l2", [(0.1, 1.0), (0.0, 0.0), (5.0, 20.0)])
def test_boosting_against_a_plain_version(spark, l1, l2):
    df, rows = table(spark, 150)
    cuts = [np.unique([r[1 + j] for r in rows])[:40] for j in range(3)]
    scored, made, importances = T.boost(df, COLS, "y", ["id"], F.col("learn"), trees=5, depth=3, columns=1.0, rows=0.7, l1=l1, l2=l2, keep_every=2, cuts=cuts)
    hashes = {r[0]: r[1] for r in df.select("id", F.xxhash64("id")).collect()}
    h = np.array([hashes[r[0]] for r in rows])
    x = np.stack([np.minimum(np.searchsorted(c, [r[1 + j] for r in rows]), len(c) - 1) for j, c in enumerate(cuts)], 1)
    want = plain_boost(x, np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), lambda t: T._mix(h, 42 * 1_000_003 + t) < 0.7, 5, 3, 0.1, l1, l2, 1)
    got = {r["id"]: r["prediction"] for r in scored.collect()}
    assert np.allclose([got[r[0]] for r in rows], want)
    assert len(made) == 5 and abs(sum(importances.values()) - 1) < 1e-9


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables written on the way."""
    rows, whole = {}, T.materialise

    def count(df, label):
        out = whole(df, label)
        rows.setdefault(label, []).append(out.count())
        return out
    monkeypatch.setattr(T, "materialise", count)
    return rows


def repeated(spark, n=2_000):
    """Many rows, 20 different rows of features."""
    return spark.range(n).select("id", *[F.pmod(F.col("id") / k, F.lit(m)).cast("int").cast("double").alias(c) for c, k, m in (("a", 1, 5), ("b", 5, 4), ("c", 1, 1))],
                                 (F.pmod(F.col("id"), F.lit(5)) + F.rand(1)).alias("y"), (F.col("id") % 4 > 0).alias("learn"), (F.col("id") % 2).cast("int").alias("fold"))


def test_no_table_holds_a_row_per_row_and_tree(spark, written):
    scored, importances = T.forest(repeated(spark), COLS, "y", ["id"], F.col("learn"), trees=10, fold="fold", folds=2, in_task=100)
    assert scored.groupBy("fit").count().orderBy("fit").collect() == [(0, 2_000), (1, 1_000), (2, 1_000)]
    assert max(n for rows in written.values() for n in rows) == 2_000
    assert importances.count() == 9


@pytest.mark.parametrize("in_task", [100, 7])
def test_forest_of_sums_is_the_forest_of_rows(spark, in_task):
    """Against trees grown row by row, with all features at every node."""
    df = repeated(spark, 300)
    got = T.forest(df, COLS, "y", ["id"], F.col("learn"), trees=3, depth=3, mtry=3, in_task=in_task)[0].toPandas().sort_values("id")
    hashes = {r[0]: r[1] for r in df.select("id", F.xxhash64("id")).collect()}
    h, x = np.array([hashes[i] for i in got["id"]]), np.stack([np.unique(got[c], return_inverse=True)[1] for c in COLS], 1).astype(np.uint8)
    y = got["y"].to_numpy()
    want = sum(plain_tree(x, y, np.where(got["learn"], np.searchsorted(T.POISSON, T._mix(h, 42 * 1_000_003 + t)), 0).astype(float), 3)[0] for t in range(3)) / 3
    assert np.allclose(got["prediction"], want)


def test_rows_of_equal_bins_are_added_up_in_one_chunk(spark):
    """However many chunks there are, the rows of bins that they add up are hardly more than the different ones; chunks are of equal size."""
    bins = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.pmod(F.col("id"), F.lit(500)))  # a third of all rows has the same bins
    rows = spark.range(20_000).select(F.substring(F.encode(F.format_string("%04d", bins), "UTF-8"), 1, 4).alias("_x"), F.col("id").cast("double").alias("y"), F.xxhash64("id").alias("h"),
                                      F.lit(1).cast("tinyint").alias("use"), F.lit(0).alias("fold"))
    chunked, vectors = T.dealt_by_bins(rows, rows_each=1_000)
    per = chunked.withColumn("part", F.spark_partition_id()).groupBy("chunk").agg(F.count("*").alias("n"), F.countDistinct("_x").alias("different"), F.countDistinct("part").alias("parts")).collect()
    assert vectors == 500 and len(per) == 20 and sum(r["n"] for r in per) == 20_000
    assert sum(r["different"] for r in per) <= 500 + 2 * 20 and max(r["n"] for r in per) < 1_200 and all(r["parts"] == 1 for r in per)


@pytest.mark.parametrize("n, m", [(0, 3), (1, 1), (1 << 14, 7), (50_000, 40_000)])
def test_bootstrap_counts_are_those_of_the_hashes(n, m):
    rng = np.random.default_rng(n)
    at, y, h = np.sort(rng.integers(0, m, n)), rng.normal(size=n), rng.integers(-1 << 63, (1 << 63) - 1, n)
    w, t = T.Bootstrap(at, y, h, m).sums(42_000_126)
    want = np.searchsorted(T.POISSON, T._mix(h, 42_000_126)).astype(float)
    assert np.array_equal(w, np.bincount(at, weights=want, minlength=m)) and np.allclose(t, np.bincount(at, weights=want * y, minlength=m))


def test_large_leaves_of_many_features_are_scored_once(spark):
    df, rows = table(spark, 300)
    scored, _ = T.forest(df.withColumn("y", F.lit(2.0)), COLS, "y", ["id"], F.col("learn"), trees=4, in_task=40)
    assert scored.where("abs(prediction - 2) < 1e-9").count() == len(rows)


def test_distinct_rows_of_few_and_many_bins():
    rng = np.random.default_rng(5)
    for d in (1, 4, 8, 11):
        x = rng.integers(0, 3, (200, d)).astype(np.uint8)
        found, at = T.distinct_rows(x)
        assert (found[at] == x).all() and found.tolist() == [list(r) for r in sorted(set(map(tuple, x.tolist())))]


def test_boosting_needs_no_job_per_level(spark):
    sc = spark.sparkContext
    sc.setJobGroup("boosting", "boosting")
    scored, made, _ = T.boost(repeated(spark), COLS, "y", ["id"], F.col("learn"), trees=30, depth=3)
    jobs = len(sc.statusTracker().getJobIdsForGroup("boosting"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(made) == 30 and scored.count() == 2_000 and jobs < 30


def test_boosting_by_levels_is_boosting_by_sums(spark):
    df, _ = table(spark, 150)
    both = [T.boost(df, COLS, "y", ["id"], F.col("learn"), trees=4, depth=3, keep_every=3, in_task=n) for n in (500_000, 10)]
    one, two = (b[0].select("id", "prediction").toPandas().sort_values("id") for b in both)
    assert np.allclose(one.prediction, two.prediction) and all(np.isclose(both[0][2][c], both[1][2][c]) for c in COLS)


def test_penalties_change_the_leaves_by_the_formula():
    g, h = np.array([[[-4.0, 6.0]]]), np.array([[[3.0, 5.0]]])
    gain, feature, cut = T.best_splits(g, h, 1.0, 2.0, 1.0)
    assert (feature[0], cut[0]) == (0, 0) and np.isclose(gain[0], 9 / 5 + 25 / 7 - 1 / 10)
    assert np.allclose(T.shrunk(np.array([-4.0, 0.5, 6.0]), 1.0), [-3.0, 0.0, 5.0])
    assert T.best_splits(g, h, 1.0, 2.0, 4.0)[0][0] == -np.inf  # a side of too few rows


def test_ridge_on_bits_solves_the_normal_equations(spark):
    from molsift.operators import models as M
    rng = np.random.default_rng(4)
    rows = [(i, sorted(rng.choice(40, rng.integers(0, 9), replace=False).tolist()), int(i % 3)) for i in range(300)]
    y = np.array([sum(b) / 10 + rng.normal() for _, b, _ in rows])
    df = spark.createDataFrame([(*r, float(v)) for r, v in zip(rows, y)], "id long, bits array<int>, fold int, y double").repartition(4)
    x = np.zeros((300, 41))
    x[:, 0] = 1
    for i, b, _ in rows:
        x[i, np.array(b, int) + 1] = 1
    folds, free = np.array([r[2] for r in rows]), np.diag([0.0] + [1.0] * 40)

    def solve(some, alpha):
        return np.linalg.solve(x[some].T @ x[some] + alpha * free, x[some].T @ y[some])

    weights, best, error = M.ridge_on_bits(df, "bits", "y", 40, "fold", (0.1, 1.0, 10.0))
    for alpha in error:
        want = np.mean([((y[folds == f] - x[folds == f] @ solve(folds != f, alpha)) ** 2).mean() for f in range(3)])
        assert np.isclose(error[alpha], want)
    assert best == min(error, key=error.get) and np.allclose(weights, solve(folds >= 0, best))
    got = {r["id"]: r["prediction"] for r in M.predict_bits(weights, df, "bits").select("id", "prediction").collect()}
    assert np.allclose([got[i] for i in range(300)], x @ weights)

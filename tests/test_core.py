"""Scans, scalar expressions, windows, Pareto fronts, notation, splits and models."""

import inspect

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from molsift.functions import notation
from molsift.functions import smiles as S
from molsift.functions.scalar import non_blank, strip_text
from molsift.operators import evaluation as E
from molsift.operators import models as M
from molsift.operators import splits as SP
from molsift.operators.fragments import distinct_products
from molsift.operators.molecules import benzene_filter, split_valid
from molsift.operators.pareto import front_mask, pareto_front
from molsift.operators.windows import global_row_number, rank_desc, running_sum
from molsift.plans import models as model_plans
from molsift.plans.molecules import GOLDENS
from molsift.session import materialise
from molsift.sources import tables as T

SF = "/root/testdata/sf0.01"


# --- scans and sinks

def test_encoding_is_found_and_wrong_ones_raise(spark, tmp_path):
    for enc, text in (("UTF-8", "naïve 漢字"), ("GBK", "漢字 聚合物"), ("ISO-8859-1", "café \xff")):
        path = tmp_path / f"{enc}.csv"
        path.write_bytes(f"name,x\n{text},1\n".encode(enc))
        found = T.detect_encoding(spark, str(path))
        assert found == enc
        assert T.read_text_table(spark, str(path), "name string, x int").collect()[0]["name"] == text
    with pytest.raises(ValueError):
        T.detect_encoding(spark, str(tmp_path / "ISO-8859-1.csv"), ["UTF-8", "GB18030"])


def test_lines_keep_repeats_and_drop_each_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("h,1,2\nCCO,1,2\nh,1,2\n\tC C ,3,4\nshort,1\n\"q\",\"x,y\"\n")
    (tmp_path / "b.txt").write_text("other,1,2\nCN,1,2\n")
    got = T.read_lines(spark, str(tmp_path)).collect()
    assert sorted(r["smiles"] for r in got) == ["\"q\"", "C C", "CCO", "CN", "h"]


def test_nan_becomes_null_and_tables_round_trip(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1.5,NaN\n2.5,3\n")
    df = T.read_table(spark, str(path), "a double, b double")
    assert [r["b"] for r in df.orderBy("a").collect()] == [None, 3.0]
    for fmt in ("parquet", "csv"):
        out = T.write_table(df, str(tmp_path / f"out-{fmt}"), fmt=fmt)
        back = T.read_table(spark, out, "a double, b double", fmt=fmt)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    sides = T.write_side_outputs({"good": df, "bad": df.limit(0)}, str(tmp_path / "side"))
    assert T.read_parts(spark, sides["bad"]).count() == 0
    with pytest.raises(T.MissingColumnsError):
        T.require_columns(df, ["a", "z"])
    assert T.pick_column(df, "z", "b") == "b"


def test_pairs_skip_the_first_line(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("anything,else\nCCO,1.5\nCC,n/a\n")
    assert [(r[0], r[1]) for r in T.read_pairs(spark, str(path)).collect()] == [("CCO", 1.5), ("CC", None)]


def test_signature_and_append(spark, tmp_path):
    df = spark.createDataFrame([("CCO", 1.5), ("é", None)], "smiles string, score double").coalesce(1)
    path = str(tmp_path / "sig")
    for n in (1, 2):
        T.write_table(df, path, fmt="csv", mode="append", signature=True)
        parts = sorted((tmp_path / "sig").glob("part-*"))
        assert len(parts) == n and all(p.read_bytes().startswith(b"\xef\xbb\xbfsmiles,score") for p in parts)
        back = T.read_table(spark, path, schema="smiles string, score double", fmt="csv")
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect() * n))
    with pytest.raises(ValueError):
        T.write_table(df, path, fmt="parquet", signature=True)


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([("\t a b \n",), (" \t",), (None,)], "x string")
    assert [r[0] for r in df.select(strip_text("x")).collect()] == ["a b", "", None]
    assert [r[0] for r in df.select(non_blank("x")).collect()] == [True, False, False]


def test_checkpoint_folder_is_the_sessions(spark):
    df = materialise(spark.range(3).toDF("id"), "t")
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]


# --- windows

@pytest.mark.parametrize("reuse", ["true", "false"])
def test_row_numbers_at_scale(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        d = spark.range(300_000).select(F.expr("(id * 7919) % 1000003").alias("v"), F.expr("concat('p', id)").alias("pay"), F.expr("id % 3").alias("g"))
        want = d.withColumn("e", F.row_number().over(Window.partitionBy("g").orderBy("v"))).select(F.col("v").alias("v2"), "e")
        got = global_row_number(d, ["v"], group_cols=["g"])
        assert got.join(want, F.col("v") == F.col("v2")).where("row_num <> e").count() == 0 and got.count() == 300_000
        r = rank_desc(d.select(F.expr("v % 500").alias("s"), "pay"), "s")
        e = d.select(F.expr("v % 500").alias("s"), "pay").withColumn("e", F.rank().over(Window.orderBy(F.desc("s")))).select(F.col("pay").alias("p2"), "e")
        assert r.join(e, F.col("pay") == F.col("p2")).where("rank <> e").count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_running_sum_with_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7)], "g string, o int, x int")
    assert {(r["g"], r["o"]): r["cum_x"] for r in running_sum(df, ["g"], ["o"], ["x"]).collect()} == {(None, 1): 5, (None, 2): 11, ("a", 1): 7}


# --- Pareto

@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 6)] * 3), min_size=1, max_size=60))
def test_front_kernel(points):
    x = np.array(points, float)
    want = [not any((q <= p).all() and (q < p).any() for q in x) for p in x]
    assert front_mask(x).tolist() == want


@pytest.mark.parametrize("shape", ["random", "opposed"])
def test_distributed_front(spark, shape):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, (1500, 3)).astype(float)
    if shape == "opposed":  # points near a plane: a large front
        x[:, 2] = 80 - x[:, 0] - x[:, 1]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, a double, b double, c double").repartition(5)
    want = {i for i, p in enumerate(x) if not any((q <= p).all() and (q < p).any() for q in x)}
    for k in (1, 5, 8):
        assert {r[0] for r in pareto_front(df, minimize=["a", "b", "c"], num_ranges=k).select("id").collect()} == want


# --- notation

@pytest.mark.parametrize("golden", [g for g in GOLDENS], ids=[g[0] or "empty" for g in GOLDENS])
def test_goldens_in_the_kernel(golden):
    text, status, atoms, bonds, *_, mw, hbd, hba = golden
    got, mol = notation.read(text)
    assert got == status
    if status is None:
        assert (len(mol.sym), len(mol.bonds)) == (atoms, bonds)
        flags = [mol.hydrogen_bonds(i) for i in range(len(mol.sym))]
        assert (sum(a for a, _ in flags), sum(b for _, b in flags)) == (hbd, hba)
        assert round(sum(notation.ATOMIC_MASS[s] + h * 1.008 for s, h in zip(mol.sym, mol.h)), 3) == pytest.approx(mw, abs=2e-3)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="CNOc1()=[]#%.-+H*", max_size=14))
def test_any_text_gets_a_status(text):
    status, mol = notation.read(text)
    assert (status is None) == (mol is not None)


def test_long_chain_and_split(spark):
    rows = [("C" * 2000,), ("C1CC",), (None,), ("c1ccccc1",)]
    df = spark.createDataFrame(rows, "smiles string")
    good, bad = split_valid(df)
    assert good.select(S.n_atoms()).agg(F.max("size(atoms)")).first()[0] == 2000
    assert {r["reason"] for r in bad.collect()} == {"Invalid SMILES", "SMILES is empty"}
    assert benzene_filter(spark.createDataFrame([("c1ccc2ccccc2c1",), ("CCO",), ("C[Si](C)C",), ("CS",)], "smiles string")).count() == 2


def test_equal_molecules_share_keys_and_bits(spark):
    same = [("OCC", "CCO"), ("c1ccccc1C", "Cc1ccccc1"), ("C1=CC=CC=C1", "c1ccccc1"), ("CC(=O)OCC", "CCOC(C)=O")]
    other = [("CCO", "COC"), ("CC(C)C", "CCCC"), ("c1ccccc1", "C1CCCCC1")]
    def pairs(rows):
        df = spark.createDataFrame([(i, s) for i, p in enumerate(rows) for s in p], "i int, smiles string")
        df = S.path_fingerprint(S.identity_key(S.fingerprint(S.mol_graph(df))))
        return df.groupBy("i").agg(*[F.count_distinct(c).alias(c) for c in ("mol_key", "bits", "path_bits")]).collect()
    assert all((r["mol_key"], r["bits"], r["path_bits"]) == (1, 1, 1) for r in pairs(same))
    assert all(r["mol_key"] == 2 and r["bits"] == 2 for r in pairs(other))


def test_keys_of_molecules_that_differ_far_from_the_ends(spark):
    rows = [(at, "C" * at + "C(O)" + "C" * (39 - at)) for at in (17, 18, 19)] + [(20, "C" * 19 + "C(O)" + "C" * 20), (100, "[Na+].[Cl-]"), (101, "C1CCCCC1"), (102, "C")]
    keys = {r["at"]: r["mol_key"] for r in S.identity_key(S.mol_graph(spark.createDataFrame(rows, "at int, smiles string"))).collect()}
    assert len(set(keys.values())) == 6 and keys[19] == keys[20]
    mirrored = spark.createDataFrame([("C" * 18 + "C(O)" + "C" * 21,), ("C" * 21 + "C(O)" + "C" * 18,), ("C" * 19 + "C(O)" + "C" * 20,)], "smiles string")
    assert distinct_products(S.mol_graph(mirrored)).count() == 2


# --- splits, scores, models

def test_splits(spark):
    df = spark.range(997).select("id", (F.col("id") % 7).alias("g"))
    train, test = SP.group_split(df, "g", 0.4)
    assert SP.overlap(train, test, "g").count() == 0 and train.count() + test.count() == 997
    sizes = sorted(r["count"] for r in SP.kfold(df, 5, "id").groupBy("fold").count().collect())
    assert sizes == [199, 199, 199, 200, 200]
    by = SP.stratified_kfold(df, "g", 10, "id").groupBy("g", "fold").count().collect()
    assert max(r["count"] for r in by) - min(r["count"] for r in by) <= 1
    rows, seen = SP.drop_missing(spark.createDataFrame([(1, None), (2, 3)], "a int, b int"), ["b"])
    assert rows.collect() == [(2, 3)] and seen.get == {"total": 2, "dropped": 1}


def test_interpolation_is_numpys(spark):
    x, y = [0.0, 0.0, 0.2, 0.5, 0.5, 1.0], [0.0, 0.1, 0.4, 0.5, 0.8, 1.0]
    pts = spark.createDataFrame([(1, a, b) for a, b in zip(x, y)], "f int, x double, y double")
    at = [0.0, 0.1, 0.35, 0.5, 0.75, 1.0]
    got = E.interpolate(pts, F.array(*[F.lit(v) for v in at]), "f", "x", "y").orderBy("x").collect()
    assert [r["y"] for r in got] == pytest.approx(list(np.interp(at, x, y)))


def test_ridge_solves_the_normal_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(*map(float, a), float(b), i % 5) for i, (a, b) in enumerate(zip(x, y))], "a double, b double, c double, label double, fold int")
    model, alpha, errors = M.fit_ridge_cv(df, ["a", "b", "c"], "fold")
    assert errors[alpha] == min(errors.values())
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-5)


def test_logistic_gradient_is_zero(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -1.0])))).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, label int")
    model, scaler, table = M.fit_weights(df, ["a", "b"])
    z = (x - x.mean(0)) / x.std(0)
    w = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(z @ w + model.intercept)))
    assert np.abs(z.T @ (p - y) + w / 10.0).max() < 1e-3
    assert [r["Feature"] for r in table.collect()] == ["a", "b"] and set(scaler.stats) == {"a", "b"}


def test_perceptron_gradient_and_training(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([([float(v) for v in a], float(a[0] - a[1])) for a in x], "x array<double>, y double").repartition(3)
    layers = M.initial_layers((4, 5, 3, 1))
    loss, grads, n = M.mlp_gradient(df, layers, "x", "y")
    assert n == 60
    rows = [(np.array(r["x"]), r["y"]) for r in df.collect()]
    def value():
        return np.mean([(M._forward(layers, a[None])[-1][0, 0] - b) ** 2 for a, b in rows])
    assert value() == pytest.approx(loss)
    for i, (r, c) in ((0, (1, 2)), (1, (0, 1)), (2, (0, 2))):
        layers[i].w[r, c] += 1e-6
        up = value()
        layers[i].w[r, c] -= 2e-6
        assert (up - value()) / 2e-6 == pytest.approx(grads[i].w[r, c], rel=1e-3, abs=1e-6)
        layers[i].w[r, c] += 1e-6
    _, losses = M.fit_mlp(df, df, "x", "y", (4, 5, 3, 1), epochs=6, rate=0.05)
    assert losses[-1] < losses[0]


def test_models_are_registered_with_the_listed_parameters(spark, monkeypatch):
    made = []

    class Stop(Exception):
        pass

    class Estimator:
        def __init__(self, **options):
            made.append(options)

        def fit(self, _):
            if "minInstancesPerNode" in made[-1]:
                return type("Tree", (), {"numNodes": 1})
            raise Stop

    for name in ("GBTRegressor", "DecisionTreeRegressor"):
        monkeypatch.setattr(M, name, Estimator)

    def stand_in(function):
        def run(*given, **options):
            bound = inspect.signature(function).bind(*given, **options)
            bound.apply_defaults()
            made.append(bound.arguments)
            raise Stop
        return run

    for name in ("forest", "boost"):
        monkeypatch.setattr(model_plans, name, stand_in(getattr(model_plans, name)))
    monkeypatch.setattr(M, "evaluate_split", lambda *_: spark.createDataFrame([("train", 0.5), ("test", 0.5)], "part_set string, r2 double"))
    found = entry.queries()
    for name in ("forest_scores", "importance_stats", "boosting_scores", "deep_boosting_scores"):
        with pytest.raises(Stop):
            found[name](spark, SF)
    assert [(o["trees"], o["depth"], o["folds"]) for o in made[:2]] == [(200, 30, 5), (200, 30, 0)]
    assert [made[2][k] for k in ("maxIter", "maxDepth", "subsamplingRate", "featureSubsetStrategy")] == [20, 3, 1.0, "all"]
    assert [made[3][k] for k in ("trees", "depth", "eta", "rows", "columns", "l1", "l2")] == [200, 6, 0.1, 0.8, 0.8, 0.1, 1.0]
    found["tree_sweep"](spark, SF)
    assert [o["maxDepth"] for o in made[4:]] == [5, 10, 15, 20, 30]
    monkeypatch.setattr(M, "mlp_gradient", lambda *_: (0.0, [M.Layer(np.zeros((1, 1)), np.zeros(1))] * 3, 1))
    monkeypatch.setattr(M, "initial_layers", lambda sizes, _: made.append(sizes) or [M.Layer(np.zeros((1, 1)), np.zeros(1))] * 3)
    losses = iter([1.0] * 99)
    monkeypatch.setattr(M, "score_mlp", lambda *_: type("Scored", (), {"agg": lambda self, _: type("Row", (), {"first": lambda self: [next(losses)]})()})())
    assert found["perceptron_losses"](spark, SF).count() == 31 and made[-1] == (64, 512, 256, 1)


# --- registered queries

def test_every_query_reads_a_table_and_has_unique_columns(spark):
    small = ["mol_status", "stotal_score", "pareto_breakthrough", "random_split", "stream_moments"]
    found = entry.queries()
    for name in small:
        df = found[name](spark, SF)
        assert len(set(df.columns)) == len(df.columns) and df.count() > 0
    assert set(entry.oracle_sql()) <= set(found)

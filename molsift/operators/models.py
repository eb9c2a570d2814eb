"""Models fitted and scored as Spark jobs.

Estimators are MLlib's; what the screening needs beyond them (population
scaling, ridge by sums, weights tables, pooled folds, an MLP) is here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .evaluation import regression_metrics
from .scoring import frozen_stats, zscore


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


@dataclass
class Scaler:
    """Means and population sigmas of a training set; a sigma of 0 counts as 1."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> "Scaler":
        return cls(frozen_stats(df, cols))

    def transform(self, df: DataFrame) -> DataFrame:
        return zscore(df, list(self.stats), stats=self.stats, prefix="z_")

    @property
    def columns(self) -> list[str]:
        return [f"z_{c}" for c in self.stats]


def fit_linear(train: DataFrame, cols: Sequence[str], label: str = "label", alpha: float = 0.0) -> Model:
    """Least squares, with a ridge penalty ``alpha`` on the sum of squared errors."""
    n = train.count() if alpha else 1
    est = LinearRegression(labelCol=label, regParam=alpha / n, elasticNetParam=0.0, standardization=False, solver="normal")
    return est.fit(assemble(train, cols))


def fit_ridge_cv(train: DataFrame, cols: Sequence[str], fold: str, alphas: Sequence[float] = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1e3),
                 label: str = "label") -> tuple[Model, float, dict[float, float]]:
    """Ridge with the penalty of the smallest mean squared error over folds, fitted again on all rows.

    One pass sums X'X, X'y and y'y per fold (sizes given by the columns); every
    penalty and fold is solved from these sums.
    """
    terms = ["_one", *cols]
    wide = train.withColumn("_one", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate(terms) for b in terms[i:]]
    sums = wide.groupBy(fold).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs],
                                  *[F.sum(F.col(a) * F.col(label)).alias(f"{a}*y") for a in terms],
                                  F.sum(F.col(label) * F.col(label)).alias("y*y")).orderBy(fold).collect()
    k = len(terms)
    xx, xy, yy = [], [], []
    for r in sums:
        m = np.zeros((k, k))
        for a, b in pairs:
            i, j = terms.index(a), terms.index(b)
            m[i, j] = m[j, i] = r[f"{a}*{b}"]
        xx.append(m)
        xy.append(np.array([r[f"{a}*y"] for a in terms]))
        yy.append(r["y*y"])
    free = np.diag([0.0] + [1.0] * len(cols))  # the intercept is not penalised
    error = {}
    for alpha in alphas:
        loss = []
        for i in range(len(sums)):
            w = np.linalg.solve(sum(xx) - xx[i] + alpha * free, sum(xy) - xy[i])
            loss.append((yy[i] - 2 * w @ xy[i] + w @ xx[i] @ w) / xx[i][0, 0])
        error[alpha] = float(np.mean(loss))
    best = min(error, key=lambda a: (error[a], a))
    return fit_linear(train, cols, label, best), best, error


def gram_of_bits(df: DataFrame, bits: str, label: str, n_bits: int, fold: str, stripe: int = 128, at_once: int = 4096) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per fold the sums X'X, X'y and y'y of on-bit arrays, an intercept first.

    Each task adds up block outer products and gives one row per fold and
    stripe of the matrix; stripes are summed by groups, so no group holds more
    than a stripe per task. What reaches the driver is (n_bits + 1)^2 numbers a
    fold, whatever the number of rows.
    """
    k = n_bits + 1

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, len(b), at_once):
                part = b.slice(at, at_once)
                flat, sizes = part.column(0).flatten().to_numpy(zero_copy_only=False), part.column(0).value_lengths().to_numpy(zero_copy_only=False)
                x = np.zeros((len(part), k + 1))
                x[:, 0], x[:, k] = 1.0, part.column(1).to_numpy(zero_copy_only=False)
                x[np.repeat(np.arange(len(part)), sizes), flat + 1] = 1.0
                folds = part.column(2).to_numpy(zero_copy_only=False)
                for f in np.unique(folds).tolist():
                    mine = x[folds == f]
                    sums[f] = sums.get(f, 0) + mine.T @ mine
        for f, m in sums.items():
            for s in range(0, k + 1, stripe):
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([s], pa.int32()), pa.array([m[s:s + stripe].tobytes()], pa.binary())], names=["fold", "stripe", "m"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.column("m").to_pylist())
        return pa.table({"fold": table.column("fold")[:1], "stripe": table.column("stripe")[:1], "m": pa.array([total.tobytes()], pa.binary())})

    rows = df.where(F.col(bits).isNotNull() & F.col(label).isNotNull()).select(bits, F.col(label).cast("double"), F.col(fold).cast("int"))
    schema = "fold int, stripe int, m binary"
    parts: dict[int, dict[int, bytes]] = {}
    for r in rows.mapInArrow(run, schema).groupBy("fold", "stripe").applyInArrow(add, schema).collect():
        parts.setdefault(r["fold"], {})[r["stripe"]] = bytes(r["m"])
    out = {}
    for f, stripes in sorted(parts.items()):
        m = np.frombuffer(b"".join(stripes[s] for s in sorted(stripes)), np.float64).reshape(k + 1, k + 1)
        out[f] = (m[:k, :k], m[:k, k], float(m[k, k]))
    return out


def ridge_on_bits(df: DataFrame, bits: str, label: str, n_bits: int, fold: str,
                  alphas: Sequence[float] = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1e3)) -> tuple[np.ndarray, float, dict[float, float]]:
    """I3 on fingerprints: weights (intercept first), the penalty of the smallest squared error over folds, and all errors.

    The intercept is not penalised; every penalty and fold is solved from the
    sums of one pass, and the weights are those of all rows.
    """
    sums = gram_of_bits(df, bits, label, n_bits, fold)
    xx, xy = sum(s[0] for s in sums.values()), sum(s[1] for s in sums.values())
    free = np.diag([0.0] + [1.0] * n_bits)
    error = {}
    for alpha in alphas:
        loss = []
        for gx, gy, yy in sums.values():
            w = np.linalg.lstsq(xx - gx + alpha * free, xy - gy, rcond=None)[0] if len(sums) > 1 else np.linalg.lstsq(xx + alpha * free, xy, rcond=None)[0]
            loss.append((yy - 2 * w @ gy + w @ gx @ w) / gx[0, 0])
        error[alpha] = float(np.mean(loss))
    best = min(error, key=lambda a: (error[a], a))
    return np.linalg.lstsq(xx + best * free, xy, rcond=None)[0], best, error


def predict_bits(weights: np.ndarray, df: DataFrame, bits: str, out: str = "prediction") -> DataFrame:
    """Intercept plus the weights of the on-bits; the weights are one literal array."""
    table = F.array(*[F.lit(float(w)) for w in weights[1:]])
    return df.withColumn("_w", table).withColumn(out, F.aggregate(bits, F.lit(float(weights[0])), lambda s, i: s + F.get(F.col("_w"), i))).drop("_w")


def predict(model: Model, df: DataFrame, cols: Sequence[str], out: str = "prediction") -> DataFrame:
    """The rows with their prediction as one more column; no join."""
    return model.transform(assemble(df, cols)).select(*df.columns, F.col(model.getPredictionCol()).alias(out))


def attach(df: DataFrame, predictions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predictions made elsewhere, joined back by key; rows without one keep NULL."""
    return df.join(predictions, list(key), "left")


def evaluate_split(model: Model, train: DataFrame, test: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    """Metrics of the train and of the test rows, and the gap of their r2."""
    both = predict(model, train, cols).withColumn("part_set", F.lit("train")).unionByName(predict(model, test, cols).withColumn("part_set", F.lit("test")))
    return regression_metrics(both, label, "prediction", ["part_set"])


def sweep_tree(train: DataFrame, test: DataFrame, cols: Sequence[str], depths=(5, 10, 15, 20, 30), label: str = "label", max_gap: float = 0.1) -> list[dict]:
    """I4: one tree per depth: depth, nodes, train and test r2, their gap; the chosen one first.

    Chosen is the best test r2 among trees whose gap is at most ``max_gap``, or of all if none is.
    """
    out = []
    for depth in depths:
        tree = DecisionTreeRegressor(labelCol=label, maxDepth=depth, minInstancesPerNode=5, seed=42).fit(assemble(train, cols))
        r2 = {r["part_set"]: r["r2"] for r in evaluate_split(tree, train, test, cols, label).collect()}
        out.append({"depth": depth, "nodes": tree.numNodes, "train_r2": r2["train"], "test_r2": r2["test"], "gap": r2["train"] - r2["test"]})
    return sorted(out, key=lambda r: (r["gap"] > max_gap, -r["test_r2"]))


def fit_gbt(train: DataFrame, cols: Sequence[str], label: str = "label", trees: int = 20, depth: int = 3, eta: float = 0.1,
            rows: float = 1.0, columns: str = "all", seed: int = 42) -> Model:
    """Gradient boosting; with penalties on the leaves (I7) it is ``trees.boost``."""
    return GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=eta, subsamplingRate=rows,
                        featureSubsetStrategy=columns, seed=seed).fit(assemble(train, cols))


def weight_stats(values: Sequence[float]) -> dict[str, float]:
    """Summary of coefficients or importances."""
    v = np.asarray(values, float)
    return {"mean": float(v.mean()), "max": float(v.max()), "min": float(v.min()), "mean_abs": float(np.abs(v).mean()), "nonzero": int((v != 0).sum())}


def fit_weights(train: DataFrame, cols: Sequence[str], label: str = "label", c: float = 10.0) -> tuple[Model, Scaler, DataFrame]:
    """Logistic regression on z-scored features, with the table Feature, Weight, Absolute (largest first)."""
    scaler = Scaler.fit(train, cols)
    x = assemble(scaler.transform(train), scaler.columns)
    model = LogisticRegression(labelCol=label, regParam=1.0 / (c * x.count()), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(x)
    rows = sorted(((f, float(w), abs(float(w))) for f, w in zip(cols, model.coefficients)), key=lambda r: -r[2])
    return model, scaler, train.sparkSession.createDataFrame(rows, "Feature string, Weight double, Absolute double")


def cross_validate(df: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], fold: str, k: int) -> DataFrame:
    """Each fold scored by what ``fit`` returns for the other folds; all predictions pooled."""
    df = materialise(df, "folds")
    out = None
    for i in range(k):
        part = fit(df.where(F.col(fold) != i))(df.where(F.col(fold) == i))
        out = part if out is None else out.unionByName(part)
    return out


# --- multi-layer perceptron -----------------------------------------------------

@dataclass
class Layer:
    """A linear layer; normalisation over the batch is folded into it for scoring."""

    w: np.ndarray  # outputs x inputs
    b: np.ndarray

    @classmethod
    def folded(cls, w, b, mean, var, gamma, beta, eps: float = 1e-5) -> "Layer":
        scale = np.asarray(gamma) / np.sqrt(np.asarray(var) + eps)
        return cls(np.asarray(w) * scale[:, None], (np.asarray(b) - mean) * scale + beta)


def _forward(layers: Sequence[Layer], x: np.ndarray) -> list[np.ndarray]:
    steps = [x]
    for i, layer in enumerate(layers):
        x = x @ layer.w.T + layer.b
        if i < len(layers) - 1:
            x = np.maximum(x, 0.0)
        steps.append(x)
    return steps


MAX_WEIGHT_BYTES = 256 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def score_mlp(df: DataFrame, layers: Sequence[Layer], features: str, key: str, out: str = "prediction") -> DataFrame:
    """Key and output of a perceptron, one matrix product per layer and Arrow batch.

    The weights travel with the tasks, so their size is checked first.
    """
    size = sum(x.w.nbytes + x.b.nbytes for x in layers)
    if size > MAX_WEIGHT_BYTES:
        raise ValueError(f"weights of {size} bytes are more than the {MAX_WEIGHT_BYTES} that travel with a task")

    def run(batches):
        for b in batches:
            y = _forward(layers, _matrix(b.column(1)))[-1] if len(b) else np.empty((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y[:, 0], pa.float64())], names=[key, out])

    return df.where(F.col(features).isNotNull()).select(key, features).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, {out} double")


def initial_layers(sizes: Sequence[int], seed: int = 42) -> list[Layer]:
    """Kaiming-normal hidden layers and a Xavier-normal output layer; biases 0."""
    rng = np.random.default_rng(seed)
    made = []
    for i, (n, m) in enumerate(zip(sizes, sizes[1:])):
        last = i == len(sizes) - 2
        made.append(Layer(rng.normal(0, np.sqrt(2 / (n + m) if last else 2 / n), (m, n)), np.zeros(m)))
    return made


def mlp_gradient(df: DataFrame, layers: Sequence[Layer], features: str, label: str) -> tuple[float, list[Layer], int]:
    """Mean squared error and its gradient over all rows: one gradient per task, summed on the way back."""
    def run(batches):
        total, grads, n = 0.0, [Layer(np.zeros_like(x.w), np.zeros_like(x.b)) for x in layers], 0
        for b in batches:
            if not len(b):
                continue
            steps = _forward(layers, _matrix(b.column(0)))
            diff = steps[-1][:, 0] - b.column(1).to_numpy(zero_copy_only=False)
            total += float(diff @ diff)
            n += len(b)
            delta = 2 * diff[:, None]
            for i in range(len(layers) - 1, -1, -1):
                grads[i].w += delta.T @ steps[i]
                grads[i].b += delta.sum(0)
                if i:
                    delta = (delta @ layers[i].w) * (steps[i] > 0)
        flat = np.concatenate([np.concatenate([g.w.ravel(), g.b]) for g in grads])
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n], pa.int64()), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["loss", "n", "g"])

    parts = df.select(features, label).mapInArrow(run, "loss double, n long, g array<double>")
    at = parts.select("loss", "n", F.posexplode("g").alias("i", "v"))
    sums = at.groupBy("i").agg(F.sum("v").alias("v"), F.sum("loss").alias("loss"), F.sum("n").alias("n")).orderBy("i").collect()
    n, loss = sums[0]["n"], sums[0]["loss"]
    flat, out, pos = np.array([r["v"] for r in sums]) / n, [], 0
    for x in layers:
        w = flat[pos:pos + x.w.size].reshape(x.w.shape)
        pos += x.w.size
        out.append(Layer(w, flat[pos:pos + x.b.size]))
        pos += x.b.size
    return loss / n, out, n


def fit_mlp(train: DataFrame, valid: DataFrame, features: str, label: str, sizes: Sequence[int], epochs: int = 50, rate: float = 1e-3,
            decay: float = 1e-4, clip: float = 1.0, patience: int = 10, stop: int = 30, seed: int = 42) -> tuple[list[Layer], list[float]]:
    """Full-batch Adam with weight decay and clipping; rate halved after ``patience`` flat epochs,
    stopped after ``stop``; the weights of the best epoch and the validation losses."""
    layers = initial_layers(sizes, seed)
    moment = [[np.zeros_like(v) for v in (x.w, x.b)] for x in layers]
    square = [[np.zeros_like(v) for v in (x.w, x.b)] for x in layers]
    best, kept, flat, losses = np.inf, layers, 0, []
    for epoch in range(1, epochs + 1):
        _, grads, _ = mlp_gradient(train, layers, features, label)
        norm = np.sqrt(sum(float((g.w ** 2).sum() + (g.b ** 2).sum()) for g in grads))
        shrink = min(1.0, clip / (norm + 1e-6))
        new = []
        for i, (x, g) in enumerate(zip(layers, grads)):
            both = []
            for j, (v, d) in enumerate(((x.w, g.w), (x.b, g.b))):
                d = d * shrink + decay * v
                moment[i][j] = 0.9 * moment[i][j] + 0.1 * d
                square[i][j] = 0.999 * square[i][j] + 0.001 * d * d
                both.append(v - rate * (moment[i][j] / (1 - 0.9 ** epoch)) / (np.sqrt(square[i][j] / (1 - 0.999 ** epoch)) + 1e-8))
            new.append(Layer(*both))
        layers = new
        pred = score_mlp(valid.withColumn("_y", F.col(label)), layers, features, "_y")
        losses.append(pred.agg(F.avg((F.col("_y") - F.col("prediction")) ** 2)).first()[0])
        if losses[-1] < best - 1e-12:
            best, kept, flat = losses[-1], layers, 0
        else:
            flat += 1
            if flat % patience == 0:
                rate /= 2
            if flat >= stop:
                break
    return kept, losses

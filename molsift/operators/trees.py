"""Trees from histograms: a forest of unlimited trees (I5) and boosting with penalties on the leaves.

Both take all rows of a table at once, those to learn from and those to score:
the latter ride along with weight 0 and end in a leaf like any other, so no
model of the size of the data travels. Features are cut into at most 255 bins
at quantiles; a split sends bins up to a cut to the left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_below, materialise

MOST_BINS = 255
# The cumulative Poisson(1) probabilities, for bootstrap weights.
POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def quantile_cuts(df: DataFrame, cols: Sequence[str], bins: int = MOST_BINS) -> list[np.ndarray]:
    """Upper ends of each column's bins: quantiles, the least and the largest value, in one pass."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins - 1)])
    found = df.agg(*[F.struct(F.min(c).cast("double"), F.max(c).cast("double"), F.percentile_approx(F.col(c).cast("double"), shares, 10_000)) for c in cols]).first()
    return [np.unique([x for x in (low, high, *(middle or [])) if x is not None]) for low, high, middle in found]


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit hashes and a salt."""
    x = h.astype(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0 ** 64


BLOCK = "n int, x binary, y binary, row binary, hash binary, use binary, fold binary"


def binned(df: DataFrame, cols: Sequence[str], cuts: list[np.ndarray], label: str) -> DataFrame:
    """The rows of ``df`` that have all features and a label, with their bins (_x)."""
    d = len(cols)

    @F.pandas_udf("binary")
    def bins(*values: pd.Series) -> pd.Series:
        x = np.stack([np.minimum(np.searchsorted(c, v.to_numpy()), len(c) - 1) for c, v in zip(cuts, values)], 1).astype(np.uint8).tobytes()
        return pd.Series([x[i:i + d] for i in range(0, len(x), d)], dtype=object)

    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*cols, label]))
    return whole.withColumn("_x", bins(*[F.col(c).cast("double") for c in cols]))


def blocks_of(df: DataFrame, cols: Sequence[str], cuts: list[np.ndarray], label: str, key: Sequence[str], use: Column, fold: str | None = None, rows: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` with a number (_row) and their bins (_x) each, and the same as blocks (n, x, y, row, hash, use, fold).

    ``use`` tells which rows are learnt from; rows without a feature or label are left out.
    """
    whole = materialise(binned(df.withColumn("_row", F.monotonically_increasing_id()), cols, cuts, label), "trees-rows")
    part = whole.select("_row", F.col(label).cast("double"), F.xxhash64(*key).alias("_h"), use.cast("int").alias("_use"),
                        (F.col(fold) if fold else F.lit(0)).cast("int").alias("_fold"), "_x")

    def run(batches):
        for big in batches:
            for at in range(0, len(big), rows):
                b = big.slice(at, rows)
                row, y, h, used, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int32()), *(pa.array([v], pa.binary()) for v in (
                    b"".join(b.column(5).to_pylist()), y.tobytes(), row.tobytes(), h.astype(np.int64).tobytes(), used.astype(np.int8).tobytes(),
                    f.astype(np.int32).tobytes()))], names=["n", "x", "y", "row", "hash", "use", "fold"])

    return whole, materialise(part.mapInArrow(run, BLOCK), "trees-blocks")


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of bins, in order, and the place of each row among them."""
    d = x.shape[1]
    if d > 8:
        found, at = np.unique(x, axis=0, return_inverse=True)
        return found, at.ravel()
    wide = np.zeros((len(x), 8), np.uint8)
    wide[:, 8 - d:] = x
    found, at = np.unique(wide.view(">u8").ravel().astype(np.uint64), return_inverse=True)
    return found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - d:], at


def _bytes_each(x: np.ndarray) -> pa.Array:
    """One binary value per row of bins."""
    n, d = x.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * d).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def vectors_of(blocks: DataFrame, d: int) -> int:
    """How many rows of bins are different."""
    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([_bytes_each(distinct_rows(np.frombuffer(x, np.uint8).reshape(-1, d))[0])], names=["x"])
    return blocks.select("x").mapInArrow(run, "x binary").distinct().count()


def dealt(blocks: DataFrame, n: int, ranges: int, rows: int = 2_000_000, tasks: int = 24) -> tuple[DataFrame, int, int]:
    """Blocks in chunks of about ``rows`` rows, a partition each, and how many chunks and slices there are.

    Where that makes few tasks, a chunk comes once for each slice of the work on it (at most ``ranges``).
    """
    chunks = max(1, -(-n // rows))
    slices = max(1, min(ranges, -(-tasks // chunks)))
    number = F.xxhash64("row")
    each = blocks.select(number.alias("order"), "x", "y", "hash", "use", "fold", F.pmod(number, F.lit(chunks)).cast("int").alias("chunk"),
                         F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    return each.repartitionById(chunks * slices, F.col("chunk") * slices + F.col("slice")), chunks, slices


@dataclass
class Chunk:
    """Rows of a task in the order of their bins: the distinct rows of bins, and of each row its place among them and the rest."""

    number: int
    slice: int
    x: np.ndarray
    at: np.ndarray
    y: np.ndarray
    hash: np.ndarray
    use: np.ndarray
    fold: np.ndarray
    #: The fit whose rows were drawn last, and these.
    drawn: "tuple[int, Bootstrap] | None" = None

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch], d: int) -> "Chunk | None":
        """From all blocks of a partition of ``dealt``."""
        blocks = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[2]))
        if not blocks:
            return None
        x, y, h, use, fold = (np.concatenate([np.frombuffer(b[i + 1], k) for b in blocks]) for i, k in enumerate((np.uint8, np.float64, np.int64, np.int8, np.int32)))
        x, at = distinct_rows(x.reshape(-1, d))
        order = np.argsort(at, kind="stable")
        return cls(blocks[0][6], blocks[0][7], x, *(v[order] for v in (at, y, h, use, fold)))

    @classmethod
    def of_rows(cls, batches: Iterator[pa.RecordBatch], d: int) -> "Chunk | None":
        """From all rows of a partition of ``dealt_by_bins``, in an order that hangs on them alone."""
        parts = [b for b in batches if len(b)]
        if not parts:
            return None
        x = np.concatenate([np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8) for b in parts])
        y, h, use, fold = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i in range(1, 5))
        x, at = distinct_rows(x.reshape(-1, d))
        order = np.lexsort((y, h, at))
        return cls(parts[0].column(5)[0].as_py(), 0, x, *(v[order] for v in (at, y, h, use, fold)))


@dataclass
class Rows:
    """Rows of blocks as arrays."""

    x: np.ndarray
    y: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    use: np.ndarray
    fold: np.ndarray

    @classmethod
    def of(cls, blocks: list[tuple]) -> "Rows":
        """From (n, x, y, row, hash, use, fold) each."""
        kinds = (np.uint8, np.float64, np.int64, np.int64, np.int8, np.int32)
        parts = [np.concatenate([np.frombuffer(b[i + 1], k) for b in blocks]) for i, k in enumerate(kinds)]
        return cls(parts[0].reshape(len(parts[1]), -1), *parts[1:])


# --- forest


def dealt_by_bins(rows: DataFrame, rows_each: int = 2_000_000, tasks: int = 24, least: int = 4_096, buckets: int = 1 << 16) -> tuple[DataFrame, int]:
    """The rows (_x, y, h, use, fold) in chunks of about ``rows_each``, a partition each, and how many rows of bins are different.

    Rows of equal bins stay together, so nearly every row of bins is in one
    chunk only, and what chunks add up per row of bins comes once, however many
    rows there are. Rows are laid end to end by a bucket of their bins and,
    within it, by their hashes, and cut into chunks of equal size; so bins that
    very many rows have take several chunks.
    """
    bucket = F.pmod(F.xxhash64("_x"), F.lit(buckets)).cast("int")
    sizes = rows.groupBy("_x").agg(F.count("*").alias("n")).groupBy(bucket.alias("_bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("vectors")).orderBy("_bucket").toPandas()
    n, vectors = int(sizes["n"].sum()), int(sizes["vectors"].sum())
    chunks = max(1, -(-n // rows_each), min(tasks, n // least))
    before = pd.DataFrame({"_bucket": sizes["_bucket"].astype("int32"), "_n": sizes["n"].astype("int64"), "_before": (sizes["n"].cumsum() - sizes["n"]).astype("int64")})
    table = F.broadcast(rows.sparkSession.createDataFrame(before, "_bucket int, _n long, _before long"))  # at most ``buckets`` rows
    share = F.pmod(F.xxhash64("h", "y"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chunk = F.least(F.floor((F.col("_before") + share * F.col("_n")) * F.lit(chunks / max(1, n))), F.lit(chunks - 1)).cast("int")
    each = rows.withColumn("_bucket", bucket).join(table, "_bucket").select("_x", "y", "h", "use", "fold", chunk.alias("chunk"))
    return each.repartitionById(chunks, F.col("chunk")), vectors


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, mtry: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One regression tree, all nodes of a level at a time: the value of each row's leaf, and each feature's gain.

    A node looks at ``mtry`` features drawn for it, and at further ones until
    one splits it. Rows of weight 0 follow the splits only.
    """
    n, d = x.shape
    value, gain = np.zeros(n), np.zeros(d)
    rows, node, m = np.arange(n), np.zeros(n, np.int64), 1
    for level in range(depth + 1):
        learn = w[rows] > 0
        size, total = (np.bincount(node, weights=v, minlength=m) for v in (w[rows], w[rows] * y[rows]))
        value[rows] = (total / np.maximum(size, 1e-300))[node]
        if level == depth:
            break
        features = rng.random((m, d)).argsort(1)
        best, feature, cut = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        known = np.zeros(m, bool)
        for k in range(d):
            ask = np.ones(m, bool) if k < mtry else ~known
            if not ask.any():
                break
            some = np.flatnonzero(learn & ask[node])
            r, at = rows[some], node[some]
            key = at * 256 + x[r, features[at, k]]
            order = np.argsort(key)
            key, r = key[order], r[order]
            sw, sy = np.cumsum(w[r]), np.cumsum(w[r] * y[r])
            end = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            at = key[end] >> 8
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # of each node among the cells
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(end))))
            before = np.append(0, end[:-1])[first]
            base_w, base_y = np.where(first > 0, sw[before], 0.0)[of], np.where(first > 0, sy[before], 0.0)[of]
            lw, ly = sw[end] - base_w, sy[end] - base_y
            rw, ry = size[at] - lw, total[at] - ly
            inner = np.append(at[1:] == at[:-1], False)  # the last cell of a node splits nothing off
            better = np.where(inner, ly ** 2 / lw + ry ** 2 / np.where(inner, rw, 1.0) - total[at] ** 2 / size[at], -1.0)
            top = np.maximum.reduceat(better, first)
            pick = np.full(len(first), len(end))
            hit = np.flatnonzero(better == top[of])
            np.minimum.at(pick, of[hit], hit)
            nodes = at[first]
            known[nodes] |= inner[pick]
            take = inner[pick] & (top > best[nodes] + 1e-9 * np.maximum(1.0, np.abs(best[nodes])))
            nodes, pick = nodes[take], pick[take]
            best[nodes], feature[nodes], cut[nodes] = top[take], features[nodes, k], key[end[pick]] & 255
        split = feature >= 0
        np.add.at(gain, feature[split], best[split])
        on = split[node]
        rows, node = rows[on], node[on]
        if not len(rows):
            break
        child = np.cumsum(split) - 1
        node = 2 * child[node] + (x[rows, feature[node]] > cut[node])
        m = 2 * int(split.sum())
    return value, gain


def _counts() -> np.ndarray:
    """Bootstrap count of each value of a hash's 16 upper bits, and 16 on top of the least one where the lower bits matter."""
    low, high = (np.searchsorted(POISSON, (np.arange(1 << 16) + more) / 65536.0) for more in (0, 1))
    return np.where(low == high, low, low + 16).astype(np.uint8)


class Bootstrap:
    """Rows with their bootstrap counts, and these added up by groups of rows that follow each other.

    The counts of a row are those of ``_mix`` of its hash: how many of POISSON
    are less. Rows are worked on in blocks that fit a processor's cache.
    """

    BLOCK = 1 << 15

    def __init__(self, at: np.ndarray, y: np.ndarray, h: np.ndarray, m: int):
        self.at, self.y, self.hash, self.m, self.table = at, y, h, m, _counts()
        self.found = np.empty(len(y), np.uint8)
        h = h.astype(np.uint64)
        self.mixed = h ^ (h >> np.uint64(30))
        new = np.append(True, at[1:] != at[:-1])[:len(at)]
        new[::self.BLOCK] = True
        starts = np.flatnonzero(new)
        cuts = np.searchsorted(starts, np.arange(0, len(at) + self.BLOCK, self.BLOCK)).tolist()
        self.blocks = [(k * self.BLOCK, starts[a:z] - k * self.BLOCK, at[starts[a:z]]) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]

    def sums(self, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each group, the sum of the counts, and that of the counts times the labels."""
        w, t = np.zeros(self.m), np.zeros(self.m)
        add = np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        add ^= add >> np.uint64(30)
        x, rest, count = (np.empty(self.BLOCK, k) for k in (np.uint64, np.uint64, np.uint8))
        found = self.found
        for first, starts, group in self.blocks:
            mixed, y, seen = (v[first:first + self.BLOCK] for v in (self.mixed, self.y, found))
            x, rest, count = (v[:len(y)] for v in (x, rest, count))
            each = rest.view(np.float64)  # the same memory, once the hashes are used
            # As ``_mix`` does it; its last step leaves the upper bits as they are.
            np.bitwise_xor(mixed, add, out=x)
            np.multiply(x, np.uint64(0xBF58476D1CE4E5B9), out=x)
            np.right_shift(x, np.uint64(27), out=rest)
            np.bitwise_xor(x, rest, out=x)
            np.multiply(x, np.uint64(0x94D049BB133111EB), out=x)
            np.right_shift(x, np.uint64(48), out=rest)
            np.take(self.table, rest.view(np.int64), out=seen, mode="clip")
            np.bitwise_and(seen, 15, out=count)
            np.copyto(each, count)
            w[group] += np.add.reduceat(each, starts)
            np.multiply(each, y, out=each)
            t[group] += np.add.reduceat(each, starts)
        close = np.flatnonzero(found > 15)
        more = np.searchsorted(POISSON, _mix(self.hash[close], salt)) - (found[close] & 15)
        np.add.at(w, self.at[close], more)
        np.add.at(t, self.at[close], more * self.y[close])
        return w, t


def forest(df: DataFrame, cols: Sequence[str], label: str, key: Sequence[str] | Column, use: Column, trees: int = 200, depth: int = 30, seed: int = 42,
           fold: str | None = None, folds: int = 0, mtry: int | None = None, in_task: int = 1_000_000, at_once: int = 25,
           keep: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Bagged regression trees, each node over sqrt(features) of the features.

    Returns the rows (all columns, or those of ``keep``) with ``fit`` and ``prediction``, and the importances (fit,
    feature, importance; 1 in all per fit). Fit 0 learns from the rows of
    ``use`` and scores all; fit i, for i up to ``folds``, learns from all rows
    but those of fold i - 1 and scores these (cross-validation). Rows are drawn
    by the hash of their ``key``, or by ``key`` if that is a hash already.

    Rows of equal bins end in the same leaf, so a tree learns from weights and
    weighted sums of the label per row of bins, added up in chunks of the table,
    by bins, and merged by tree. Trees over at most ``in_task`` different rows of bins
    are grown in a task, up to ``at_once`` of them. Larger nodes are split by
    histograms first, one job per level in which chunks add up per (tree, node)
    and only the level's splits go back; what lies below a node of at most
    ``in_task`` entries is grown in a task of its own.
    """
    cuts = quantile_cuts(df, cols)
    mtry = mtry or max(1, int(np.sqrt(len(cols))))
    hashed = key if isinstance(key, Column) else F.xxhash64(*key)
    inner = {"_h": hashed, "_use": F.coalesce(use, F.lit(False)).cast("tinyint"), "_fold": F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(0)}
    whole = binned(df, cols, cuts, label).withColumns(inner)
    shown = [c for c in df.columns if keep is None or c in keep]
    rows = materialise(whole.select(*shown, *([] if label in shown else [label]), "_x", *inner), "trees-rows")
    learnt = rows.select("_x", F.col(label).cast("double").alias("y"), F.col("_h").alias("h"), F.col("_use").alias("use"), F.col("_fold").alias("fold"))
    found = materialise(_grown(learnt, len(cols), folds, trees, depth, mtry, seed, in_task, at_once), "trees-found")
    each = found.where("feature IS NULL").groupBy("x").agg(F.array(*[F.sum(F.when(F.col("fit") == i, F.col("value"))) / trees for i in range(folds + 1)]).alias("_values"))
    each = broadcast_below(materialise(each, "trees-scores"))
    fits = F.array(F.lit(0))
    if folds:
        fits = F.when(F.col("_fold").between(0, folds - 1), F.array(F.lit(0), F.col("_fold") + 1)).otherwise(fits)
    scored = rows.join(each, rows["_x"] == each["x"]).select(*shown, "_values", F.explode(fits).alias("fit"))
    scored = scored.withColumn("prediction", F.get("_values", F.col("fit"))).drop("_values")
    per_tree = found.where("feature IS NOT NULL").groupBy("fit", "tree", "feature").agg(F.sum("value").alias("gain"))
    share = per_tree.withColumn("share", F.try_divide("gain", F.sum("gain").over(W.partitionBy("fit", "tree"))))
    sums = share.groupBy("fit", "feature").agg(F.sum("share").alias("s"))
    names = F.array(*[F.lit(c) for c in cols])
    importances = sums.select("fit", F.get(names, F.col("feature")).alias("feature"), F.try_divide("s", F.sum("s").over(W.partitionBy("fit"))).alias("importance"))
    return scored, importances


FOUND = "fit int, tree int, feature int, x binary, value double"


def _found(fit: int, tree: int, feature: list | None, x: np.ndarray | None, value: np.ndarray) -> pa.RecordBatch:
    n = len(value)
    return pa.RecordBatch.from_arrays([pa.array([fit] * n, pa.int32()), pa.array([tree] * n, pa.int32()), pa.array(feature or [None] * n, pa.int32()),
                                       pa.nulls(n, pa.binary()) if x is None else _bytes_each(x), pa.array(value, pa.float64())],
                                      names=["fit", "tree", "feature", "x", "value"])


OPEN, BELOW, LEAF = 0, 1, 2


@dataclass
class Upper:
    """The upper nodes of a tree, the root first: their splits, or what is to be done with them."""

    feature: list
    cut: list
    left: list
    level: list
    state: list
    mean: list
    size: list

    @classmethod
    def root(cls, state: int) -> "Upper":
        return cls([-1], [0], [0], [0], [state], [0.0], [0])

    def split(self, node: int, feature: int, cut: int, sizes: tuple[int, int], in_task: int) -> None:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for n in sizes:
            for values, v in zip((self.feature, self.cut, self.left, self.level, self.state, self.mean, self.size),
                                 (-1, 0, 0, self.level[node] + 1, OPEN if n > in_task else BELOW, 0.0, n)):
                values.append(v)

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The last node that each row comes to."""
        feature, cut, left = (np.array(v) for v in (self.feature, self.cut, self.left))
        at = np.zeros(len(x), np.int64)
        on = np.arange(len(x)) if feature[0] >= 0 else np.empty(0, np.int64)
        while len(on):
            f = feature[at[on]]
            at[on] = left[at[on]] + (x[on, f] > cut[at[on]])
            on = on[feature[at[on]] >= 0]
        return at


def _sums(chunk: Chunk, fit: int, trees: Sequence[int], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each tree, the weight of the rows of each row of bins, and the sum of their weighted labels.

    Fit 0 learns from the rows in use, fit i from all but those of fold i - 1.
    """
    if chunk.drawn is None or chunk.drawn[0] != fit:
        on = np.flatnonzero(chunk.use > 0 if fit == 0 else chunk.fold != fit - 1)
        chunk.drawn = fit, Bootstrap(chunk.at[on], chunk.y[on], chunk.hash[on], len(chunk.x))
    for tree in trees:
        yield chunk.drawn[1].sums(seed * 1_000_003 + fit * 10_007 + tree)


def _scored(chunk: Chunk, fit: int) -> np.ndarray:
    """Which rows of bins have a row that the fit scores."""
    return np.bincount(chunk.at, weights=np.ones(len(chunk.at)) if fit == 0 else chunk.fold == fit - 1, minlength=len(chunk.x)) > 0


def best_of_node(w: np.ndarray, t: np.ndarray, order: Sequence[int], mtry: int) -> tuple[float, int, int]:
    """Gain, feature and bin of a node's best split, from weights and weighted sums (feature, bin); feature -1 if nothing splits it.

    As ``grow`` does, it looks at ``mtry`` features in their order, and at further ones until one splits it.
    """
    best, known = (0.0, -1, 0), False
    for k, f in enumerate(order):
        if k >= mtry and known:
            break
        some = np.flatnonzero(w[f] > 0)
        lw, lt, size, total = np.cumsum(w[f][some])[:-1], np.cumsum(t[f][some])[:-1], w[f].sum(), t[f].sum()
        if not len(lw):
            continue
        known = True
        gain = lt ** 2 / lw + (total - lt) ** 2 / (size - lw) - total ** 2 / size
        at = int(gain.argmax())
        if gain[at] > best[0] + 1e-9 * max(1.0, abs(best[0])):
            best = (float(gain[at]), int(f), int(some[at]))
    return best


def _grown(rows: DataFrame, d: int, folds: int, trees: int, depth: int, mtry: int, seed: int, in_task: int, at_once: int) -> DataFrame:
    """Gains (fit, tree, feature, value) and, per row of bins, sums of leaves (fit, x, value) of all trees of all fits."""
    chunked, vectors = dealt_by_bins(rows)
    small = vectors <= in_task
    at_once = max(1, min(at_once, 8 * in_task // max(1, vectors))) if small else 1
    groups = [(fit, range(t, min(trees, t + at_once))) for fit in range(folds + 1) for t in range(0, trees, at_once)]
    upper = {} if small else {(fit, tree): Upper.root(OPEN) for fit in range(folds + 1) for tree in range(trees)}
    gains = _split_upper(chunked, groups, upper, d, depth, mtry, seed, in_task) if upper else []

    def run(batches):
        chunk = Chunk.of_rows(batches, d)
        for fit, some in groups if chunk else ():
            scored, whole = _scored(chunk, fit), list(_sums(chunk, fit, some, seed))
            keep = np.flatnonzero(scored | np.any([w > 0 for w, _ in whole], 0))
            x = chunk.x[keep]
            parts = [(0, 0, np.arange(len(x)))] if small else _parts(upper[fit, some[0]], x, in_task)
            for node, part, mine in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], pa.int32()) for v in (fit, some[0], node, part, chunk.number)] + [pa.array([v.tobytes()], pa.binary()) for v in (
                        x[mine], scored[keep][mine], np.stack([w[keep][mine] for w, _ in whole]).astype(np.int32), np.stack([t[keep][mine] for _, t in whole]))],
                    names=["fit", "tree", "node", "part", "chunk", "x", "scored", "w", "t"])

    def below(table: pa.Table) -> pa.Table:
        fit, tree, node, _ = (table.column(c)[0].as_py() for c in ("fit", "tree", "node", "part"))
        got = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "x", "scored", "w", "t"))), key=lambda r: r[0])
        x, at = distinct_rows(np.frombuffer(b"".join(r[1] for r in got), np.uint8).reshape(-1, d))
        scored = np.bincount(at, weights=np.frombuffer(b"".join(r[2] for r in got), bool), minlength=len(x)) > 0
        w, t = (np.concatenate([np.frombuffer(r[i], k).reshape(-1, len(r[2])) for r in got], 1) for i, k in ((3, np.int32), (4, np.float64)))
        total, out, top = np.zeros(len(x)), [], upper.get((fit, tree))
        if top and top.state[node] == LEAF:
            return pa.Table.from_batches([_found(fit, tree, None, x[scored], np.full(scored.sum(), top.mean[node]))])
        for j in range(len(w)):
            wj, tj = (np.bincount(at, weights=v[j], minlength=len(x)) for v in (w, t))
            y = np.divide(tj, wj, out=np.zeros(len(x)), where=wj > 0)
            value, gain = grow(x, y, wj, depth - (top.level[node] if top else 0), mtry, np.random.default_rng([seed, fit, tree + j, *([node] if top else [])]))
            total += value
            out.append(_found(fit, tree + j, list(range(d)), None, gain))
        return pa.Table.from_batches([*out, _found(fit, tree, None, x[scored], total[scored])])

    by = ["fit", "tree", "node", "part"]
    sums = chunked.mapInArrow(run, ", ".join(f"{c} int" for c in [*by, "chunk"]) + ", x binary, scored binary, w binary, t binary")
    nodes = len(groups) if small else sum(f < 0 for u in upper.values() for f in u.feature)
    found = sums.repartition(min(2_000, max(1, nodes)), *by).groupBy(*by).applyInArrow(below, FOUND)
    if gains:
        found = found.unionByName(rows.sparkSession.createDataFrame(gains, FOUND))
    return found


def _parts(upper: Upper, x: np.ndarray, in_task: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(node, part, rows) of rows of bins; leaves of many rows are dealt into parts, as their value is known."""
    at = upper.nodes(x)
    for node in np.unique(at).tolist():
        mine = np.flatnonzero(at == node)
        if upper.state[node] != LEAF or upper.size[node] <= in_task:
            yield node, 0, mine
            continue
        part = (x[mine].astype(np.int64) @ (2 * np.arange(x.shape[1]) + 101) ** 2) % (upper.size[node] // in_task + 1)
        for p in np.unique(part).tolist():
            yield node, p, mine[part == p]


def _split_upper(chunked: DataFrame, groups: list, upper: dict, d: int, depth: int, mtry: int, seed: int, in_task: int) -> list[tuple]:
    """Split the open nodes of ``upper`` level by level until all are small or leaves; the gains as rows of FOUND."""
    width, gains = 256, []

    def histograms(batches):
        chunk = Chunk.of_rows(batches, d)
        for fit, some in groups if chunk else ():
            for tree, (w, t) in zip(some, _sums(chunk, fit, some, seed)):
                top = upper[fit, tree]
                live = [v for v, s in enumerate(top.state) if s == OPEN and top.feature[v] < 0]
                if not live:
                    continue
                place = np.full(len(top.state), -1)
                place[live] = np.arange(len(live))
                on = np.flatnonzero((w > 0) | _scored(chunk, fit))
                at = place[top.nodes(chunk.x[on])]
                on, at = on[at >= 0], at[at >= 0]
                cell = ((at[:, None] * d + np.arange(d)) * width + chunk.x[on]).ravel()
                w, t, n = (np.bincount(cell, weights=np.repeat(v, d), minlength=len(live) * d * width).reshape(len(live), -1) for v in (w[on], t[on], np.ones(len(on))))
                for j, node in enumerate(live):
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (fit, tree, node, chunk.number)] + [
                        pa.array([v[j].tobytes()], pa.binary()) for v in (w, t, n)], names=["fit", "tree", "node", "chunk", "w", "t", "n"])

    def best(table: pa.Table) -> pa.Table:
        fit, tree, node = (table.column(c)[0].as_py() for c in ("fit", "tree", "node"))
        got = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "w", "t", "n"))), key=lambda r: r[0])
        w, t, n = (sum(np.frombuffer(r[i]) for r in got).reshape(d, width) for i in (1, 2, 3))
        gain, feature, cut = best_of_node(w, t, np.random.default_rng([seed, fit, tree, node]).permutation(d), mtry)
        left = int(n[feature, :cut + 1].sum()) if feature >= 0 else 0
        row = (fit, tree, node, gain, feature, cut, t[0].sum() / max(w[0].sum(), 1e-300), left, int(n[0].sum()) - left)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["fit", "tree", "node", "gain", "feature", "cut", "mean", "left", "right"])]).cast(SPLIT)

    while any(s == OPEN and f < 0 for u in upper.values() for s, f in zip(u.state, u.feature)):
        found = chunked.mapInArrow(histograms, "fit int, tree int, node int, chunk int, w binary, t binary, n binary").groupBy("fit", "tree", "node").applyInArrow(
            best, "fit int, tree int, node int, gain double, feature int, cut int, mean double, left long, right long").collect()
        for r in found:
            top = upper[r["fit"], r["tree"]]
            top.mean[r["node"]], top.size[r["node"]] = r["mean"], r["left"] + r["right"]
            if r["feature"] < 0 or top.level[r["node"]] == depth:
                top.state[r["node"]] = LEAF
            elif top.size[r["node"]] <= in_task:
                top.state[r["node"]] = BELOW
            else:
                top.split(r["node"], r["feature"], r["cut"], (r["left"], r["right"]), in_task)
                gains.append((r["fit"], r["tree"], r["feature"], None, r["gain"]))
        asked = {(r["fit"], r["tree"]) for r in found}
        for k, top in upper.items():  # without a row to learn from or to score
            if k not in asked:
                top.state = [LEAF if s == OPEN and f < 0 else s for s, f in zip(top.state, top.feature)]
    return gains


SPLIT = pa.schema([("fit", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("cut", pa.int32()),
                   ("mean", pa.float64()), ("left", pa.int64()), ("right", pa.int64())])


# --- boosting


def shrunk(g, l1: float):
    """A sum of gradients, moved towards 0 by ``l1``."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


@dataclass
class Tree:
    """Nodes in heap order: feature (-1: a leaf), cut and value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row has come to after so many levels."""
        at = np.zeros(len(x), np.int64)
        for _ in range(levels):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]))
        return at


def best_splits(g: np.ndarray, h: np.ndarray, l1: float, l2: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and bin of the best split of each node, from sums of gradients and second derivatives (node, feature, bin)."""
    gl, hl = np.cumsum(g, 2), np.cumsum(h, 2)
    gt, ht = gl[:, :, -1:], hl[:, :, -1:]

    def score(a, b):
        return shrunk(a, l1) ** 2 / (b + l2)

    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
    gain = np.where((hl >= least) & (ht - hl >= least), gain, -np.inf).reshape(len(g), -1)
    top = gain.argmax(1)
    return gain[np.arange(len(g)), top], top // g.shape[2], top % g.shape[2]


def leaves(g, h, eta: float, l1: float, l2: float):
    return -eta * shrunk(g, l1) / np.maximum(h + l2, 1e-300)


def split_level(tree: Tree, level: int, g: np.ndarray, h: np.ndarray, mine: np.ndarray, eta: float, l1: float, l2: float, least: float,
                gains: np.ndarray, counts: np.ndarray) -> bool:
    """Split the nodes of a level by their sums (node, feature of ``mine``, bin); whether any was split."""
    first = 2 ** level - 1
    if level == 0:
        tree.value[0] = leaves(g[0, 0].sum(), h[0, 0].sum(), eta, l1, l2)
    gain, feature, cut = best_splits(g, h, l1, l2, least)
    split = np.flatnonzero(gain > 1e-6)
    if not len(split):
        return False
    tree.feature[first + split], tree.cut[first + split] = mine[feature[split]], cut[split]
    # A split's sums are those of its children, so the last level needs no sums of its own.
    gl, hl = (np.cumsum(v[split, feature[split]], 1)[np.arange(len(split)), cut[split]] for v in (g, h))
    gr, hr = (v[split, 0].sum(1) - part for v, part in ((g, gl), (h, hl)))
    tree.value[2 * (first + split) + 1], tree.value[2 * (first + split) + 2] = leaves(gl, hl, eta, l1, l2), leaves(gr, hr, eta, l1, l2)
    np.add.at(gains, mine[feature[split]], gain[split])
    np.add.at(counts, mine[feature[split]], 1)
    return True


def boost(df: DataFrame, cols: Sequence[str], label: str, key: Sequence[str], use: Column, trees: int = 200, depth: int = 6, eta: float = 0.1,
          rows: float = 0.8, columns: float = 0.8, l1: float = 0.1, l2: float = 1.0, least: float = 1.0, seed: int = 42,
          keep_every: int = 20, cuts: list[np.ndarray] | None = None, in_task: int = 500_000) -> tuple[DataFrame, list[Tree], dict[str, float]]:
    """Boosting of squared error by second-order splits, with L1 and L2 penalties on the leaves.

    Returns the rows with ``prediction``, the trees and the importances (mean
    gain of a feature's splits, 1 in all). The first prediction is the mean of
    the labels in ``use``. A split's gain is s(GL) + s(GR) - s(G) with s(G) =
    shrunk(G, l1)^2 / (H + l2), where both sides need H >= ``least``; a leaf adds
    -eta * shrunk(G, l1) / (H + l2). Rows (share ``rows``, by a hash of ``key``)
    and columns (share ``columns``) are drawn once per tree.

    Rows of equal bins have the same score at any time, so a tree needs of them
    no more than how many are drawn and the sum of their labels; neither depends
    on the trees before. Both are added up for all trees at once, in chunks of
    the table, and merged by tree; up to ``in_task`` different rows of bins, the
    trees are then made in a task that reads these sums tree by tree.

    Beyond that a level is one job: blocks add gradients and counts up by (node,
    feature, bin), tasks are merged in a tree, and only the level's splits are
    sent on. The blocks carry their rows' scores, held in memory and written
    every ``keep_every`` trees, so a lost executor costs no more trees than that.
    """
    cuts = cuts or quantile_cuts(df.where(use), cols)
    source, blocks = blocks_of(df, cols, cuts, label, key, use)
    bins, d, sc = max(map(len, cuts)), len(cols), df.sparkSession.sparkContext
    fields = [f.split()[0] for f in BLOCK.split(", ")]
    options = {"eta": eta, "l1": l1, "l2": l2, "least": least}
    start = source.where(use).agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    n_rows = blocks.agg(F.sum("n")).first()[0] or 0
    made: list[Tree] = []
    gains, counts = np.zeros(d), np.zeros(d)

    def importances() -> dict[str, float]:
        mean = np.divide(gains, counts, out=np.zeros(d), where=counts > 0)
        return dict(zip(cols, (mean / mean.sum() if mean.sum() else mean).tolist()))

    if 0 < vectors_of(blocks, d) <= in_task:
        found = materialise(_boosted(blocks, n_rows, d, bins, start, trees, depth, rows, columns, seed, options), "boost-found")
        for r in found.where("no IS NOT NULL").orderBy("no").collect():
            made.append(Tree(*(np.frombuffer(r[c], k) for c, k in (("feature", np.int64), ("cut", np.int64), ("value", np.float64)))))
            gains += np.frombuffer(r["gains"])
            counts += np.frombuffer(r["counts"])
        each = broadcast_below(materialise(found.where("no IS NULL").select(F.col("x").alias("_found"), F.col("score").alias("prediction")), "boost-scores"))
        return source.join(each, source["_x"] == each["_found"]).drop("_row", "_x", "_found"), made, importances()

    def held(frame: DataFrame):
        """The blocks as arrays, in tasks of 100,000 rows or more."""
        rdd = frame.rdd.map(lambda r: (Rows.of([tuple(r[f] for f in fields)]), np.full(r["n"], start) if r["score"] is None else np.frombuffer(r["score"], np.float64)))
        return rdd.coalesce(max(1, n_rows // 100_000)).persist(StorageLevel.MEMORY_AND_DISK)

    frame = blocks.withColumn("score", F.lit(None).cast("binary"))
    now, before = held(frame), None
    for no in range(trees):
        mine = _columns_of(seed, no, d, columns)
        tree, width = Tree.of_depth(depth), len(mine)
        for level in range(depth):
            first, m = 2 ** level - 1, 2 ** level

            def sums(part, level=level, first=first, m=m, tree=tree, no=no, mine=mine, width=width):
                g, h = np.zeros(m * width * bins), np.zeros(m * width * bins)
                for data, score in part:
                    at = tree.nodes(data.x, level)
                    on = np.flatnonzero((data.use > 0) & (at >= first) & (_mix(data.hash, seed * 1_000_003 + no) < rows))
                    cell = (((at[on] - first)[:, None] * width + np.arange(width)) * bins + data.x[np.ix_(on, mine)]).ravel()
                    g += np.bincount(cell, weights=np.repeat(score[on] - data.y[on], width), minlength=len(g))
                    h += np.bincount(cell, minlength=len(h))
                yield g, h

            g, h = (v.reshape(m, width, bins) for v in now.mapPartitions(sums).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1])))
            if before is not None:  # the new scores are there, so the old ones may go
                before.unpersist()
                before = None
            if not split_level(tree, level, g, h, mine, **options, gains=gains, counts=counts):
                break
        made.append(tree)
        after = now.map(lambda b, tree=tree: (b[0], b[1] + tree.value[tree.nodes(b[0].x, depth)]))
        if len(made) % keep_every == 0 or no == trees - 1:
            scored = after.map(lambda b: (len(b[0].y), *(bytearray(v.tobytes()) for v in (b[0].x, b[0].y, b[0].row, b[0].hash, b[0].use, b[0].fold, b[1]))))
            frame = materialise(df.sparkSession.createDataFrame(scored, f"{BLOCK}, score binary"), "boost-blocks")
            now.unpersist()
            now = held(frame)
        else:
            before, now = now, after.persist(StorageLevel.MEMORY_AND_DISK)
    now.unpersist()

    def scores(batches):
        for b in batches:
            for row, score in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row, np.int64)), pa.array(np.frombuffer(score, np.float64))], names=["row", "prediction"])

    found = frame.select("row", "score").mapInArrow(scores, "row long, prediction double")
    return source.join(found, source["_row"] == found["row"]).drop("_row", "_x", "row"), made, importances()


def _columns_of(seed: int, no: int, d: int, share: float) -> np.ndarray:
    """The columns that a tree may use."""
    return np.sort(np.random.default_rng([seed, no]).permutation(d)[:max(1, round(share * d))])


BOOSTED = "no int, feature binary, cut binary, value binary, gains binary, counts binary, x binary, score double"


def _boosted(blocks: DataFrame, n: int, d: int, bins: int, start: float, trees: int, depth: int, rows: float, columns: float, seed: int, options: dict,
             at_once: int = 10) -> DataFrame:
    """The trees (no, feature, cut, value, gains, counts) and the score of each row of bins (x, score)."""
    chunked, _, slices = dealt(blocks, n, trees)
    groups = [range(t, min(trees, t + at_once)) for t in range(0, trees, at_once)]

    def run(batches):
        chunk = Chunk.of(batches, d)
        if not chunk:
            return
        on = np.flatnonzero(chunk.use > 0)
        at, y, hashes, m = chunk.at[on], chunk.y[on], chunk.hash[on], len(chunk.x)
        for some in groups[chunk.slice::slices]:
            h, t = np.empty((len(some), m), np.int32), np.empty((len(some), m))
            for j, no in enumerate(some):
                drawn = np.flatnonzero(_mix(hashes, seed * 1_000_003 + no) < rows)
                h[j], t[j] = np.bincount(at[drawn], minlength=m), np.bincount(at[drawn], weights=y[drawn], minlength=m)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (some[0], chunk.number)] + [pa.array([v.tobytes()], pa.binary()) for v in (chunk.x, h, t)],
                                             names=["no", "chunk", "x", "h", "t"])

    def merge(table: pa.Table) -> pa.Table:
        got = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "x", "h", "t"))), key=lambda r: r[0])
        x, at = distinct_rows(np.frombuffer(b"".join(r[1] for r in got), np.uint8).reshape(-1, d))
        h, t = (np.concatenate([np.frombuffer(r[i], k).reshape(-1, len(r[1]) // d) for r in got], 1) for i, k in ((2, np.int32), (3, np.float64)))
        no, m = table.column("no")[0].as_py(), len(x)
        return pa.table({"no": pa.array(range(no, no + len(h)), pa.int32()), "x": pa.array([x.tobytes() if no + j == 0 else b"" for j in range(len(h))], pa.binary()),
                         "h": pa.array([np.bincount(at, weights=v, minlength=m).astype(np.int32).tobytes() for v in h], pa.binary()),
                         "t": pa.array([np.bincount(at, weights=v, minlength=m).tobytes() for v in t], pa.binary())})

    def make(batches):
        x = None
        for b in batches:
            for i in range(len(b)):
                no, first_x, h, t = (b.column(j)[i].as_py() for j in range(4))
                if no == 0:
                    x = np.frombuffer(first_x, np.uint8).reshape(-1, d)
                    score = np.full(len(x), start)
                h = np.frombuffer(h, np.int32).astype(float)
                g = h * score - np.frombuffer(t)
                mine, tree, gains, counts, at = _columns_of(seed, no, d, columns), Tree.of_depth(depth), np.zeros(d), np.zeros(d), np.zeros(len(x), np.int64)
                width = len(mine)
                for level in range(depth):
                    first, m = 2 ** level - 1, 2 ** level
                    on = np.flatnonzero((h > 0) & (at >= first))
                    cell = (((at[on] - first)[:, None] * width + np.arange(width)) * bins + x[np.ix_(on, mine)]).ravel()
                    sums = (np.bincount(cell, weights=np.repeat(v[on], width), minlength=m * width * bins).reshape(m, width, bins) for v in (g, h))
                    if not split_level(tree, level, *sums, mine, **options, gains=gains, counts=counts):
                        break
                    f = tree.feature[at]
                    at = np.where(f < 0, at, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > tree.cut[at]))
                score = score + tree.value[at]
                yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (tree.feature, tree.cut, tree.value, gains, counts)),
                                                  pa.nulls(1, pa.binary()), pa.nulls(1, pa.float64())], names=names)
        if x is not None:
            none = [pa.nulls(len(x), k) for k in (pa.int32(), *[pa.binary()] * 5)]
            yield pa.RecordBatch.from_arrays([*none, _bytes_each(x), pa.array(score)], names=names)

    names = [c.split()[0] for c in BOOSTED.split(", ")]
    sums = chunked.mapInArrow(run, "no int, chunk int, x binary, h binary, t binary").repartition(len(groups), "no").groupBy("no").applyInArrow(
        merge, "no int, x binary, h binary, t binary")
    return materialise(sums, "boost-sums").repartition(1).sortWithinPartitions("no").mapInArrow(make, BOOSTED)

"""Operator 13: hard negatives by a vertical scan of the dimensions with bounds on what remains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molsift.llm.common import bounded_batches
from molsift.session import materialise

#: Integers up to here are exact in float64.
EXACT = 1 << 53
LONGEST = (1 << 63) - 1


class Block:
    """Some rows as columns of their dimensions, rows of a label side by side."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, labels: list[str], starts: list[int], cols: np.ndarray):
        self.keys, self.rows, self.n = keys, rows, len(keys)
        self.range = dict(zip(labels, zip(starts, [*starts[1:], self.n])))
        self.low, self.high = cols.min(1, initial=0), cols.max(1, initial=0)  # short vectors end in zeros
        self.whole = cols
        self.cols = cols.astype(np.float64)

    def bitmap(self, label: str, same: bool) -> np.ndarray:
        """True for the rows of ``label``, or for all others."""
        out = np.full(self.n, not same)
        if label in self.range:
            at, end = self.range[label]
            out[at:end] = same
        return out


def vertical_scan(block: Block, anchor: np.ndarray, alive: np.ndarray, windows: list[tuple[int, int]], step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the bitmap ``alive`` whose inner product with ``anchor`` lies in one of ``windows``, and the products.

    Dimensions are read in the anchor's descending magnitude, ``step`` at a
    time. The least and greatest that the unread ones can still add, by each
    dimension's minimum and maximum in the block, clear the bits of rows whose
    product can't come to lie in a window; the rest is exact at the end.
    """
    dims = min(len(anchor), len(block.cols))
    order = np.argsort(-np.abs(anchor[:dims].astype(np.float64)), kind="stable")
    most = sum(abs(int(anchor[d])) * max(abs(int(block.low[d])), abs(int(block.high[d]))) for d in order) if dims else 0
    if most >= EXACT:  # beyond float64: whole numbers of any size
        at = np.flatnonzero(alive)
        total = np.zeros(len(at), object)
        for d in order:
            total = total + int(anchor[d]) * block.whole[d][at].astype(object)
        total = np.array([max(-LONGEST, min(LONGEST, x)) for x in total], np.int64)
        keep = np.zeros(len(at), bool)
        for low, high in windows:
            keep |= (total >= low) & (total <= high)
        return at[keep], total[keep]
    a = anchor[:dims].astype(np.float64)
    ends = np.stack([a * block.low[:dims], a * block.high[:dims]])[:, order]
    least = np.append(np.cumsum(ends.min(0)[::-1])[::-1], 0)
    greatest = np.append(np.cumsum(ends.max(0)[::-1])[::-1], 0)
    at = np.flatnonzero(alive)
    total = np.zeros(len(at))
    for i in range(0, max(dims, 1), step):
        now = order[i:i + step]
        part = block.cols[now] if len(at) == block.n else block.cols[now[:, None], at]
        total = total + a[now] @ part
        j = min(i + step, dims)
        keep = np.zeros(len(at), bool)
        for low, high in windows:
            keep |= (total + greatest[j] >= low) & (total + least[j] <= high)
        if not keep.all():
            at, total = at[keep], total[keep]
        if not len(at):
            break
    return at, total.astype(np.int64)


class Best:
    """The first ``k`` of the rows seen: by score descending, then key, then row."""

    def __init__(self, k: int):
        self.k, self.score, self.key, self.row = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        if not len(score):
            return
        score, key, row = np.concatenate([self.score, score]), np.concatenate([self.key, key]), np.concatenate([self.row, row])
        first = np.lexsort((row, key, -score))[:self.k]
        self.score, self.key, self.row = score[first], key[first], row[first]

    def least(self, low: int) -> int:
        """A score below this can't enter any more."""
        return max(low, int(self.score[-1])) if len(self.score) == self.k else low


def _block_rows(batches, size: int):
    """Rows (key, row, label, vector) sorted by label -> blocks of at most ``size`` rows."""
    held: list[tuple] = []

    def block():
        dims = max(len(r[3]) for r in held)
        cols = np.zeros((dims, len(held)), np.int64)
        for j, r in enumerate(held):
            cols[:len(r[3]), j] = r[3]
        starts = [j for j, r in enumerate(held) if not j or r[2] != held[j - 1][2]]
        kind = next(k for k in ("int16", "int32", "int64") if np.iinfo(k).min <= cols.min(initial=0) and cols.max(initial=0) <= np.iinfo(k).max)
        return ([len(held)], [np.array([r[0] for r in held], np.int64).tobytes()], [np.array([r[1] for r in held], np.int64).tobytes()],
                [[held[j][2] for j in starts]], [starts], [cols.astype(kind).tobytes()], [kind])

    names = ["n", "ids", "row_ids", "labels", "starts", "cols", "kind"]
    types = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.string()]
    for b in batches:
        flat, ends = b.column(3).flatten().to_numpy(zero_copy_only=False), np.cumsum(b.column(3).value_lengths().to_numpy(zero_copy_only=False))
        vectors = np.split(flat, ends[:-1]) if len(b) else []
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), vectors):
            held.append(row)
            if len(held) == size:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(block(), types)], names=names)
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(block(), types)], names=names)


def _read_blocks(batches):
    for b in batches:
        for n, ids, rows, labels, starts, cols, kind in zip(*(c.to_pylist() for c in b.columns)):
            yield Block(np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), labels, starts, np.frombuffer(cols, kind).reshape(-1, n))


def vertical_blocks(vectors: DataFrame, key: str, vector: str, label: str, scale: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows that take part (key, row, label, vector of whole numbers), and the same as blocks of columns."""
    x, bad = F.col("_v"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(vectors[key].cast("long").alias("key"), vectors[label].cast("string").alias("label"), vectors[vector].cast("array<double>").alias("_v"))
    rows = rows.filter(F.col("key").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, bad))
    rows = materialise(rows.select("key", F.monotonically_increasing_id().alias("row"), "label", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")), "bond-rows")
    blocks = rows.sortWithinPartitions("label").mapInArrow(
        lambda batches: _block_rows(batches, block_rows), "n int, ids binary, row_ids binary, labels array<string>, starts array<int>, cols binary, kind string")
    return rows, materialise(blocks, "bond-blocks")


def mine_negatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100,
                   n_positives: int = 5, n_negatives: int = 5, low_percent: int = 80, scale: int = 256, block_rows: int = 8192,
                   anchor_bytes: int = 32 << 20) -> DataFrame:
    """Negatives that score nearly as high as an anchor's positives, exact.

    Components become floor(scale * x); a score is the inner product with the
    anchor. Anchors are the rows whose key is divisible by ``every``. Their
    positives are the first ``n_positives`` other rows of their label, by score
    descending, then key. Returns for every anchor and positive the first
    ``n_negatives`` rows of other labels with low_percent * positive_score <=
    100 * negative_score <= 100 * positive_score: anchor_id, positive_id, rank
    (from 1), negative_id, positive_score, negative_score.

    Rows are kept as blocks of columns. Each task scans its blocks for every
    anchor (``vertical_scan``): first for the positives, with the score of the
    last one held as a bound that rises, then for the windows of all its
    positives at once. Of a task go on the few best per anchor, or per anchor
    and positive. The anchors are a stated query set, against all rows; they
    are sent out in rounds of at most ``anchor_bytes``, so what is sent doesn't
    grow with the data.

    Rows with a null key, label or vector, or with a null or non-finite
    component, take no part. Shorter vectors count as if zeros followed; an
    empty one scores 0. A repeated row is a row like any other: it can be a
    positive of its twin, each twin is an anchor with its own rows, and equal
    scores of equal keys come in the table's order. Components and scores stop
    at the range of a long. No anchors or an empty table give no rows. Other
    columns are not read.
    """
    bounded_batches(vectors)
    rows, blocks = vertical_blocks(vectors, key, vector, label, scale, block_rows)
    anchors = materialise(rows.filter(F.col("key") % every == 0), "bond-anchors")
    n, longest = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    rounds = max(1, -(-n * (8 * (longest or 0) + 400) // anchor_bytes))
    out = None
    for r in range(rounds):
        mine = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r)
        found = _one_round(blocks, [(x["row"], x["key"], x["label"], np.array(x["v"], np.int64)) for x in mine.collect()],
                           n_positives, n_negatives, low_percent)
        out = found if out is None else out.unionByName(found)
    return out


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "key", "row"))).filter(F.col("rank") <= k)


def _results(found: list[tuple], second: str, at_once: int = 2000):
    """(a_row, another number, Best) -> record batches."""
    for i in range(0, len(found), at_once):
        some = [x for x in found[i:i + at_once] if len(x[2].score)]
        if some:
            counts = [len(x[2].score) for x in some]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[j] for x in some], counts).astype(np.int64)) for j in (0, 1)]
                                             + [pa.array(np.concatenate([getattr(x[2], c) for x in some])) for c in ("key", "row", "score")],
                                             names=["a_row", second, "key", "row", "score"])


def _one_round(blocks: DataFrame, anchors: list[tuple], n_positives: int, n_negatives: int, low_percent: int) -> DataFrame:
    """The result for some anchors (row, key, label, vector)."""
    sc = blocks.sparkSession.sparkContext
    sent = sc.broadcast(sorted(anchors, key=lambda a: a[0]))

    def positives(batches):
        best = [Best(n_positives) for _ in sent.value]
        for block in _read_blocks(batches):
            for (row, _, label, v), mine in zip(sent.value, best):
                if label in block.range:
                    alive = block.bitmap(label, True)
                    alive[block.rows == row] = False
                    at, score = vertical_scan(block, v, alive, [(mine.least(-LONGEST), LONGEST)])
                    mine.add(score, block.keys[at], block.rows[at])
        yield from _results([(row, key, mine) for (row, key, _, _), mine in zip(sent.value, best)], "a_key")

    found = blocks.mapInArrow(positives, "a_row long, a_key long, key long, row long, score long")
    firsts = materialise(_first(found, ["a_row"], n_positives).select("a_row", F.col("a_key").alias("anchor_id"), F.col("row").alias("p_row"),
                                                                       F.col("key").alias("positive_id"), F.col("score").alias("positive_score")), "bond-positives")
    of: dict[int, list[tuple[int, int, int]]] = {}
    for x in firsts.filter("positive_score >= 0").collect():
        of.setdefault(x["a_row"], []).append((x["p_row"], -(-low_percent * x["positive_score"] // 100), x["positive_score"]))
    asked = sc.broadcast({row: sorted(ps) for row, ps in of.items()})

    def negatives(batches):
        best = {(row, p): Best(n_negatives) for row, ps in asked.value.items() for p, _, _ in ps}
        for block in _read_blocks(batches):
            for row, _, label, v in sent.value:
                ps = asked.value.get(row)
                if not ps:
                    continue
                windows = [(best[row, p].least(low), high) for p, low, high in ps]
                at, score = vertical_scan(block, v, block.bitmap(label, False), windows)
                for (p, _, _), (low, high) in zip(ps, windows):
                    fit = (score >= low) & (score <= high)
                    best[row, p].add(score[fit], block.keys[at[fit]], block.rows[at[fit]])
        yield from _results([(row, p, mine) for (row, p), mine in best.items()], "p_row")

    near = _first(blocks.mapInArrow(negatives, "a_row long, p_row long, key long, row long, score long"), ["a_row", "p_row"], n_negatives)
    out = near.join(F.broadcast(firsts), ["a_row", "p_row"])  # firsts: at most n_positives rows per anchor of the round
    return materialise(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"),
                                  "positive_score", F.col("score").alias("negative_score")), "bond-negatives")

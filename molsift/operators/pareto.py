"""Pareto front (skyline) over several objectives: G4, G5 and the D9 test.

A row ``q`` dominates ``p`` when it is no worse in every objective and better
in at least one; equal points do not dominate each other, so all copies of a
front point stay.

Plan (exact, no pair enumeration, no single task holding all rows):

1. Local fronts. ``mapInPandas`` keeps the front of every input partition
   (no shuffle). A row dominated inside its partition cannot be on the global
   front, because dominance is transitive.
2. Global merge. The survivors are range-partitioned on the objective tuple
   (all objectives turned into "smaller is better") and sorted inside each
   range. In lexicographic order a later row never dominates an earlier one,
   so each range is swept once against its own running front.
   A row of range ``r`` can also be dominated by a row of an earlier range
   ``r' < r``; such a row is lexicographically smaller and never equal, so the
   test reduces to the remaining objectives: is there an earlier-range point
   ``q`` with ``q.b <= p.b`` and ``q.c <= p.c``? Each range emits its 2-D
   staircase; these are merged in doubling steps, so that every range gets the
   one staircase of all ranges before it, and an as-of window (running minimum
   of ``c`` ordered by ``b``) answers the test per row.

The per-task numpy kernel compares a block of rows with a block of front
rows at a time, so memory is bounded by the block sizes, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalar import is_finite
from ..session import materialise

_BLOCK = 1024


def _dominated_by(P: np.ndarray, Q: np.ndarray) -> np.ndarray:
    """For each row of P: is it strictly dominated by some row of Q (all minimised)?"""
    out = np.zeros(len(P), dtype=bool)
    if len(P) == 0 or len(Q) == 0:
        return out
    for i in range(0, len(P), _BLOCK):
        p = P[i:i + _BLOCK][:, None, :]
        acc = np.zeros(p.shape[0], dtype=bool)
        for j in range(0, len(Q), _BLOCK):
            q = Q[j:j + _BLOCK][None, :, :]
            acc |= ((q <= p).all(axis=2) & (q < p).any(axis=2)).any(axis=1)
        out[i:i + _BLOCK] = acc
    return out


def _front_of_sorted(X: np.ndarray) -> np.ndarray:
    """Indices of the non-dominated rows of a lexicographically sorted matrix.

    Divide and conquer: rows of the second half cannot dominate rows of the
    first half, so the first half's front is final and filters the second.
    """
    n = len(X)
    if n <= _BLOCK:
        return np.nonzero(~_dominated_by(X, X))[0]
    h = n // 2
    left = _front_of_sorted(X[:h])
    right = np.arange(h, n)
    right = right[~_dominated_by(X[right], X[left])]
    right = right[_front_of_sorted(X[right])]
    return np.concatenate([left, right])


def lex_order(X: np.ndarray) -> np.ndarray:
    return np.lexsort(X[:, ::-1].T) if len(X) else np.arange(0)


def front_mask(X: np.ndarray) -> np.ndarray:
    """Boolean mask of the non-dominated rows of X (any order, all minimised)."""
    mask = np.zeros(len(X), dtype=bool)
    if len(X):
        order = lex_order(X)
        mask[order[_front_of_sorted(X[order])]] = True
    return mask


def _objective_matrix(pdf: pd.DataFrame, cols: Sequence[str]) -> np.ndarray:
    return np.column_stack([pdf[c].to_numpy(dtype=np.float64) for c in cols]) \
        if len(pdf) else np.empty((0, len(cols)))


def _local_front(obj_cols):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = _objective_matrix(pdf, obj_cols)
            if front is not None:  # the batch against the front, then the front against what is left of it
                fresh = ~_dominated_by(X, _objective_matrix(front, obj_cols))
                pdf, X = pdf[fresh], X[fresh]
            keep = front_mask(X)
            pdf, X = pdf[keep], X[keep]
            if front is not None and len(pdf):
                front = front[~_dominated_by(_objective_matrix(front, obj_cols), X)]
            front = pdf.reset_index(drop=True) if front is None else pd.concat([front, pdf], ignore_index=True)
        if front is not None and len(front):
            yield front
    return run


def _range_sweep(obj_cols, stair_b: str, stair_c: str):
    """Per range partition, rows arrive sorted: keep the range's front rows and
    append the 2-D staircase rows (``_kind`` 0) of the remaining objectives."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front_parts, front_X = [], np.empty((0, len(obj_cols)))
        rp = None
        template = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            template = pdf.iloc[:0]
            rp = int(pdf["_rp"].iloc[0])
            X = _objective_matrix(pdf, obj_cols)
            keep = np.nonzero(~_dominated_by(X, front_X))[0]
            if len(keep):
                keep = keep[_front_of_sorted(X[keep])]
                rows = pdf.iloc[keep]
                front_parts.append(rows)
                front_X = np.vstack([front_X, X[keep]])
        if not front_parts:
            return
        front = pd.concat(front_parts, ignore_index=True)
        front["_kind"] = np.int32(1)
        yield front
        # Staircase: minimal points under (b, c) among this range's front.
        bc = front[[stair_b, stair_c]].to_numpy(dtype=np.float64)
        order = np.lexsort((bc[:, 1], bc[:, 0]))
        c_sorted = bc[order, 1]
        prev_min = np.concatenate([[np.inf], np.minimum.accumulate(c_sorted)[:-1]])
        stair = bc[order][c_sorted < prev_min]
        if len(stair):
            st = pd.DataFrame(index=range(len(stair)), columns=list(template.columns),
                              dtype=object)
            st[stair_b] = stair[:, 0]
            st[stair_c] = stair[:, 1]
            st["_rp"] = np.int32(rp)
            st["_kind"] = np.int32(0)
            yield st[list(front.columns)]
    return run


def pareto_front(df: DataFrame, maximize: Sequence[str] = (), minimize: Sequence[str] = (),
                 num_ranges: int | None = None, drop_non_finite: bool = True) -> DataFrame:
    """Rows of ``df`` not dominated by any other row.

    Rows with a NULL, NaN or infinite objective are removed first (B5).
    Supports two or three objectives in the exact distributed merge.
    """
    objectives = [(c, -1.0) for c in maximize] + [(c, 1.0) for c in minimize]
    d = len(objectives)
    if d not in (2, 3):
        raise ValueError("pareto_front supports 2 or 3 objectives")
    cols = df.columns
    if drop_non_finite:
        cond = F.lit(True)
        for c, _ in objectives:
            cond = cond & is_finite(c)
        df = df.where(cond)
    obj_cols = [f"_o{i}" for i in range(d)]
    # "+ 0.0" turns -0.0 into 0.0 so equal points compare equal everywhere.
    work = df.select(*cols, *[(F.col(c).cast("double") * F.lit(s) + F.lit(0.0)).alias(o)
                              for (c, s), o in zip(objectives, obj_cols)])
    if d == 2:  # a constant middle objective turns the 2-D case into the 3-D one
        work = work.withColumn("_o_mid", F.lit(0.0))
        obj3 = [obj_cols[0], "_o_mid", obj_cols[1]]
    else:
        obj3 = obj_cols
    schema = work.schema

    # Phase 1: local fronts per input partition, no shuffle. They are written
    # once, as the range partitioner below reads its input twice.
    local = materialise(work.mapInPandas(_local_front(obj3), schema), "local-fronts")

    # Phase 2: exact merge over ranges of the objective tuple.
    spark = df.sparkSession
    k = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (local.repartitionByRange(k, *[F.col(c).asc() for c in obj3])
              .sortWithinPartitions(*obj3)
              .withColumn("_rp", F.spark_partition_id()))
    out_schema = StructType([StructField(f.name, f.dataType, True) for f in ranged.schema.fields]
                            + [StructField("_kind", IntegerType(), False)])
    swept = materialise(ranged.mapInPandas(_range_sweep(obj3, obj3[1], obj3[2]), out_schema), "range-fronts")

    # A row needs the staircase of all earlier ranges together: staircases are
    # merged by doubling steps, so each range gets one and none is copied to all.
    stairs = swept.where("_kind = 0").select("_rp", obj3[1], obj3[2])
    step = 1
    while step < k:
        moved = stairs.withColumn("_rp", F.col("_rp") + step).where(F.col("_rp") < k)
        lower = F.min(obj3[2]).over(Window.partitionBy("_rp").orderBy(obj3[1], obj3[2]).rowsBetween(Window.unboundedPreceding, -1))
        stairs = stairs.union(moved).withColumn("_low", lower).where(F.col("_low").isNull() | (F.col(obj3[2]) < F.col("_low"))).drop("_low")
        stairs = materialise(stairs, "staircases")
        step *= 2
    routed = swept.where("_kind = 1").unionByName(
        stairs.withColumns({"_rp": (F.col("_rp") + 1).cast("int"), "_kind": F.lit(0)}), allowMissingColumns=True)
    w = (Window.partitionBy("_rp").orderBy(F.col(obj3[1]).asc(), F.col("_kind").asc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best_c = F.min(F.when(F.col("_kind") == 0, F.col(obj3[2]))).over(w)
    checked = routed.withColumn("_best_c", best_c)
    front = checked.where((F.col("_kind") == 1)
                          & (F.col("_best_c").isNull() | (F.col("_best_c") > F.col(obj3[2]))))
    return front.select(*cols)


def breakthrough(new: DataFrame, known: DataFrame, maximize: Sequence[str],
                 minimize: Sequence[str], source_col: str = "source_file",
                 new_tag: str = "reasonable", known_tag: str = "original") -> DataFrame:
    """The front of ``new`` and ``known`` taken together; keep the new rows.

    Each side gets its source tag (B20) unless it already has one, the sides
    are unioned by name (H1) and non-finite objectives are dropped (B5).
    """
    def tag(df, name):
        if source_col in df.columns:
            return df.withColumn(source_col, F.coalesce(F.col(source_col), F.lit("unknown")))
        return df.withColumn(source_col, F.lit(name))
    both = tag(new, new_tag).unionByName(tag(known, known_tag), allowMissingColumns=True)
    front = pareto_front(both, maximize=maximize, minimize=minimize)
    return front.where(F.col(source_col) == F.lit(new_tag))


def dominance_sql(table: str, maximize: Sequence[str], minimize: Sequence[str]) -> str:
    """The same front as SQL ``NOT EXISTS`` (D9); used by the oracle only."""
    le = [f"q.{c} >= p.{c}" for c in maximize] + [f"q.{c} <= p.{c}" for c in minimize]
    lt = [f"q.{c} > p.{c}" for c in maximize] + [f"q.{c} < p.{c}" for c in minimize]
    return (f"SELECT p.* FROM {table} p WHERE NOT EXISTS (SELECT 1 FROM {table} q WHERE "
            + " AND ".join(le) + " AND (" + " OR ".join(lt) + "))")

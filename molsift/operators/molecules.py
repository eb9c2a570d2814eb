"""Molecule-level operators built on the graph arrays."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import smiles as S
from ..functions.scalar import group_order, non_blank, strip_text
from ..session import hint_if_small


def split_valid(df: DataFrame, col: str = "smiles") -> tuple[DataFrame, DataFrame]:
    """(valid rows with their graph, rejected rows with a ``reason``).

    Both sides are filters of one plan; cache the input when it is dear.
    """
    g = S.mol_graph(df, col)
    good = g.where(F.col("status").isNull()).drop("status")
    rejects = g.where(F.col("status").isNotNull()).select(*df.columns, F.col("status").alias("reason"))
    return good, rejects


def benzene_filter(df: DataFrame, col: str = "smiles", max_rings: int = 1,
                   banned_element: str = "Si") -> DataFrame:
    """The screening filter: valid molecules without ``banned_element`` and
    with at most ``max_rings`` benzene rings. A text without the element's name
    is not searched for it atom by atom."""
    g = S.mol_graph(df, col).where(F.col("status").isNull() & (S.benzene_rings() <= max_rings))
    return g.where(~F.col(col).contains(banned_element) | ~S.has_element(banned_element)).select(*df.columns)


def group_contribution(counts: DataFrame, params: DataFrame, baseline: float,
                       order_weights: Mapping[int, float] | None = None,
                       mol_col: str = "mol_id", group_col: str = "group_id", n_col: str = "n",
                       coef_col: str = "coef", alias: str = "delta", decimals: int = 4) -> DataFrame:
    """``baseline + sum(w_order * n * coef)`` per molecule.

    ``params`` is a dimension table (group id, coefficient), broadcast if it is
    small by count; it is joined from the left, so unknown groups add nothing and
    molecules with no known group keep the baseline. The order of a group
    comes from its id prefix (B24). Rounded half-to-even (B18).
    """
    w = order_weights or {1: 1.0, 2: 1.0, 3: 1.0}
    order = group_order(F.col(group_col))
    weight = F.when(order == 2, F.lit(w[2])).when(order == 3, F.lit(w[3])).otherwise(F.lit(w[1]))
    j = counts.join(hint_if_small(params.select(group_col, coef_col)), group_col, "left")
    contrib = F.coalesce(F.col(n_col) * F.col(coef_col) * weight, F.lit(0.0))
    return j.groupBy(mol_col).agg(F.bround(F.lit(baseline) + F.sum(contrib), decimals).alias(alias))


def explode_fragments(df: DataFrame, frags_col: str = "fragments", alias: str = "fragment") -> DataFrame:
    """One row per distinct fragment of each molecule; a fragment
    shared by two molecules stays twice (bag across molecules)."""
    others = [c for c in df.columns if c != frags_col]
    return df.select(*others, F.explode(F.array_distinct(F.col(frags_col))).alias(alias))


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """H3: the first row per key by an explicit order (unique per key, else any
    of the ties). An aggregate, so that a hot key is reduced before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def non_blank_rows(df: DataFrame, col: str) -> DataFrame:
    """Trim the key and drop blank ones."""
    return df.withColumn(col, strip_text(col)).where(non_blank(col))

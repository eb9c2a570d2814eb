"""Identifiers, folds and splits that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialise
from .reports import adaptive_bins, bin_index, group_mean
from .windows import global_row_number, ntile_of

# Multiplier and modulus of the seeded arithmetic hash, which any
# SQL engine can repeat.
HASH_FACTOR = 7919
HASH_PRIME = 1_000_003


def seeded(key, seed: int = 42, modulus: int = HASH_PRIME) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(c * F.lit(HASH_FACTOR) + F.lit(seed), F.lit(modulus))


def drop_missing(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, Observation]:
    """Rows with a value in all of ``cols``, and an observation of ``total`` and
    ``dropped`` that the same pass fills when the rows are used."""
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    seen = Observation()
    watched = df.withColumn("_missing", missing).observe(
        seen, F.count(F.lit(1)).alias("total"), F.count_if("_missing").alias("dropped"))
    return watched.where(~F.col("_missing")).drop("_missing"), seen


def assign_ids(df: DataFrame, key: str, order: str, alias: str = "mol_number") -> DataFrame:
    """dense ids from 0 in the order in which each key is first seen."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    ids = global_row_number(first, ["_first", key], "_id").select(F.col(key).alias("_key"), (F.col("_id") - 1).alias(alias))
    return df.join(ids, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def kfold(df: DataFrame, k: int, order: str, alias: str = "fold") -> DataFrame:
    """``k`` contiguous folds along ``order``; the first ``n % k`` hold one row more."""
    rows = global_row_number(df, [order], "_rn")
    n = df.agg(F.count(F.lit(1))).scalar()
    return rows.withColumn(alias, ntile_of(F.col("_rn"), n, k) - 1).drop("_rn")


def stratified_kfold(df: DataFrame, label: str, k: int, key: str, seed: int = 42, alias: str = "fold") -> DataFrame:
    """within each label rows are shuffled by a seeded hash and dealt out to ``k`` folds."""
    rows = global_row_number(df.withColumn("_h", seeded(key, seed)), ["_h", key], "_rn", [label])
    return rows.withColumn(alias, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_rn", "_h")


def random_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42, alias: str = "part_set") -> DataFrame:
    """``test`` for about ``share`` of the keys by a seeded hash, else ``train``."""
    return df.withColumn(alias, F.when(seeded(key, seed, 100) < int(round(share * 100)), "test").otherwise("train"))


def stratified_split(df: DataFrame, stratum: str, key: str, share: float = 0.2, seed: int = 42, alias: str = "part_set") -> DataFrame:
    """of each stratum the rounded ``share`` of its rows, first by seeded hash, is ``test``."""
    rows = global_row_number(df.withColumn("_h", seeded(key, seed)), ["_h", key], "_rn", [stratum])
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.floor(F.count(F.lit(1)) * F.lit(share) + 0.5).alias("_n"))
    joined = rows.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")))
    return joined.withColumn(alias, F.when(F.col("_rn") <= F.col("_n"), "test").otherwise("train")).drop("_rn", "_h", "_s", "_n")


def split_by_keys(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in ``keys``, and the others."""
    only = keys.select(F.col(key).alias("_key")).distinct()
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(only, same, "left_semi"), df.join(only, same, "left_anti")


def group_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """F8: (train, test) such that all rows of a key are on one side."""
    test = random_split(df.select(key).distinct(), key, share, seed).where("part_set = 'test'")
    inside, outside = split_by_keys(df, test, key)
    return outside, inside


def stratified_group_split(df: DataFrame, key: str, target: str, share: float = 0.2, seed: int = 42, candidates: Sequence[int] = (5, 4, 3, 2),
                           min_keys: int = 2) -> tuple[DataFrame, DataFrame]:
    """F8: (train, test) such that all rows of a key are on one side and the keys' mean targets spread alike over both.

    Keys fall into equal-width bins of their mean target, as many as leave
    ``min_keys`` in each; of every bin the rounded ``share`` is test. Where no
    number of bins does that, keys are split by their hash alone. Keys without
    any target are a stratum of their own.
    """
    keys = materialise(group_mean(df, key, target, "_mean").select(key, "_mean"), "split-keys")
    n = adaptive_bins(keys, "_mean", candidates, min_keys).first()["n_bins"]
    if n is None:
        chosen = random_split(keys, key, share, seed, "_side")
    else:
        low, high = keys.agg(F.min("_mean"), F.max("_mean")).first()
        bins = F.coalesce(bin_index(F.col("_mean"), F.lit(low), F.lit(high), n), F.lit(-1))
        chosen = stratified_split(keys.withColumn("_bin", bins), "_bin", key, share, seed, "_side")
    inside, outside = split_by_keys(df, chosen.where("_side = 'test'"), key)
    return outside, inside


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """H4: keys on both sides."""
    return a.select(key).intersect(b.select(key))

"""Expressions and table steps that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molsift.session import materialise

# The six ASCII white-space characters that separate words.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(df: DataFrame, rows: int = 2000, size: int = 4 << 20) -> None:
    """Let a Python worker see at most ``rows`` rows and ``size`` bytes at a time (one row at least), as texts may be long.

    Sets the session's limits per Arrow batch if they are higher.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(re.sub("[^0-9-]", "", conf.get(name))) <= most:
            conf.set(name, str(most))


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_bucket(h31: Column, n: Column) -> Column:
    """Range bucket 0..n-1 of a 31-bit hash; rises with the hash."""
    return F.shiftright(h31 * n, 31)


def hash31(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 33)


def numbered(df: DataFrame, order: list[str], out: str, label: str) -> DataFrame:
    """Add the row number (from 0) in the order of ``order`` over all rows.

    The rows are range-partitioned and written once, so the part a row is in
    is fixed before it is used twice: for the offset of its part (a window
    over as many rows as there are parts) and for its place in the part.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return (parts.join(offsets, "_part")
            .withColumn(out, (F.col("_before") + place).cast("long")).drop("_part", "_before"))

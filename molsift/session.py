"""Spark session helper and the few session-level settings the engine relies on."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings every job of the engine expects. AQE re-plans joins and coalesces
# small shuffle partitions at run time and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # GBK and other non-standard charsets for the text readers (A3).
    "spark.sql.legacy.javaCharsets": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "molsift") -> SparkSession:
    """Return the active session, or build a local one (tests, bench).

    On a cluster the session already exists and keeps its own settings; only
    settings that are unset are filled in.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions",
                             str(shuffle_partitions or int(cpus) * 2))
    builder = builder.config("spark.driver.memory", os.environ.get("MOLSIFT_DRIVER_MEM", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there. Only a local master may fall back
    on a scratch folder of its own; on any other master a missing setting is
    an error, because executors would not see a folder of the driver.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="molsift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows starts from files that every executor can
    read, so a lost executor costs no recomputation of the steps before.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/molsift/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, n: int | None = None, rows: int = 4_000) -> DataFrame:
    """Deal ``df`` out evenly, about ``rows`` rows to a task, before work that is dear per row.

    A scan splits files by bytes, so millions of short rows may come in a
    single task. ``n`` is the number of rows if it is known; else they are
    counted, so ``df`` should be a scan.
    """
    n = df.count() if n is None else n
    return df.repartition(math.ceil(n / rows)) if n > rows else df


def hint_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Mark ``df`` for broadcast only if counting shows at most ``max_rows``.

    Beyond that it stays unmarked and the join shuffles, with AQE splitting
    skewed partitions; the rows of the result are the same.
    """
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def _bytes_of(field: T.StructField) -> Column:
    """Bytes that a value of a column takes, roughly."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(field.dataType, T.ArrayType) and not isinstance(field.dataType.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
        return F.size(c) * 8
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.octet_length(F.to_json(F.struct(c)))
    return F.lit(8)


def broadcast_below(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """Mark ``df`` for broadcast only if its values take at most ``most_bytes``.

    ``df`` is scanned once for that, so it should be a table that has been
    written. Beyond the bound it stays unmarked and the join shuffles; the rows
    of the result are the same.
    """
    each = sum((F.coalesce(_bytes_of(f), F.lit(0)) for f in df.schema.fields), F.lit(16))
    size = df.agg(F.sum(each.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df

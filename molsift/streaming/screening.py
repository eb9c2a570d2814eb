"""Screening as file streams (J1-J3): the batch operators on arriving files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pareto import pareto_front
from ..operators.scoring import stotal


def stream_score(sdf: DataFrame, stats: Mapping[str, tuple[float, float]], out: str, checkpoint: str) -> StreamingQuery:
    """Score arriving molecules with frozen means and sigmas into a Parquet folder.

    The statistics must be frozen: they can't change once rows are written.
    """
    scored = stotal(sdf, stats=stats)
    return (scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def _version(base: str, batch: int) -> str:
    return f"{base.rstrip('/')}/front-{batch:012d}"


def _stored_before(spark: SparkSession, base: str, batch: int) -> DataFrame | None:
    """The front written by the latest batch before ``batch``, through Spark's reader."""
    index = f"{base.rstrip('/')}/versions"
    try:
        known = spark.read.schema("batch long").parquet(index).where(F.col("batch") < batch).agg(F.max("batch")).first()[0]
    except Exception as e:  # no version yet: the index does not exist
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return None if known is None else spark.read.parquet(_version(base, known))


def stream_pareto(sdf: DataFrame, maximize: Sequence[str], minimize: Sequence[str], base: str, checkpoint: str) -> StreamingQuery:
    """Running Pareto front of everything that has arrived.

    Each batch merges its rows with the stored front into a new version named
    by the batch, so a batch that is replayed writes the same version again.
    The front of a union is the front of the fronts, so no row is kept twice.
    """
    def merge(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = _stored_before(spark, base, batch)
        every = rows if before is None else before.unionByName(rows)
        pareto_front(every, maximize=maximize, minimize=minimize).write.mode("overwrite").parquet(_version(base, batch))
        spark.range(batch, batch + 1).select(F.col("id").alias("batch")).write.mode("append").parquet(f"{base.rstrip('/')}/versions")

    return sdf.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_front(spark: SparkSession, base: str) -> DataFrame | None:
    return _stored_before(spark, base, 1 << 62)


def stream_moments(sdf: DataFrame, cols: Sequence[str], name: str) -> StreamingQuery:
    """Running counts, sums and moments of ``cols``, one row, in complete mode (memory table ``name``)."""
    aggs = [F.count(F.lit(1)).alias("total")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return sdf.agg(*aggs).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()

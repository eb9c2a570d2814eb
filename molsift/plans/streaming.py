"""Streams over the part files of a table; each equals its batch query."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..operators.pareto import dominance_sql
from ..operators.scoring import frozen_stats, score_features
from ..session import ensure_checkpoint_dir
from ..sources.views import v_obj, v_score
from ..streaming.screening import latest_front, stream_moments, stream_pareto, stream_score
from .registry import query
from .screening import OBJ_MAX, OBJ_MIN, QUERY_STOTAL_SQL


def _arriving(spark, df, times: int, rows: int = 500_000):
    """``df`` written as part files of about ``rows`` rows at most and read back as a stream that arrives in ``times`` parts, of as many files each."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/molsift/stream-{uuid.uuid4().hex}"
    each = max(1, math.ceil(df.count() / (times * rows)))
    df.repartition(times * each).write.parquet(f"{base}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(f"{base}/in"), base


@query("stream_score", "J1", sql=QUERY_STOTAL_SQL)
def q_stream_score(spark, sf):
    v = v_score(spark, sf)
    stats = frozen_stats(score_features(v), ["neg_logp", "hbd_hba", "logs"])
    sdf, base = _arriving(spark, v, 4)
    stream_score(sdf, stats, f"{base}/out", f"{base}/state").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.round("stotal", 6).alias("stotal"), F.round("predicted_probability", 6).alias("predicted_probability"))


@query("stream_pareto", "J2 G4", sql=dominance_sql("v_obj", OBJ_MAX, OBJ_MIN))
def q_stream_pareto(spark, sf):
    sdf, base = _arriving(spark, v_obj(spark, sf), 3)
    stream_pareto(sdf, OBJ_MAX, OBJ_MIN, f"{base}/front", f"{base}/state").awaitTermination()
    return latest_front(spark, f"{base}/front")


@query("stream_moments", "J3", sql="""SELECT count(*) AS total, count(hbd) AS hbd_n, round(avg(hbd), 6) AS hbd_mean, round(stddev_pop(hbd), 6) AS hbd_sd,
 min(hbd) AS hbd_min, max(hbd) AS hbd_max FROM v_score""")
def q_stream_moments(spark, sf):
    sdf, _ = _arriving(spark, v_score(spark, sf), 4)
    name = f"moments_{uuid.uuid4().hex}"
    stream_moments(sdf, ["hbd"], name).awaitTermination()
    return spark.table(name).withColumns({c: F.round(c, 6) for c in ("hbd_mean", "hbd_sd")})

"""Screening queries: composite score, statistics, reports and the Pareto
front (build plan phase P1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import is_finite, to_double
from ..operators.pareto import breakthrough, dominance_sql, pareto_front
from ..operators.reports import extremes, property_report, summary
from ..operators.scoring import moments, score_features, stotal
from ..operators.windows import rank_desc
from ..sources.tables import conform, union_all
from ..sources.views import table, v_obj, v_score
from .registry import query

OBJ_MAX, OBJ_MIN = ["td", "stotal"], ["sa"]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def new_and_known(spark, sf):
    """The candidate library and the known materials under their own names,
    conformed to the canonical schema (B1) and tagged (B20)."""
    obj = v_obj(spark, sf)
    new = obj.where(F.col("source_file") == "reasonable").select(
        "mol_id", F.col("td").alias("thermal_decomposition_temperature"),
        F.col("stotal").alias("Stotal"), F.col("sa").alias("SA_Score"))
    known = obj.where(F.col("source_file") == "original").select(
        "mol_id", F.col("td").alias("Median"), F.col("stotal").alias("Stotal"),
        F.col("sa").alias("SA_Score"))
    canon = {"thermal_decomposition_temperature": "td", "Median": "td", "Stotal": "stotal",
             "SA_Score": "sa"}
    return conform(new, canon), conform(known, canon)


@query("pareto_breakthrough", "G5 G4 B1 B5 B20 H1 D9",
       sql=f"SELECT * FROM ({dominance_sql('v_obj', OBJ_MAX, OBJ_MIN)}) f WHERE source_file = 'reasonable'")
def q_pareto_breakthrough(spark, sf):
    new, known = new_and_known(spark, sf)
    return breakthrough(new, known, OBJ_MAX, OBJ_MIN).select(
        "mol_id", "td", "stotal", "sa", "source_file")


@query("pareto_front", "G4 D9", sql=dominance_sql("v_obj", OBJ_MAX, OBJ_MIN))
def q_pareto_front(spark, sf):
    return pareto_front(v_obj(spark, sf), maximize=OBJ_MAX, minimize=OBJ_MIN)


@query("pareto_front_2d", "G4", sql=dominance_sql("v_obj", ["td"], ["sa"]))
def q_pareto_front_2d(spark, sf):
    return pareto_front(v_obj(spark, sf), maximize=["td"], minimize=["sa"])


_STATS_SQL = """stats AS (SELECT
 avg(-logp) AS m1, CASE WHEN stddev_pop(-logp) > 0 THEN stddev_pop(-logp) ELSE 1.0 END AS s1,
 avg(hbd + hba) AS m2, CASE WHEN stddev_pop(hbd + hba) > 0 THEN stddev_pop(hbd + hba) ELSE 1.0 END AS s2,
 avg(logs) AS m3, CASE WHEN stddev_pop(logs) > 0 THEN stddev_pop(logs) ELSE 1.0 END AS s3 FROM v_score)"""


_STOTAL_SQL = f"""WITH {_STATS_SQL},
sc AS (SELECT v.*, -0.4345 + 0.0124 * ((-logp - m1) / s1) + 0.2086 * ((hbd + hba - m2) / s2)
 + 2.4509 * ((logs - m3) / s3) AS st FROM v_score v, stats)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, %s
 round(st, 6) AS stotal, round(1 / (1 + exp(-st)), 6) AS predicted_probability FROM sc"""
QUERY_STOTAL_SQL = _STOTAL_SQL % ""


@query("stotal_score", "B6 B7 B8 B10 E1 D8 B2", sql=_STOTAL_SQL % "logp, hbd, hba, logs,")
def q_stotal_score(spark, sf):
    out = stotal(v_score(spark, sf))
    return out.withColumns({"stotal": r6("stotal"),
                            "predicted_probability": r6("predicted_probability")})


@query("score_moments", "E1 B6", sql="""SELECT
 round(avg(-logp), 6) AS neg_logp_mean, round(CASE WHEN stddev_pop(-logp) > 0 THEN stddev_pop(-logp) ELSE 1.0 END, 6) AS neg_logp_sd, count(logp) AS neg_logp_n,
 round(avg(hbd + hba), 6) AS hbd_hba_mean, round(CASE WHEN stddev_pop(hbd + hba) > 0 THEN stddev_pop(hbd + hba) ELSE 1.0 END, 6) AS hbd_hba_sd, count(hbd + hba) AS hbd_hba_n,
 round(avg(logs), 6) AS logs_mean, round(CASE WHEN stddev_pop(logs) > 0 THEN stddev_pop(logs) ELSE 1.0 END, 6) AS logs_sd, count(logs) AS logs_n
FROM v_score""")
def q_score_moments(spark, sf):
    m = moments(score_features(v_score(spark, sf)), ["neg_logp", "hbd_hba", "logs"])
    return m.select(*[r6(c).alias(c) if not c.endswith("_n") else F.col(c) for c in m.columns])


@query("property_report", "E2 B21", sql="""WITH s AS (SELECT
 CAST(count(*) AS DOUBLE) AS total,
 CAST(count(*) FILTER (WHERE hbd IS NOT NULL AND logp IS NOT NULL) AS DOUBLE) AS success,
 min(CASE WHEN hbd IS NOT NULL THEN CAST(hbd AS DOUBLE) END) AS min_hbd,
 max(CASE WHEN hbd IS NOT NULL THEN CAST(hbd AS DOUBLE) END) AS max_hbd,
 avg(CASE WHEN hbd IS NOT NULL THEN hbd END) AS avg_hbd,
 min(CASE WHEN hbd IS NOT NULL THEN logp END) AS min_logp,
 max(CASE WHEN hbd IS NOT NULL THEN logp END) AS max_logp,
 avg(CASE WHEN hbd IS NOT NULL THEN logp END) AS avg_logp FROM v_score)
SELECT metric, round(value, 6) AS value FROM (
 SELECT 'total' AS metric, total AS value FROM s UNION ALL
 SELECT 'success', success FROM s UNION ALL
 SELECT 'failed', total - success FROM s UNION ALL
 SELECT 'success_pct', CASE WHEN total > 0 THEN 100.0 * success / total ELSE 0 END FROM s UNION ALL
 SELECT 'failed_pct', CASE WHEN total > 0 THEN 100.0 * (total - success) / total ELSE 0 END FROM s UNION ALL
 SELECT 'min_hbd', min_hbd FROM s UNION ALL SELECT 'max_hbd', max_hbd FROM s UNION ALL
 SELECT 'avg_hbd', avg_hbd FROM s UNION ALL SELECT 'min_logp', min_logp FROM s UNION ALL
 SELECT 'max_logp', max_logp FROM s UNION ALL SELECT 'avg_logp', avg_logp FROM s) t""")
def q_property_report(spark, sf):
    rep = property_report(v_score(spark, sf), ["hbd", "logp"])
    return rep.select("metric", r6("value").alias("value"))


@query("summary_totalprice", "E4", sql="""SELECT 'o_totalprice' AS "column", count(o_totalprice) AS n,
 min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 6) AS mean,
 round(stddev_samp(o_totalprice), 6) AS std, round(stddev_pop(o_totalprice), 6) AS std_pop FROM orders""")
def q_summary_totalprice(spark, sf):
    s = summary(table(spark, sf, "orders"), ["o_totalprice"])
    return s.withColumns({c: r6(c) for c in ("mean", "std", "std_pop")})


@query("finite_objectives", "B3 B5", sql="""WITH t AS (SELECT mol_id, td, CASE mol_id % 5
 WHEN 0 THEN 'NaN' WHEN 1 THEN 'inf' WHEN 2 THEN ' -Infinity ' WHEN 3 THEN 'n/a' ELSE CAST(stotal AS VARCHAR) END AS stotal_text FROM v_obj)
SELECT mol_id, td, CAST(TRY_CAST(trim(stotal_text) AS DOUBLE) AS DOUBLE) AS stotal FROM t
WHERE NOT isnan(TRY_CAST(trim(stotal_text) AS DOUBLE)) AND NOT isinf(TRY_CAST(trim(stotal_text) AS DOUBLE))""")
def q_finite_objectives(spark, sf):
    obj = v_obj(spark, sf)
    text = (F.when(F.col("mol_id") % 5 == 0, F.lit("NaN")).when(F.col("mol_id") % 5 == 1, F.lit("inf"))
            .when(F.col("mol_id") % 5 == 2, F.lit(" -Infinity ")).when(F.col("mol_id") % 5 == 3, F.lit("n/a"))
            .otherwise(F.col("stotal").cast("string")))
    t = obj.select("mol_id", "td", text.alias("stotal_text"))
    parsed = t.select("mol_id", "td", F.trim("stotal_text").try_cast("double").alias("stotal"))
    return parsed.where(is_finite("stotal"))


@query("coerce_numeric", "B3", sql="""SELECT event_id, TRY_CAST(trim(props) AS DOUBLE) AS props_num,
 CASE WHEN isnan(TRY_CAST(trim(CAST(value AS VARCHAR)) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(CAST(value AS VARCHAR)) AS DOUBLE) END AS value_num FROM events""")
def q_coerce_numeric(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", to_double("props").alias("props_num"), to_double("value").alias("value_num"))


@query("union_tagged", "H1 B1 B20", sql="""SELECT mol_id, td, stotal, sa, source_file FROM v_obj""")
def q_union_tagged(spark, sf):
    new, known = new_and_known(spark, sf)
    return union_all([new.withColumn("source_file", F.lit("reasonable")),
                      known.withColumn("source_file", F.lit("original"))]) \
        .select("mol_id", "td", "stotal", "sa", "source_file")


@query("rank_by_td", "G1", sql="""SELECT mol_id, td, rank() OVER (ORDER BY td DESC) AS rank FROM v_obj""")
def q_rank_by_td(spark, sf):
    obj = v_obj(spark, sf).select("mol_id", "td")
    return rank_desc(obj, "td").select("mol_id", "td", "rank").orderBy(F.col("td").desc())


@query("extremes_td", "G3", sql="""SELECT max(td) AS max_value,
 (SELECT min(mol_id) FROM v_obj WHERE td = (SELECT max(td) FROM v_obj)) AS key_at_max,
 min(td) AS min_value, (SELECT min(mol_id) FROM v_obj WHERE td = (SELECT min(td) FROM v_obj)) AS key_at_min,
 count(*) AS n FROM v_obj""")
def q_extremes_td(spark, sf):
    return extremes(v_obj(spark, sf), "mol_id", "td")


@query("top10_totalprice", "G2", sql="""SELECT o_orderkey, o_totalprice FROM orders
 ORDER BY abs(o_totalprice) DESC, o_orderkey LIMIT 10""")
def q_top10_totalprice(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_totalprice").orderBy(
        F.abs("o_totalprice").desc(), F.col("o_orderkey")).limit(10)

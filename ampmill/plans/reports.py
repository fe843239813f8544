"""Queries of refresh lists, reports and remaining operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampmill.operators import catalogue, observations, quality, specs
from ampmill.operators import text as tx
from ampmill.plans.models import FIT_SQL, PREDICTED_SQL
from ampmill.plans.observed import FOLDED_SQL
from ampmill.session import table
from ampmill.sources.derived import DOBS_SQL, DPARTS_SQL, dobs, dparts


def e15_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dparts(spark, sf_dir)
    return d.select("pk", F.array_join(quality.missing_fields(d), ",").alias("missing"))


def g8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = specs.with_foms(specs.complete_gate_charge(dparts(spark, sf_dir)))
    return quality.reason_counts(d.withColumn("v", specs.violations(d)), "mfr", F.col("v"))


def g9_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = dobs(spark, sf_dir).withColumn("pipeline", F.concat(F.lit("p"), F.col("cond_vgs").cast("int").cast("string")))
    return quality.scoreboard(o, "pipeline", ["Qg", "Vsd", "Coss"]).select("pipeline", *[F.col(c).cast("long").alias(c.lower()) for c in ("Qg", "Vsd", "Coss")])


def g11_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dparts(spark, sf_dir).select("pk", "housing", (F.col("rds_on") * 1e3).alias("p"))
    return quality.shares(d, "housing", "p").select("pk", F.round("of_group", 6).alias("of_group"), F.round("of_all", 6).alias("of_all"))


def h19_fom_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = F.col("pk")
    d = dparts(spark, sf_dir).select("pk", "rds_on", "qrr", (F.col("trr") * 4).alias("trr"), (10.0 + pk % 50).alias("i_f"), ((100.0 + (pk % 9) * 50) * 1e6).alias("didt"), F.lit(30.0).alias("op_if"), F.lit(300e6).alias("op_didt"))
    return quality.fom_qrr_at(d).select("pk", F.round(F.col("qrr_op") * 1e9, 5).alias("qrr_op_nc"), F.round("fom_qrr_op", 5).alias("fom_qrr_op"))


def h21_tau_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(k.alias("part"), (25.0 + F.col("l_linenumber") * 15).alias("tj"), (F.pow((298.15 + F.col("l_linenumber") * 15) / 298.15, 1.0 + (k % 20) * 0.3) * (1 + (F.col("l_suppkey") % 7 - 3) * 0.01)).alias("qrr_ratio"))
    return quality.tau_exponent(rows, "part").select("part", F.round("n_tau", 5).alias("n_tau"), "points")


def h16_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponent of every part: its own fit, its maker's pool, or the conservative value."""
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(k.alias("pk"), (25.0 + F.col("l_linenumber") * 15).alias("tj"), (F.pow((298.15 + F.col("l_linenumber") * 15) / 298.15, 1.0 + (k % 20) * 0.3) * (1 + (F.col("l_suppkey") % 7 - 3) * 0.01)).alias("qrr_ratio"))
    parts = dparts(spark, sf_dir).select("pk", F.when(F.col("pk") % 11 != 0, F.col("mfr")).alias("family"))
    return quality.resolved_exponent(parts, quality.tau_exponent(rows, "pk"), "pk", "family").select("pk", F.round("n_tau", 5).alias("n_tau"), "state")


def g9_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each pipeline that agree with the fused record."""
    o = dobs(spark, sf_dir)
    p = o.withColumn("pipeline", F.concat(F.lit("p"), F.col("cond_vgs").cast("int").cast("string")))
    return quality.equal_scoreboard(observations.fold(o, ["part", "symbol"]), p, "pipeline", ["part", "symbol"])


def c19_text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "text_rows").select("mpn", "page_num", "text_row_id", "text", tx.detect_symbol(F.col("text")).alias("symbol"))
    return quality.text_values(t, ["mpn", "page_num"], "text_row_id", "symbol", "text")


def c20_recovery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "text_rows").select("text_row_id", "mpn", "page_num", "text", tx.maker_tag(F.col("mfr")).alias("tag"))
    own = quality.vendor_recovery(t, ["mpn", "page_num"], "text_row_id", "tag")
    r = t.select("text_row_id", quality.recovery_rows(F.col("text")).alias("r")).filter("r is not null").select("text_row_id", "r.*")
    return r.join(own.select("text_row_id"), "text_row_id", "left_anti").unionByName(own)


def w11_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of each part that lie within, and outside, the wanted ones."""
    have = dobs(spark, sf_dir).groupBy("part").agg(F.collect_set("symbol").alias("h"))
    want = F.array(*map(F.lit, ("Qg", "Vsd", "Coss")))
    return have.select("part", F.size(F.array_intersect("h", want)).alias("within"), F.size(F.array_except("h", want)).alias("outside"))


def f14_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that the similarity can rate at all."""
    return dparts(spark, sf_dir).filter(" and ".join(f"{c} > 0" for c in catalogue.REQUIRED)).select("pk")


QUERIES = {f.__name__: f for f in (e15_refresh, g8_reasons, g9_scoreboard, g11_shares, h19_fom_at, h21_tau_exponent, h16_exponent, g9_equal, c19_text_values, c20_recovery_rows, w11_set_operations, f14_required)}

_MISS = ", ".join(f"CASE WHEN NOT coalesce({c} {'>=' if c == 'qrr' else '>'} {lo} AND {c} < {hi}, false) THEN '{c}' END" for c, (lo, hi) in quality.SERVED.items())
_PRES = "(CASE WHEN vmin IS NULL THEN 0 ELSE 1 END + CASE WHEN vtyp IS NULL THEN 0 ELSE 1 END + CASE WHEN vmax IS NULL THEN 0 ELSE 1 END)"
SQL = {
    "e15_refresh": f"WITH {DPARTS_SQL} SELECT pk, concat_ws(',', {_MISS}) AS missing FROM dparts",
    "g9_scoreboard": f"WITH {DOBS_SQL} SELECT concat('p', CAST(CAST(floor(cond_vgs) AS INTEGER) AS VARCHAR)) AS pipeline, " + ", ".join(f"CAST(sum(CASE WHEN symbol = '{c}' THEN {_PRES} ELSE 0 END) AS BIGINT) AS {c.lower()}" for c in ("Qg", "Vsd", "Coss")) + " FROM dobs GROUP BY 1",
    "g11_shares": f"WITH {DPARTS_SQL} SELECT pk, round(rds_on * 1e3 / sum(rds_on * 1e3) OVER (PARTITION BY housing) * 100, 6) AS of_group, round(rds_on * 1e3 / sum(rds_on * 1e3) OVER () * 100, 6) AS of_all FROM dparts",
    "h21_tau_exponent": """WITH x AS (SELECT l_partkey AS part, ln((298.15::DOUBLE + l_linenumber * 15) / 298.15) AS x, ln(pow((298.15::DOUBLE + l_linenumber * 15) / 298.15, 1 + (l_partkey % 20) * 0.3::DOUBLE) * (1 + (l_suppkey % 7 - 3) * 0.01::DOUBLE)) AS y FROM lineitem)
        SELECT part, round(least(5, greatest(0, sum(x * y) / sum(x * x))), 5) AS n_tau, count(*) AS points FROM x GROUP BY part""",
    "h16_exponent": f"""WITH {DPARTS_SQL}, x AS (SELECT l_partkey AS part, ln((298.15::DOUBLE + l_linenumber * 15) / 298.15) AS x, ln(pow((298.15::DOUBLE + l_linenumber * 15) / 298.15, 1 + (l_partkey % 20) * 0.3::DOUBLE) * (1 + (l_suppkey % 7 - 3) * 0.01::DOUBLE)) AS y FROM lineitem WHERE l_quantity > 45),
        g AS (SELECT part, least(5, greatest(0, sum(x * y) / sum(x * x))) AS n FROM x GROUP BY part HAVING count(*) >= 3), o AS (SELECT pk, CASE WHEN pk % 11 <> 0 THEN mfr END AS fam, n FROM dparts LEFT JOIN g ON pk = part),
        f AS (SELECT fam, avg(n) AS pooled FROM o WHERE n IS NOT NULL AND fam IS NOT NULL GROUP BY fam)
        SELECT pk, round(coalesce(n, pooled, 1.2), 5) AS n_tau, CASE WHEN n IS NOT NULL THEN 'measured' WHEN pooled IS NOT NULL THEN 'family' ELSE 'conservative' END AS state FROM o LEFT JOIN f ON o.fam = f.fam""",
    "h19_fom_at": f"""WITH {DPARTS_SQL}, {FIT_SQL}, q0 AS (SELECT pk, (r.lo + r.hi) / 2 AS life, td, 30::DOUBLE AS oi, 300e6::DOUBLE AS oa FROM f8), {PREDICTED_SQL}
        SELECT d.pk, round(CASE WHEN d.qrr = 0 THEN 0 ELSE x * x / (2 * oa) + x * q4.d END * 1e9, 5) AS qrr_op_nc, round(d.rds_on * CASE WHEN d.qrr = 0 THEN 0 ELSE x * x / (2 * oa) + x * q4.d END * 1e12, 5) AS fom_qrr_op FROM dparts d LEFT JOIN q4 ON d.pk = q4.pk""",
    "g9_equal": f"{FOLDED_SQL} SELECT pipeline, symbol, CAST(sum(CASE WHEN abs(fu.vmin - o.vmin) / abs(fu.vmin) < 0.05 THEN 1 ELSE 0 END + CASE WHEN abs(fu.vtyp - o.vtyp) / abs(fu.vtyp) < 0.05 THEN 1 ELSE 0 END + CASE WHEN abs(fu.vmax - o.vmax) / abs(fu.vmax) < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_equal FROM (SELECT *, concat('p', CAST(CAST(floor(cond_vgs) AS INTEGER) AS VARCHAR)) AS pipeline FROM dobs) o JOIN fu USING (part, symbol) GROUP BY pipeline, symbol",
    "w11_set_operations": f"WITH {DOBS_SQL} SELECT part, CAST(count(DISTINCT CASE WHEN symbol IN ('Qg', 'Vsd', 'Coss') THEN symbol END) AS INTEGER) AS within, CAST(count(DISTINCT CASE WHEN symbol NOT IN ('Qg', 'Vsd', 'Coss') THEN symbol END) AS INTEGER) AS outside FROM dobs GROUP BY part",
    "f14_required": f"WITH {DPARTS_SQL} SELECT pk FROM dparts WHERE vds > 0 AND rds_on > 0",
}

"""Domain tables derived from the generic test tables, so that every operator runs over whole tables of any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampmill.session import table


def _d(c: Column) -> Column:
    return c.cast("double")


def dparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transistor per row of part, with all engineering columns in SI units (nulls included)."""
    pk, size = F.col("p_partkey"), F.col("p_size")
    voltages = [30, 40, 60, 80, 100, 120, 150, 200, None, -60]
    vds = F.lit(None).cast("double")
    for i, v in enumerate(voltages):
        if v is not None:
            vds = F.when(size % 10 == i, float(v)).otherwise(vds)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    p = p.withColumn("qg", (10 + _d((pk * 3) % 190)) * 1e-9)
    return p.select(
        pk.alias("pk"),
        F.lower("p_brand").alias("mfr"),
        F.concat(F.lit("P"), pk.cast("string")).alias("mpn"),
        F.col("p_type").alias("housing"),
        F.when(size % 3 == 0, "Si").when(size % 3 == 2, "SiC").alias("substrate"),
        vds.alias("vds"),
        ((0.5 + _d(pk % 97) * 0.25) * 1e-3).alias("rds_on"),
        F.when(pk % 23 != 0, 10 + _d((pk * 7) % 291)).alias("id"),
        "qg",
        (F.col("qg") * (0.20 + _d(pk % 11) * 0.01)).alias("qgs"),
        (F.col("qg") * (0.15 + _d(pk % 17) * 0.01)).alias("qgd"),
        F.when(pk % 13 == 0, None).when(pk % 29 == 0, 0.0).otherwise((20 + _d((pk * 11) % 480)) * 1e-9).alias("qrr"),
        ((15 + _d((pk * 5) % 60)) * 1e-9).alias("trr"),
        (F.when(pk % 17 == 0, -1.0).otherwise(1.0) * (0.70 + _d(pk % 50) * 0.01)).alias("vsd"),
        F.when(pk % 5 != 0, 3.0 + _d(pk % 30) * 0.1).alias("vpl"),
        ((200 + _d((pk * 13) % 2800)) * 1e-12).alias("coss"),
        F.when(pk % 7 != 0, 0.5 + _d(pk % 40) * 0.1).alias("rg"),
    )


#: The same rows as a common table expression for the SQL check.
DPARTS_SQL = """dparts AS (
  SELECT p_partkey AS pk, lower(p_brand) AS mfr, concat('P', CAST(p_partkey AS VARCHAR)) AS mpn, p_type AS housing,
    CASE p_size % 3 WHEN 0 THEN 'Si' WHEN 2 THEN 'SiC' END AS substrate,
    CAST(CASE p_size % 10 WHEN 0 THEN 30 WHEN 1 THEN 40 WHEN 2 THEN 60 WHEN 3 THEN 80 WHEN 4 THEN 100 WHEN 5 THEN 120 WHEN 6 THEN 150 WHEN 7 THEN 200 WHEN 9 THEN -60 END AS DOUBLE) AS vds,
    (CAST(0.5 AS DOUBLE) + CAST(p_partkey % 97 AS DOUBLE) * CAST(0.25 AS DOUBLE)) * CAST(1e-3 AS DOUBLE) AS rds_on,
    CASE WHEN p_partkey % 23 <> 0 THEN 10 + CAST((p_partkey * 7) % 291 AS DOUBLE) END AS id,
    (10 + CAST((p_partkey * 3) % 190 AS DOUBLE)) * CAST(1e-9 AS DOUBLE) AS qg,
    (10 + CAST((p_partkey * 3) % 190 AS DOUBLE)) * CAST(1e-9 AS DOUBLE) * (CAST(0.20 AS DOUBLE) + CAST(p_partkey % 11 AS DOUBLE) * CAST(0.01 AS DOUBLE)) AS qgs,
    (10 + CAST((p_partkey * 3) % 190 AS DOUBLE)) * CAST(1e-9 AS DOUBLE) * (CAST(0.15 AS DOUBLE) + CAST(p_partkey % 17 AS DOUBLE) * CAST(0.01 AS DOUBLE)) AS qgd,
    CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN CAST(0 AS DOUBLE) ELSE (20 + CAST((p_partkey * 11) % 480 AS DOUBLE)) * CAST(1e-9 AS DOUBLE) END AS qrr,
    (15 + CAST((p_partkey * 5) % 60 AS DOUBLE)) * CAST(1e-9 AS DOUBLE) AS trr,
    CASE WHEN p_partkey % 17 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * (CAST(0.70 AS DOUBLE) + CAST(p_partkey % 50 AS DOUBLE) * CAST(0.01 AS DOUBLE)) AS vsd,
    CASE WHEN p_partkey % 5 <> 0 THEN CAST(3.0 AS DOUBLE) + CAST(p_partkey % 30 AS DOUBLE) * CAST(0.1 AS DOUBLE) END AS vpl,
    (200 + CAST((p_partkey * 13) % 2800 AS DOUBLE)) * CAST(1e-12 AS DOUBLE) AS coss,
    CASE WHEN p_partkey % 7 <> 0 THEN CAST(0.5 AS DOUBLE) + CAST(p_partkey % 40 AS DOUBLE) * CAST(0.1 AS DOUBLE) END AS rg
  FROM part)"""


def dobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations (part, ord, symbol, vmin, vtyp, vmax, unit, cond_vgs) from lineitem, in arrival order ord."""
    symbols = ["Qg", "Qgs", "Qgd", "Rds_on", "Vsd", "Coss", "Qrr"]
    n = F.col("l_linenumber")
    symbol, unit = F.lit(symbols[0]), F.lit("nC")
    for i, s in enumerate(symbols):
        symbol = F.when(n % 7 == i, s).otherwise(symbol)
    unit = F.when(symbol == "Rds_on", F.when(F.col("l_suppkey") % 2 == 0, "mΩ").otherwise("Ω")).when(symbol == "Vsd", "V").when(symbol == "Coss", F.when(F.col("l_suppkey") % 2 == 0, "pF").otherwise("nF")).otherwise(F.when(F.col("l_suppkey") % 4 == 0, "µC").otherwise("nC"))
    typ = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"),
        (F.col("l_orderkey") * 8 + n).alias("ord"),
        symbol.alias("symbol"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity") * (1 - F.col("l_discount"))).alias("vmin"),
        typ.alias("vtyp"),
        (typ * (1 + F.col("l_tax") * 10)).alias("vmax"),
        unit.alias("unit"),
        F.when(F.col("l_suppkey") % 3 == 0, 4.5).when(F.col("l_suppkey") % 3 == 1, 6.0).otherwise(10.0).alias("cond_vgs"),
    )


DOBS_SQL = """dobs AS (
  SELECT l_partkey AS part, l_orderkey * 8 + l_linenumber AS ord,
    CASE l_linenumber % 7 WHEN 0 THEN 'Qg' WHEN 1 THEN 'Qgs' WHEN 2 THEN 'Qgd' WHEN 3 THEN 'Rds_on' WHEN 4 THEN 'Vsd' WHEN 5 THEN 'Coss' ELSE 'Qrr' END AS symbol,
    CASE WHEN l_linestatus = 'O' THEN l_quantity * (1 - l_discount) END AS vmin,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS vtyp,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity * (1 + l_tax * 10) END AS vmax,
    CASE l_linenumber % 7 WHEN 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'mΩ' ELSE 'Ω' END WHEN 4 THEN 'V'
      WHEN 5 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'pF' ELSE 'nF' END ELSE CASE WHEN l_suppkey % 4 = 0 THEN 'µC' ELSE 'nC' END END AS unit,
    CASE l_suppkey % 3 WHEN 0 THEN CAST(4.5 AS DOUBLE) WHEN 1 THEN CAST(6 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS cond_vgs
  FROM lineitem)"""

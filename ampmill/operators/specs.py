"""Engineering records: gate-charge completion, figures of merit, range checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: share of the gate-source charge taken above the threshold where nothing better is known.
QGS2_SHARE = 0.55


def passes(condition: Column) -> Column:
    """A filter that missing values pass: only a definite false drops a row."""
    return F.coalesce(condition, F.lit(True))


def zero_is_missing(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def complete_gate_charge(df: DataFrame) -> DataFrame:
    """Adds qgs2, qg_th, qsw and qg_th_estimated to a frame with qgs, qgd and, where present, qgs2_raw, qsw_raw, qg_th.

    Charges that follow from two others are derived; the threshold charge is estimated as a share of qgs
    where nothing else gives it, and flagged. Zero counts as missing. Nulls stay null.
    """
    have = set(df.columns)
    get = lambda c: zero_is_missing(F.col(c)) if c in have else F.lit(None).cast("double")
    qgs, qgd, qgs2, qsw, qth = get("qgs"), get("qgd"), get("qgs2_raw"), get("qsw_raw"), get("qg_th")
    df = df.withColumn("__qgs2", F.coalesce(qgs2, F.when(qsw > qgd, qsw - qgd))).withColumn("__qsw", qsw).withColumn("__qth", qth)
    df = df.withColumn("qgd", F.coalesce(qgd, F.col("__qsw") - F.col("__qgs2")))
    known = F.coalesce(F.col("__qth"), F.when(F.col("__qsw").isNotNull(), qgs + F.col("qgd") - F.col("__qsw")), qgs - F.col("__qgs2"))
    df = df.withColumn("qg_th", F.coalesce(known, qgs * (1 - QGS2_SHARE))).withColumn("qg_th_estimated", known.isNull() & qgs.isNotNull())
    df = df.withColumn("qgs2", F.coalesce(F.col("__qgs2"), qgs - F.col("qg_th"), qgs * QGS2_SHARE))
    return df.withColumn("qsw", F.coalesce(F.col("__qsw"), F.col("qgd") + F.col("qgs2"))).drop("__qgs2", "__qsw", "__qth")


def with_foms(df: DataFrame) -> DataFrame:
    """Figures of merit in mΩ·nC (coss: mΩ·pF), sync and overdrive charge, self turn-on ratio; df has the completed charges."""
    per = lambda q, unit: F.col("rds_on") * 1e3 * F.col(q) * unit
    return df.select(
        "*",
        per("qg", 1e9).alias("fom"),
        per("qrr", 1e9).alias("fom_qrr"),
        per("qsw", 1e9).alias("fom_qsw"),
        per("coss", 1e12).alias("fom_coss"),
        (F.col("qg") - F.col("qgd")).alias("qg_sync"),
        (F.col("qg") - F.col("qgd") - F.col("qgs")).alias("qg_odr"),
        F.try_divide("qgd", "qgs").alias("qgd_qgs_ratio"),
        coss_v0(F.col("vds")).alias("coss_v0"),
    )


def coss_v0(vds: Column) -> Column:
    """The voltage at which the output capacitance is taken to be given: half the rated one, null where that is 1 V or less."""
    return F.when(F.abs(vds) > 1, F.abs(vds) / 2)


def violations(df: DataFrame) -> Column:
    """Names of the range rules that a record breaks, in the rules' order; a rule with a missing value isn't applied."""
    c = F.col
    fom = c("rds_on") * c("qg") * 1e12
    rules = [
        ("vpl", c("vpl").between(2, 9)),
        ("fom", (fom > 10) & (fom < 20000)),
        ("qg", (c("qg") > 0.2e-9) & (c("qg") < 2000e-9)),
        ("qrr", (c("qrr") >= 0) & (c("qrr") < 200e-6)),
        ("qrr_trr", F.try_divide("qrr", "trr").between(0.01, 40)),
        ("vsd", (F.abs("vsd") > 0.2) & (F.abs("vsd") < 5)),
        ("qg_rds", (c("qg") * c("rds_on") > 2e-11) & (c("qg") * c("rds_on") < 2e-8)),
        ("qg_th_qgs", (F.try_divide("qg_th", "qgs") > 0.2) & (F.try_divide("qg_th", "qgs") < 0.8)),
    ]
    if "t_rise" in df.columns:
        rules += [("t_rise", (c("t_rise") >= 0.5e-9) & (c("t_rise") < 1000e-9)), ("t_fall", (c("t_fall") > 0.5e-9) & (c("t_fall") < 1000e-9))]
    if "qsw_raw" in df.columns:
        rules += [("qgd_qsw", (F.try_divide("qgd", "qsw_raw") > 0.33) & (F.try_divide("qgd", "qsw_raw") < 0.95)), ("qsw_sum", F.abs(F.try_divide(c("qgd") + c("qgs2") - c("qsw_raw"), c("qsw_raw"))) <= 0.36)]
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]))


def catalogue_faults(vds: Column, rds: Column, id_: Column, vth: Column) -> Column:
    """Names of the plausibility rules that a catalogue entry breaks."""
    sign = F.when(vds < 0, 60.0).otherwise(95.0)
    factor = F.abs(vds) * id_ * 1e-3
    rules = [("rds_vds", F.try_divide(rds * 1000, F.abs(vds)).between(0.002, 1000)), ("power", (factor > 0.1) & (factor < sign)), ("vth", vth <= 15)]
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]))

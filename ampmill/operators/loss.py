"""Converter losses as column expressions (H1-H13): operating point, high and low side, parallel devices, rankings, pair search.

A scenario is a one-row (or, for sweeps, many-row) frame joined to the parts; every loss is a native
expression, so Catalyst fuses the whole model into one generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the model: rise of the channel resistance and of the recovery charge with temperature, and the share of the mean that the coolest of parallel devices carries.
HOT_RDS, HOT_QRR, PARALLEL_SHARE = 1.22, 1.2, 0.9


def scenario(spark: SparkSession, *, vi=62.0, vo=27.0, pin=800.0, f=40e3, ripple=0.3, t_dead=300e-9, rg_on=6.0, rg_off=6.0, von=10.0, von_gan=5.0, voff=0.0, vpl_fallback=4.5, max_parallel=2, name="default") -> DataFrame:
    """One operating point with its drive, as a row."""
    if not (1e3 < f < 2e6 and t_dead * f < 0.1):
        raise ValueError("switching frequency or dead time out of range")
    row = dict(name=name, vi=vi, vo=vo, pin=pin, f=f, ripple=ripple, t_dead=t_dead, rg_on=rg_on, rg_off=rg_off, von=von, von_gan=von_gan, voff=voff, vpl_fallback=vpl_fallback, max_parallel=max_parallel)
    return spark.createDataFrame([tuple(row.values())], "name string, " + ", ".join(f"{k} double" for k in list(row)[1:-1]) + ", max_parallel int")


def operating_point(s: DataFrame) -> DataFrame:
    """Output current, ripple, duty, current limits and mean squares of each scenario row (pin, or io where given; ripple or inductance)."""
    cols = s.columns
    io = F.col("io") if "io" in cols else F.col("pin") / F.col("vo")
    s = s.withColumn("io", io).withColumn("duty", F.col("vo") / F.col("vi"))
    if "l" in cols:
        s = s.withColumn("di", F.col("vo") / (F.col("f") * F.col("l")) * (1 - F.col("duty")))
    else:
        s = s.withColumn("di", F.col("io") * F.col("ripple")).withColumn("l", round_sig(F.col("vo") / (F.col("f") * F.col("di")) * (1 - F.col("duty")), 3))
    s = s.withColumn("io_min", F.col("io") - F.col("di") / 2).withColumn("io_max", F.col("io") + F.col("di") / 2)
    mean = (F.col("io_max") * F.col("io_max") + F.col("io_max") * F.col("io_min") + F.col("io_min") * F.col("io_min")) / 3
    return s.select("*", mean.alias("i2_mean"), (F.col("di") * F.col("di") / 12).alias("i2_ac"), (F.col("di") < 2 * F.col("io")).alias("ccm"))


def round_sig(c: Column, n: int) -> Column:
    """n significant digits; null and zero stay."""
    scale = F.pow(F.lit(10.0), n - 1 - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, c).otherwise(F.round(c * scale) / scale)


def resistance_at(rds: Column, tj: Column) -> Column:
    """Channel resistance at a junction temperature (H3): hot where it isn't known, as given at 25 °C, null at any other."""
    return F.when(tj.isNull(), rds * HOT_RDS).when(tj == 25, rds)


def vds_in_range(vds: Column) -> Column:
    """Rated voltage fits the input voltage; invalid and missing ratings pass."""
    fits = ~(vds < F.col("vi") * 1.1) & ~(vds > F.greatest(F.lit(50.0), F.col("vi") * 3))
    return F.coalesce((F.abs(vds) < 2) | fits, F.lit(True))


def id_in_range(id_: Column, parallel: Column) -> Column:
    return F.coalesce(~(id_ < F.col("io_max") * 1.2 / parallel), F.lit(True))


def preselect(parts: DataFrame, point: DataFrame) -> DataFrame:
    """Parts that an operating point can use at all (F5-F7), joined to it. The point's few rows are broadcast."""
    j = parts.crossJoin(F.broadcast(point))
    rds_most = F.col("vo") * F.col("io") * 0.01 / (F.col("io") * F.col("io")) * 2 * F.col("max_parallel")
    return j.filter(vds_in_range(F.col("vds")) & id_in_range(F.col("id"), F.col("max_parallel").cast("double")) & F.coalesce(~(F.col("rds_on") > rds_most), F.lit(True)))


def _coss_loss() -> tuple[Column, Column]:
    """(loss in W of the high side, charge in C) of the output capacitance, which falls with the root of the voltage."""
    v0 = F.col("coss_v0")
    p = F.when(v0 > 0, F.lit(2.0) / 3 * F.col("coss") * F.pow("vi", F.lit(1.5)) * F.sqrt(v0)).otherwise(F.lit(2.0) / 3 * F.col("coss") * F.col("vi") * F.col("vi")) * F.col("f")
    q = F.when(v0 > 0, 2 * F.col("coss") * F.sqrt(v0 * F.col("vi"))).otherwise(2 * F.col("coss") * F.col("vi"))
    return p, q


def switch_times(df: DataFrame) -> DataFrame:
    """tr and tf of the high side from charges, plateau and gate resistance; null where the drive doesn't exceed the plateau and the plateau the threshold."""
    gan = F.col("substrate") == "GaN"
    df = df.withColumn("__von", F.when(gan, F.col("von_gan")).otherwise(F.col("von"))).withColumn("__vpl", F.coalesce("vpl", F.when(gan, F.col("vpl_fallback") / 2).otherwise(F.col("vpl_fallback"))))
    df = df.withColumn("__vth", F.col("__vpl") * F.try_divide("qg_th", "qgs"))
    df = df.withColumn("__vir", (F.col("__vpl") + F.col("__vth")) / 2)
    ok = (F.col("__von") > F.col("__vpl")) & (F.col("__vpl") > F.col("__vth"))
    tr = (F.col("qgs2") / (F.col("__von") - F.col("__vir")) + F.col("qgd") / (F.col("__von") - F.col("__vpl"))) * F.greatest("rg", "rg_on")
    tf = (F.col("qgs2") / (F.col("__vir") - F.col("voff")) + F.col("qgd") / (F.col("__vpl") - F.col("voff"))) * F.greatest("rg", "rg_off")
    return df.withColumn("tr", F.when(ok, tr)).withColumn("tf", F.when(ok, tf)).drop("__von", "__vpl", "__vth", "__vir")


def switch_times_inductive(qgs2: Column, qgd: Column, vpl: Column, rg: Column, von: Column, voff: Column, io_min: Column, io_max: Column, lcsi: Column, ls_qoss: Column) -> tuple[Column, Column]:
    """(tr, tf) with a common source inductance: the gate current in the plateau solves a quadratic."""
    a = lcsi * ls_qoss / (qgd * qgd)
    root = lambda drive: (-rg + F.sqrt(rg * rg + 4 * a * drive)) / (2 * a)
    rise = qgs2 / ((von - vpl) / (rg + lcsi * io_min / qgs2)) + qgd / root(von - vpl)
    fall = qgs2 / ((vpl - voff) / (rg + lcsi * io_max / qgs2)) + qgd / root(vpl - voff)
    return rise, fall


def switch_times_constant(qsw: Column, vpl: Column, rg: Column, von: Column, voff: Column) -> tuple[Column, Column]:
    """(tr, tf) with the plateau's gate current throughout (H6).

    The model takes the turn-on current as voff - vpl, so that rise times come out negative where the
    drive goes to zero; they are kept as they are. Null where the drive doesn't exceed the plateau.
    """
    drives = von > vpl
    return F.when(drives, qsw * rg / (voff - vpl)), F.when(drives, qsw * rg / (vpl - voff))


def switch_times_one_resistance(qgs2: Column, qgd: Column, vpl: Column, vth: Column, rg: Column, von: Column, voff: Column) -> tuple[Column, Column]:
    """(tr, tf) from charges, with one gate resistance for both edges and without a test of the drive (H6)."""
    middle = (vpl + vth) / 2
    return (qgs2 / (von - middle) + qgd / (von - vpl)) * rg, (qgs2 / (middle - voff) + qgd / (vpl - voff)) * rg


def losses_from_times(tr: Column, tf: Column) -> Column:
    """Switching loss from rise and fall times; a missing fall time is 1.5 rise times, a missing rise time a fall time."""
    rise, fall = F.coalesce(tr, tf), F.coalesce(tf, tr * 1.5)
    return 0.5 * F.col("vi") * F.col("f") * (rise * F.col("io_min") + fall * F.col("io_max"))


def high_side(df: DataFrame) -> DataFrame:
    """Adds the losses in W of each part as high-side switch of a buck converter, for one device."""
    df = switch_times(df)
    p_coss, q_oss = _coss_loss()
    gan = F.col("substrate") == "GaN"
    von = F.when(gan, F.col("von_gan")).otherwise(F.col("von"))
    return df.select(
        "*",
        (F.col("duty") * F.col("i2_mean") * F.col("rds_on") * HOT_RDS).alias("p_cl"),
        (0.5 * F.col("vi") * F.col("f") * (F.col("io_min") * F.col("tr") + F.col("io_max") * F.col("tf"))).alias("p_sw"),
        p_coss.alias("p_coss"),
        F.lit(0.0).alias("p_rr"),
        ((von - F.col("voff")) * F.col("f") * F.col("qg")).alias("p_gd"),
        F.lit(0.0).alias("p_dt"),
        q_oss.alias("q_oss"),
    )


def low_side(df: DataFrame) -> DataFrame:
    """Adds the losses in W of each part as low-side (synchronous) switch, for one device."""
    p_coss, q_oss = _coss_loss()
    von = F.when(F.col("substrate") == "GaN", F.col("von_gan")).otherwise(F.col("von"))
    vsd = F.abs(F.coalesce(F.nullif("vsd", F.lit(0.0)), F.lit(1.0)))
    return df.select(
        "*",
        ((1 - F.col("duty")) * F.col("i2_mean") * F.col("rds_on") * HOT_RDS).alias("p_cl"),
        F.lit(0.0).alias("p_sw"),
        (p_coss * 2).alias("p_coss"),
        (F.col("vi") * F.col("f") * F.col("qrr") * HOT_QRR).alias("p_rr"),
        ((von - F.col("voff")) * F.col("f") * F.col("qg")).alias("p_gd"),
        (vsd * (F.col("io_max") + F.col("io_min")) * F.col("t_dead") * F.col("f")).alias("p_dt"),
        q_oss.alias("q_oss"),
    )


def in_parallel(df: DataFrame, n: Column) -> DataFrame:
    """The losses of n devices in parallel: conduction shared unevenly, charges n-fold, switching and dead time as of one."""
    one = n == 1
    return df.withColumns(
        {
            "p_cl": F.when(one, F.col("p_cl")).otherwise(F.col("p_cl") / n * PARALLEL_SHARE),
            "p_coss": F.col("p_coss") * n,
            "p_rr": F.col("p_rr") * n,
            "p_gd": F.col("p_gd") * n,
        }
    )


def exploded(df: DataFrame) -> DataFrame:
    """One row per number n of parallel devices, 1..max_parallel."""
    return in_parallel(df.select("*", F.explode(F.sequence(F.lit(1), F.col("max_parallel"))).alias("n")), F.col("n"))


def hs_total() -> Column:
    return F.col("p_cl") + F.col("p_coss") + F.col("p_gd") + F.col("p_sw")


def ls_total() -> Column:
    return F.col("p_cl") + F.col("p_coss") + F.col("p_gd") + F.col("p_dt") + F.col("p_rr")


def rank_high_side(parts: DataFrame, point: DataFrame) -> DataFrame:
    """High-side losses of all usable parts for 1..max_parallel devices; parts without total appear once."""
    df = exploded(high_side(preselect(parts, point))).withColumn("p_total", hs_total())
    return df.filter(((F.col("n") == 1) | F.col("p_total").isNotNull()) & id_in_range(F.col("id"), F.col("n").cast("double")))


def rank_low_side(parts: DataFrame, point: DataFrame) -> DataFrame:
    """Low-side losses likewise; parts that would turn themselves on (qgd above qgs) are left out."""
    usable = preselect(parts, point).filter(F.coalesce(~(F.try_divide("qgd", "qgs") > 1), F.lit(True)))
    df = exploded(low_side(usable)).withColumn("p_total", ls_total())
    return df.filter(((F.col("n") == 1) | F.col("p_total").isNotNull()) & id_in_range(F.col("id"), F.col("n").cast("double")))


def cheapest(df: DataFrame, key: str, keep: int) -> DataFrame:
    """The keep rows of least loss, invalid losses last (W3): a top-k without full sort."""
    return df.orderBy(F.when(F.col(key) > 0, F.col(key)).otherwise(9e9), "pk").limit(keep)


def staged_pairs(parts: DataFrame, point: DataFrame, keep: int = 5000, strict: bool = False) -> DataFrame:
    """Pairs of a switcher (takes the transitions) and n conductors (take the conduction) that beat what each could do alone.

    Both sides are top-keep lists, so the pairs are at most keep² x max_parallel whatever the catalogue.
    strict keeps the running minimum of the scan order (by switcher and conductor rank) in place of the final one.
    """
    from pyspark.sql import Window

    hs = high_side(preselect(parts, point)).filter(hs_total().isNotNull())
    base = hs.select("pk", "id", "io_max", "max_parallel", "p_cl", "p_sw", "p_gd", "p_coss", (F.col("p_sw") + F.col("p_gd") + F.col("p_coss")).alias("p_switch"), (F.col("p_cl") + F.col("p_gd") + F.col("p_coss")).alias("p_conduct"))
    switchers = base.orderBy("p_switch", "pk").limit(keep)
    conductors = base.orderBy("p_conduct", "pk").limit(keep)
    least = switchers.agg(F.min("p_sw").alias("best_sw"))
    s = switchers.crossJoin(F.broadcast(least)).filter(F.col("p_sw") <= 6 * F.col("best_sw"))
    s = s.select(F.col("pk").alias("sw"), F.col("id").alias("sw_id"), F.col("p_switch"), (F.col("p_cl") / 2 * PARALLEL_SHARE + F.col("p_sw") + 2 * (F.col("p_gd") + F.col("p_coss"))).alias("sw_two"))
    n = F.col("n").cast("double")
    c = conductors.select("*", F.explode(F.sequence(F.lit(1), F.col("max_parallel"))).alias("n"))
    share = F.when(n == 1, F.col("p_cl")).otherwise(F.col("p_cl") / n * PARALLEL_SHARE)
    c = c.select(F.col("pk").alias("cond"), "n", F.col("id").alias("c_id"), "io_max", (share + n * (F.col("p_gd") + F.col("p_coss"))).alias("p_cond"), (share / 2 * PARALLEL_SHARE + F.col("p_sw") + 2 * n * (F.col("p_gd") + F.col("p_coss"))).alias("cond_two"))
    fits = F.coalesce(~(F.col("sw_id") < 1.2 * F.col("io_max")), F.lit(True)) & F.coalesce(~(F.col("c_id") * n < 1.2 * F.col("io_max")), F.lit(True))
    pairs = F.broadcast(s).crossJoin(c).filter(fits).withColumn("p", F.col("p_switch") + F.col("p_cond"))
    if strict:
        scan = Window.orderBy("p_switch", "sw", "p_cond", "cond", "n").rowsBetween(Window.unboundedPreceding, 0)
        own = Window.partitionBy("sw").orderBy("p_cond", "cond", "n").rowsBetween(Window.unboundedPreceding, 0)
        pairs = pairs.withColumn("best", F.min("p").over(scan)).withColumn("sw_best", F.min("p").over(own))
    else:
        # two small aggregates instead of a window over all pairs in one task
        pairs = pairs.crossJoin(F.broadcast(pairs.agg(F.min("p").alias("best")))).join(F.broadcast(pairs.groupBy("sw").agg(F.min("p").alias("sw_best"))), "sw")
    return pairs.filter((F.col("p") < 2 * F.col("best")) & (F.col("p") < 1.5 * F.col("sw_best")) & (F.col("p") < F.col("sw_two")) & (F.col("p") < F.col("cond_two"))).select("sw", "cond", "n", "p")

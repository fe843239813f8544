"""Inductors and wires (A25, H25-H29): core and coil losses as column expressions over coefficient columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Resistivity of annealed copper in Ωm, magnetic constant, oersted in A/m.
COPPER, MU0, OERSTED = 1.71e-8, 4e-7 * math.pi, 79.58


def percent_permeability(h_oe: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Share of the initial permeability left under a bias field."""
    return 0.01 / (a + b * F.pow(h_oe, c)) + d


def core_loss_density(b_tesla: Column, f_hz: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """mW/cm³ at peak flux density and frequency."""
    g = b_tesla * 1e4
    return f_hz / (a / F.pow(g, F.lit(3.0)) + b / F.pow(g, F.lit(2.3)) + c / F.pow(g, F.lit(1.65))) + d * g * g * f_hz * f_hz


def magnetization(h_oe: Column, mu: Column, a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    """Flux density in tesla on the initial magnetisation curve."""
    return mu / (1 / (h_oe + a * F.pow(h_oe, b)) + 1 / (c * F.pow(h_oe, d)) + 1 / e) * 1e-4


def awg_to_m(awg: Column) -> Column:
    return 0.127 * F.pow(F.lit(92.0), (36 - awg) / 39) * 1e-3


def m_to_awg(d: Column) -> Column:
    return 36 - 39 * (F.log10(d * 1e3 / 0.127) / math.log10(92))


def skin_depth(f: Column, resistivity: float = COPPER, mu_r: float = 1.0) -> Column:
    return F.sqrt(resistivity / (math.pi * f * MU0 * mu_r))


def hollow_factor(d: Column, f: Column) -> Column:
    """Resistance ratio of a thick wire whose current flows in its skin; null for wires thinner than some skin depths."""
    s = skin_depth(f)
    return F.when(s / d < 0.3, d * d / (4 * s * (d - s)))


def skin_and_proximity(d: Column, f: Column, strands: Column, turns: Column, inner: Column, outer: Column) -> tuple[Column, Column]:
    """Additional resistance by skin and by proximity effect, as shares of the direct one, for a toroid's winding."""
    z = d / skin_depth(f)
    p = lambda n: F.pow(z, F.lit(float(n)))
    skin = p(4) / 768 * F.pow(1 + (p(6) + 6.1 * p(5) + 32 * p(4) + 13 * p(3) + 90 * p(2) + 110 * z) / 36864, F.lit(-0.5))
    width = math.pi / 2 * (inner + outer)
    near = F.pow(math.pi * strands * turns, F.lit(2.0)) * d * d * p(4) / (192 * width * width) * F.pow(1 + (p(6) + 2.7 * p(5) - 1.3 * p(4) - 17 * p(3) + 85 * p(2) - 43 * z) / 1024, F.lit(-0.5))
    return skin, near


def dc_resistance(length: Column, d: Column, strands: Column, resistivity: float = COPPER) -> Column:
    return resistivity * length / (math.pi * d * d / 4) / strands


def coil_losses(df: DataFrame) -> DataFrame:
    """Adds h_oe, mu_share, l_dc, b_pk, p_dcr, p_acr, p_core to rows with an operating point (io, di, f), a core (l_e, a_e, mu_r, bias_*, loss_*) and a winding (turns, l0, r_dc, d, strands, inner, outer).

    mu_share outside 0.25..1 is a saturated core: its inductance and losses are null.
    """
    df = df.withColumn("h_oe", F.col("turns") / F.col("l_e") * F.col("io") / OERSTED)
    share = percent_permeability(F.col("h_oe"), *[F.col(f"bias_{k}") for k in "abcd"])
    df = df.withColumn("mu_share", F.when(share.between(0.25, 1), share))
    df = df.withColumn("l_dc", F.col("l0") * F.col("mu_share")).withColumn("b_pk", 0.5 * MU0 * F.col("mu_share") * F.col("mu_r") * F.col("turns") / F.col("l_e") * F.col("di"))
    skin, near = skin_and_proximity(*[F.col(c) for c in ("d", "f", "strands", "turns", "inner", "outer")])
    density = core_loss_density(F.col("b_pk"), F.col("f"), *[F.col(f"loss_{k}") for k in "abcd"])
    return df.select(
        "*",
        ((F.col("io") * F.col("io") + F.col("di") * F.col("di") / 12) * F.col("r_dc")).alias("p_dcr"),
        (F.col("di") * F.col("di") / 12 * (1 + skin + near) * F.col("r_dc")).alias("p_acr"),
        (density * F.col("a_e") * F.col("l_e") * 1e3).alias("p_core"),
    )


def capacitor_losses(z_in: float, z_out: float) -> tuple[Column, Column]:
    """Losses in the input and output capacitors of a buck converter."""
    i_in = F.col("io") * F.sqrt((F.col("vi") - F.col("vo")) * F.col("vo")) / F.col("vi")
    return i_in * i_in * z_in, F.col("di") * F.col("di") / 12 * z_out


def capacitance_needed(ripple_in: float, ripple_out: float) -> tuple[Column, Column]:
    """Least input and output capacitance for given voltage ripples."""
    return F.col("io") * F.col("duty") * (1 - F.col("duty")) / (F.col("f") * ripple_in), F.col("di") / (8 * F.col("f") * ripple_out)


def power_sweep(spark: SparkSession, start: float = 5.0, factor: float = 1.1, below: float = 2000.0) -> DataFrame:
    """Input powers start, start x factor, ... below a bound."""
    n = math.ceil(math.log(below / start) / math.log(factor))
    return spark.range(n + 1).select((start * F.pow(F.lit(factor), F.col("id").cast("double"))).alias("pin")).filter(F.col("pin") < below)


def turns_sweep(cores: DataFrame, most: int = 99) -> DataFrame:
    """Each core with 1..most turns and the inductance they give (H29); cores has a_l."""
    return cores.select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("turns")).withColumn("l0", F.col("turns") * F.col("turns") * F.col("a_l"))


def material(coefficients: DataFrame, name: str, shape: str, mu: int) -> DataFrame:
    """The one row of a material in a coefficient table; another number of rows raises on evaluation."""
    hit = coefficients.filter((F.col("mat") == name) & (F.col("shape") == shape) & (F.col("mu_r") == mu))
    count = hit.agg(F.count(F.lit(1)).alias("__n"))
    return hit.crossJoin(F.broadcast(count)).filter(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("not exactly one material")).cast("boolean"))).drop("__n")

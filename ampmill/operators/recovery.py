"""Reverse recovery after Lauritzen and Ma (H14-H20): fit at a test point, prediction at an operating point, two-point fit.

Roots are found by bisection inside a native fold over a sequence, so a fit is one expression of the
generated stage; only the nested two-point fit, whose plan would explode, is a vectorised Arrow function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampmill.functions.bind import let

# The fraction of its peak at which the recovery current counts as over, the share of the output charge in a measured recovery charge, the exponent of the lifetime over temperature.
K_TRR, QOSS_SHARE, N_TAU = 0.1, 0.1, 1.2
STEPS = 100


def _bisect(lo: Column, hi: Column, raises_low, steps: int = STEPS) -> Column:
    """The root between lo and hi: raises_low(mid) says whether the lower end moves up."""

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        up = raises_low(mid)
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(lo.alias("lo"), hi.alias("hi")), step, lambda a: (a["lo"] + a["hi"]) / 2)


def fit(df: DataFrame, log_rest: float = math.log(1 / K_TRR)) -> DataFrame:
    """Adds irrm, td, tau, tm and fault to a frame with qrr [C], trr [s], i_f [A], didt [A/s].

    fault names what makes a row unfittable: 'input' (missing or not positive), 'ramp' (trr shorter than
    the current's ramp), 'bracket' (no root within reach); its fitted columns are null then.
    """

    def peak(p: Column) -> Column:
        ca, cb = (log_rest - 2) / (2 * p["a"] * log_rest), p["t"] / log_rest
        disc = cb * cb + 4 * ca * p["q"]
        good = F.coalesce((p["q"] > 0) & (p["t"] > 0) & (p["i"] > 0) & (p["a"] > 0), F.lit(False))
        return let(delay, p=p, good=good, irrm=F.when(good & (disc >= 0), 2 * p["q"] / (cb + F.sqrt(disc))))

    def delay(s: Column) -> Column:
        td = (s["p"]["t"] - s["irrm"] / s["p"]["a"]) / log_rest
        return let(lifetime, a=s["p"]["a"], good=s["good"], irrm=s["irrm"], td=F.when(td > 0, td), t0=(s["p"]["i"] + s["irrm"]) / s["p"]["a"])

    def lifetime(s: Column) -> Column:
        g = lambda tau: s["a"] * (tau - s["td"]) * (1 - F.exp(-s["t0"] / tau)) - s["irrm"]
        top = F.greatest(10 * s["td"], 10 * s["t0"], F.lit(1e-6))
        hi = F.when(s["td"].isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(60)), top, lambda h, _: F.when(g(h) < 0, h * 4).otherwise(h)))
        root = let(lambda b: F.when(g(b["hi"]) >= 0, _bisect(s["td"] * (1 + 1e-9), b["hi"], lambda m: g(m) < 0)), hi=hi)
        return let(lambda r: F.struct(s["irrm"].alias("irrm"), s["td"].alias("td"), r["tau"].alias("tau"), (r["tau"] * s["td"] / (r["tau"] - s["td"])).alias("tm"), fault(s, r["tau"]).alias("fault")), tau=root)

    def fault(s: Column, tau: Column) -> Column:
        return F.when(~s["good"], "input").when(s["irrm"].isNull() | s["td"].isNull(), "ramp").when(tau.isNull(), "bracket")

    # inline, unlike a projection, is never merged with its consumers: the fit is computed once a row
    return df.select("*", F.inline(F.array(let(peak, a=F.col("didt"), q=F.col("qrr"), t=F.col("trr"), i=F.col("i_f")))))


def predict(df: DataFrame, tau: str = "tau", tm: str = "tm", i_f: str = "op_if", didt: str = "op_didt", prefix: str = "op_") -> DataFrame:
    """Adds the recovery at an operating point: peak current, charge, time, delay; null where the model or the point is missing."""

    def recovered(p: Column) -> Column:
        """Peak current by bisection, the inputs being bound so that no step evaluates them again."""
        a, life, d, i = p["a"], p["life"], p["life"] * p["tm"] / (p["life"] + p["tm"]), p["i"]
        g = lambda x: a * (life - d) * (1 - F.exp(-(i + x) / (a * life))) - x
        hi = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.greatest(F.lit(1.0), 10 * a * life), lambda h, _: F.when(g(h) > 0, h * 4).otherwise(h))
        ok = (life > 0) & (p["tm"] > 0) & (i >= 0) & (a > 0)
        return let(lambda r: F.struct(d.alias("td"), r["x"].alias("irrm"), (r["x"] * r["x"] / (2 * a) + r["x"] * d).alias("qrr"), (r["x"] / a + d * math.log(1 / K_TRR)).alias("trr")), x=F.when(ok, _bisect(F.lit(0.0), hi, lambda m: g(m) > 0)))

    names = [f"{prefix}{c}" for c in ("td", "irrm", "qrr", "trr")]
    return df.select("*", F.inline(F.array(let(recovered, a=F.col(didt), life=F.col(tau), tm=F.col(tm), i=F.col(i_f)))).alias(*names))


def tau_at(tau: Column, tj: Column, tj_fit: Column, n: Column | float = N_TAU) -> Column:
    """Carrier lifetime at another junction temperature."""
    return tau * F.pow((tj + 273.15) / (tj_fit + 273.15), F.lit(n) if isinstance(n, (int, float)) else n)


def diffusion_charge(qrr: Column, qoss: Column) -> Column:
    """Recovery charge without the capacitive share; null where the share eats it up; without qoss unchanged."""
    rest = qrr - QOSS_SHARE * qoss
    return F.when(qoss.isNull(), qrr).when(rest > 0, rest)


def pair_of_rows(points: DataFrame) -> DataFrame:
    """Per part the two rows of equal current with the widest ratio of slew rates (E17), the smaller current on ties; both must share Tj and VR."""
    g = points.groupBy("part", "i_f").agg(F.min_by(F.struct("didt", "qrr", "trr", "tj", "vr"), "didt").alias("lo"), F.max_by(F.struct("didt", "qrr", "trr", "tj", "vr"), "didt").alias("hi"))
    g = g.filter(F.col("hi.didt") > F.col("lo.didt")).withColumn("span", F.col("hi.didt") / F.col("lo.didt"))
    best = g.groupBy("part").agg(F.max_by(F.struct("i_f", "lo", "hi"), F.struct("span", (-F.col("i_f")).alias("x"))).alias("b")).select("part", "b.*")
    return best.filter(F.col("lo.tj").eqNullSafe(F.col("hi.tj")) & F.col("lo.vr").eqNullSafe(F.col("hi.vr")))


def _np_fit(q, trr, i_f, a):
    rest = math.log(1 / K_TRR)
    with np.errstate(all="ignore"):
        ca, cb = (rest - 2) / (2 * a * rest), trr / rest
        irrm = 2 * q / (cb + np.sqrt(cb * cb + 4 * ca * q))
        td = (trr - irrm / a) / rest
        t0 = (i_f + irrm) / a
        bad = ~((q > 0) & (td > 0))
        f = lambda tau: a * (tau - td) * (1 - np.exp(-t0 / tau)) - irrm
        lo, hi = td * (1 + 1e-9), np.maximum(np.maximum(10 * td, 10 * t0), 1e-6)
        for _ in range(60):
            hi = np.where(f(hi) < 0, hi * 4, hi)
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            up = f(mid) < 0
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        tau = (lo + hi) / 2
        return np.where(bad, np.nan, tau), np.where(bad, np.nan, tau * td / (tau - td))


def _np_charge(tau, tm, i_f, a):
    with np.errstate(all="ignore"):
        td = tau * tm / (tau + tm)
        g = lambda x: a * (tau - td) * (1 - np.exp(-(i_f + x) / (a * tau))) - x
        lo, hi = np.zeros_like(tau), np.maximum(1.0, 10 * a * tau)
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            up = g(mid) > 0
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        r = (lo + hi) / 2
        return r * r / (2 * a) + r * td


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("tau", "tm", "q0")]))
def two_point(i_f: pd.Series, a_lo: pd.Series, q_lo: pd.Series, t_lo: pd.Series, a_hi: pd.Series, q_hi: pd.Series) -> pd.DataFrame:
    """Lifetime, transit time and capacitive share that reproduce two rows (H17); null where none does. All rows of a batch at once."""
    i_f, a_lo, q_lo, t_lo, a_hi, q_hi = (s.to_numpy(dtype=float) for s in (i_f, a_lo, q_lo, t_lo, a_hi, q_hi))

    def err(q0):
        tau, tm = _np_fit(q_lo - q0, t_lo, i_f, a_lo)
        return _np_charge(tau, tm, i_f, a_hi) - (q_hi - q0)

    with np.errstate(all="ignore"):
        lo, hi = np.zeros_like(q_lo), np.minimum(q_lo, q_hi) * 0.98
        f_lo = err(lo)
        for _ in range(40):  # walk back into the range that admits a fit
            hi = np.where(np.isnan(err(hi)), hi * 0.85, hi)
        ok = f_lo * err(hi) <= 0
        for _ in range(60):
            mid = (lo + hi) / 2
            f = err(mid)
            down = np.isnan(f) | (f_lo * f <= 0)
            hi, lo, f_lo = np.where(down, mid, hi), np.where(down, lo, mid), np.where(down, f_lo, f)
        q0 = (lo + hi) / 2
        tau, tm = _np_fit(q_lo - q0, t_lo, i_f, a_lo)
    return pd.DataFrame({"tau": np.where(ok, tau, np.nan), "tm": np.where(ok, tm, np.nan), "q0": np.where(ok, q0, np.nan)})


def best_fit(df: DataFrame) -> DataFrame:
    """The two-point fit where it exists, else the one-point fit on the charge without its capacitive share, with method and reason.

    df has i_f, didt, qrr, trr, qoss and, where known, hi_didt, hi_qrr.
    """
    df = df.withColumn("__two", F.when(F.col("hi_didt").isNotNull() & F.col("hi_qrr").isNotNull(), two_point("i_f", "didt", "qrr", "trr", "hi_didt", "hi_qrr")))
    ok = F.coalesce(~F.isnan("__two.tau") & F.col("__two.tau").isNotNull(), F.lit(False))
    one = fit(df.withColumn("qrr", diffusion_charge(F.col("qrr"), F.col("qoss"))))
    reason = F.when(ok, None).when(F.col("hi_didt").isNull(), "no second row").otherwise("no common fit")
    return one.select("*", F.when(ok, "2pt").when(F.col("tau").isNotNull(), "1pt").alias("method"), reason.alias("fallback"), F.when(ok, F.col("__two.tau")).otherwise(F.col("tau")).alias("best_tau"), F.when(ok, F.col("__two.tm")).otherwise(F.col("tm")).alias("best_tm"), F.when(ok, F.col("__two.q0")).alias("q0")).drop("__two")

"""Queries of the recovery model, curves, pages and magnetics, with their SQL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampmill.operators import curves, loss, magnetics, recovery
from ampmill.session import table
from ampmill.sources.derived import DPARTS_SQL, dparts


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = F.col("pk")
    return dparts(spark, sf_dir).select("pk", "qrr", (F.col("trr") * 4).alias("trr"), (10.0 + pk % 50).alias("i_f"), ((100.0 + (pk % 9) * 50) * 1e6).alias("didt"), (F.col("coss") * F.abs("vds")).alias("qoss"), (30.0 + pk % 20).alias("op_if"), ((200.0 + (pk % 7) * 100) * 1e6).alias("op_didt"))


def h14_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = recovery.fit(_tests(spark, sf_dir))
    return f.select("pk", F.round(F.col("irrm"), 6).alias("irrm"), F.round(F.col("td") * 1e9, 5).alias("td_ns"), F.round(F.col("tau") * 1e9, 5).alias("tau_ns"), "fault")


def h15_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = recovery.predict(recovery.fit(_tests(spark, sf_dir)).filter("fault is null"))
    return p.select("pk", F.round(F.col("op_qrr") * 1e9, 5).alias("qrr_nc"), F.round(F.col("op_trr") * 1e9, 5).alias("trr_ns"), F.round("op_irrm", 5).alias("irrm"))


def h16_tau_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tests(spark, sf_dir)
    return t.select("pk", F.round(recovery.tau_at(F.col("trr") * 1e9, 25.0 + F.col("pk") % 100, F.lit(25.0)), 6).alias("tau_ns"))


def h17_two_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _best(spark, sf_dir)
    return t.select("pk", F.round(F.col("q0") * 1e9, 3).alias("q0_nc"), F.round(F.col("best_tau") * 1e9, 3).alias("tau_ns"), "method", "fallback")


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tests(spark, sf_dir).withColumn("hi_didt", F.when(F.col("pk") % 3 != 0, F.col("didt") * 3)).withColumn("hi_qrr", F.col("qrr") * (1.05 + (F.col("pk") % 5) * 0.1))
    return recovery.best_fit(t)


def h20_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tests(spark, sf_dir)
    return t.select("pk", F.round(recovery.diffusion_charge(F.col("qrr"), F.col("qoss")) * 1e9, 6).alias("q_nc"))


def e17_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widest pair of rows of equal current among the measurements of each supplier's line items."""
    li = table(spark, sf_dir, "lineitem")
    p = li.select(F.col("l_partkey").alias("part"), (F.col("l_linenumber") % 3).cast("double").alias("i_f"), F.col("l_quantity").alias("didt"), (F.col("l_extendedprice")).alias("qrr"), F.col("l_tax").alias("trr"), F.lit(25.0).alias("tj"), F.lit(None).cast("double").alias("vr"))
    b = recovery.pair_of_rows(p)
    return b.select("part", "i_f", F.col("lo.didt").alias("didt_lo"), F.col("hi.didt").alias("didt_hi"))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the values of events as a curve over the minute of the hour (equal minutes averaged)."""
    e = table(spark, sf_dir, "events").select("user_id", F.minute("ts").cast("double").alias("v"), F.col("value").alias("c")).filter("c is not null")
    return curves.collapsed_points(e, ["user_id"], "v", "c")


def h22_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curves.as_curve(_curve(spark, sf_dir), ["user_id"], "v", "c")
    return c.select("user_id", *[F.round(curves.interpolate(F.col("curve"), F.lit(float(x))), 6).alias(f"at_{x}") for x in (0, 17, 30, 59)])


def h23_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curves.as_curve(_curve(spark, sf_dir), ["user_id"], "v", "c")
    return c.select("user_id", F.round(curves.integral(F.col("curve"), F.element_at("curve", 1)["x"], F.element_at("curve", -1)["x"]), 5).alias("area"))


def a26_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("user_id", "v", F.round("c", 6).alias("c"))


def d14_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "text_rows").select("text_row_id", "bbox.*")
    lin = curves.calibrated(F.col("x2"), F.col("x1"), F.lit(600.0), F.lit(0.0), F.lit(100.0))
    log = curves.calibrated(F.col("x2"), F.col("x1"), F.lit(600.0), F.lit(1.0), F.lit(1000.0), True)
    return t.select("text_row_id", F.round(lin, 6).alias("lin"), F.round(log, 6).alias("log"))


def d15_tick_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "text_rows").select("mpn", "page_num", F.col("bbox.y1").alias("y"))
    return curves.tick_runs(t, ["mpn", "page_num"], "y").select("mpn", "page_num", "first", "last", "n", F.round("spacing", 6).alias("spacing"))


def d16_plateaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.plateaus(_curve(spark, sf_dir), ["user_id"], "v", "c", 15.0).select("user_id", "x_from", "x_to", F.round("level", 6).alias("level"))


def d1_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common height of each line's box with the next one's."""
    w = Window.partitionBy("mpn", "page_num").orderBy("text_row_id")
    t = table(spark, sf_dir, "text_rows").select("text_row_id", F.col("bbox").alias("a"), F.lead("bbox").over(w).alias("b")).filter("b is not null")
    return t.select("text_row_id", F.round(curves.overlap("a", "b", "x"), 6).alias("x_share"), F.round(curves.overlap("a", "b", "y", False), 6).alias("y_common"), F.round(curves.box_union("a", "b")["y2"], 6).alias("y2"))


def d6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line of a page the nearest one in each direction."""
    t = table(spark, sf_dir, "text_rows").filter("mpn is not null").select("mpn", "page_num", F.col("text_row_id").alias("id"), "bbox")
    ways = [curves.nearest_in_direction(t, ["mpn", "page_num"], 1, 0.4, d).select("id", F.lit(d).alias("direction"), F.round("gap", 4).alias("gap")) for d in ("right", "left", "above", "below")]
    return reduce(lambda a, b: a.unionByName(b), ways)


def d8_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "text_rows").select("mpn", "page_num", F.col("text_row_id").alias("id"), "bbox", (F.col("n_words") <= 3).alias("is_header"))
    return curves.table_groups(t, ["mpn", "page_num"]).groupBy("mpn", "page_num").agg(F.max("table_no").cast("long").alias("tables"), F.count(F.lit(1)).alias("rows"))


def h24_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dparts(spark, sf_dir)
    return d.select("pk", curves.verdict(F.col("qrr"), F.col("qg"), "qrr").alias("qrr"), curves.verdict(F.col("id"), F.lit(100.0), "cap").alias("cap"))


def g7_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dparts(spark, sf_dir).withColumn("v", curves.verdict(F.col("id"), F.lit(100.0), "cap"))
    return curves.verdict_tally(d, "mfr", "v")


def g10_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dparts(spark, sf_dir).select((F.col("id") / 100 - 1).alias("err"))
    return curves.error_stats(d, "err").select("n", *[F.round(c, 6).alias(c) for c in ("bias", "median", "p90", "q1", "q3")])


def _coils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores and windings from part rows, with two sets of material coefficients."""
    pk = F.col("pk")
    alt = pk % 2 == 0
    lit = lambda a, b: F.when(alt, float(a)).otherwise(float(b))
    point = loss.operating_point(loss.scenario(spark)).select("io", "di", "f", "vi", "vo", "duty")
    c = dparts(spark, sf_dir).select(
        "pk", (0.05 + (pk % 20) * 0.005).alias("l_e"), (1e-4 + (pk % 10) * 2e-5).alias("a_e"), lit(60, 125).alias("mu_r"),
        lit(0.01, 0.01).alias("bias_a"), lit(4.2e-7, 1.6e-6).alias("bias_b"), lit(1.9, 1.8).alias("bias_c"), lit(0, 0).alias("bias_d"),
        lit(1e9, 1.9e9).alias("loss_a"), lit(1.1e8, 2e8).alias("loss_b"), lit(1.9e6, 9e5).alias("loss_c"), lit(1.9e-14, 2.5e-14).alias("loss_d"),
        (10 + pk % 30).cast("double").alias("turns"), (10e-6 + (pk % 50) * 1e-6).alias("l0"), (1e-3 + (pk % 9) * 1e-3).alias("r_dc"), magnetics.awg_to_m(14.0 + pk % 10).alias("d"), (1 + pk % 3).cast("double").alias("strands"), F.lit(0.0236).alias("inner"), F.lit(0.0404).alias("outer"),
    )
    return c.crossJoin(F.broadcast(point))


def h25_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = magnetics.coil_losses(_coils(spark, sf_dir))
    return c.select("pk", F.round("mu_share", 6).alias("mu_share"), F.round(F.col("l_dc") * 1e6, 6).alias("l_dc_uh"), F.round("b_pk", 8).alias("b_pk"), F.round("p_core", 4).alias("p_core"))


def h26_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _coils(spark, sf_dir)
    skin, near = magnetics.skin_and_proximity(*[F.col(x) for x in ("d", "f", "strands", "turns", "inner", "outer")])
    return c.select("pk", F.round(magnetics.m_to_awg(F.col("d")), 6).alias("awg"), F.round(magnetics.skin_depth(F.col("f")) * 1e3, 6).alias("skin_mm"), F.round(skin, 6).alias("skin"), F.round(near, 5).alias("near"))


def h27_coil_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = magnetics.coil_losses(_coils(spark, sf_dir))
    p_in, p_out = magnetics.capacitor_losses(2e-3, 5e-3)
    c_in, c_out = magnetics.capacitance_needed(0.5, 0.1)
    return c.select("pk", F.round("p_dcr", 6).alias("p_dcr"), F.round("p_acr", 6).alias("p_acr"), F.round(p_in, 6).alias("p_cin"), F.round(p_out, 6).alias("p_cout"), F.round(c_in * 1e6, 6).alias("c_in_uf"), F.round(c_out * 1e6, 6).alias("c_out_uf"))


def h28_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-side loss and efficiency of all parts over a sweep of input power, CCM points only."""
    from ampmill.operators import specs

    s = loss.scenario(spark).drop("pin").crossJoin(magnetics.power_sweep(spark)).withColumn("l", F.lit(50e-6))
    point = loss.operating_point(s).filter("ccm")
    parts = specs.with_foms(specs.complete_gate_charge(dparts(spark, sf_dir)))
    hs = loss.high_side(parts.crossJoin(F.broadcast(point))).withColumn("p", loss.hs_total())
    return hs.groupBy("pin").agg(F.count("p").alias("n"), F.round(F.avg("p"), 5).alias("mean_loss"), F.round(F.max(1 - F.col("p") / F.col("pin")), 6).alias("best_efficiency")).select(F.round("pin", 4).alias("pin"), "n", "mean_loss", "best_efficiency")


def h29_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each core the fewest turns that reach 40 µH."""
    c = _coils(spark, sf_dir).select("pk", (4e-7 * math.pi * F.col("mu_r") * F.col("a_e") / F.col("l_e")).alias("a_l"))
    return magnetics.turns_sweep(c).filter("l0 >= 40e-6").groupBy("pk").agg(F.min("turns").alias("turns"))


QUERIES = {f.__name__: f for f in (h14_fit, h15_predict, h16_tau_at, h17_two_point, h20_diffusion, e17_pairs, h22_interpolate, h23_integral, a26_collapse, d14_calibrate, d15_tick_runs, d16_plateaus, d1_overlap, d6_neighbours, d8_tables, h24_verdicts, g7_tally, g10_errors, h25_core, h26_wire, h27_coil_loss, h28_sweep, h29_turns)}

_CURVE = "cu AS (SELECT user_id, CAST(minute(ts) AS DOUBLE) AS v, avg(value) AS c FROM events WHERE value IS NOT NULL GROUP BY user_id, minute(ts))"
_AT = "(SELECT CASE WHEN b.v = a.v THEN a.c ELSE a.c + (b.c - a.c) * ({x} - a.v) / (b.v - a.v) END FROM (SELECT v, c FROM cu k WHERE k.user_id = u.user_id AND v <= {x} ORDER BY v DESC LIMIT 1) a CROSS JOIN (SELECT v, c FROM cu k WHERE k.user_id = u.user_id AND v >= {x} ORDER BY v LIMIT 1) b)"
_V = "CASE WHEN {e} IS NULL THEN 'UNVERIFIED' WHEN {e} <= {w} THEN 'PASS' WHEN {e} <= {f} THEN 'WARN' ELSE 'FAIL' END"
_CAP = _V.format(e="abs((id - 100) / 100) * 100", w=5, f=15)
_C = "CAST({} AS DOUBLE)"
_PT = "(SELECT 800 / CAST(27 AS DOUBLE) AS io, 800 / CAST(27 AS DOUBLE) * CAST(0.3 AS DOUBLE) AS di, CAST(40e3 AS DOUBLE) AS f, CAST(62 AS DOUBLE) AS vi, CAST(27 AS DOUBLE) AS vo, CAST(27 AS DOUBLE) / 62 AS duty)"
_COIL = f"""co AS (SELECT pk, 0.05::DOUBLE + (pk % 20) * 0.005::DOUBLE AS l_e, 1e-4::DOUBLE + (pk % 10) * 2e-5::DOUBLE AS a_e, CASE WHEN pk % 2 = 0 THEN 60::DOUBLE ELSE 125 END AS mu_r,
   CASE WHEN pk % 2 = 0 THEN 4.2e-7::DOUBLE ELSE 1.6e-6 END AS bb, CASE WHEN pk % 2 = 0 THEN 1.9::DOUBLE ELSE 1.8 END AS bc, CASE WHEN pk % 2 = 0 THEN 1e9::DOUBLE ELSE 1.9e9 END AS la, CASE WHEN pk % 2 = 0 THEN 1.1e8::DOUBLE ELSE 2e8 END AS lb,
   CASE WHEN pk % 2 = 0 THEN 1.9e6::DOUBLE ELSE 9e5 END AS lc, CASE WHEN pk % 2 = 0 THEN 1.9e-14::DOUBLE ELSE 2.5e-14 END AS ld, CAST(10 + pk % 30 AS DOUBLE) AS turns, 10e-6::DOUBLE + (pk % 50) * 1e-6::DOUBLE AS l0, 1e-3::DOUBLE + (pk % 9) * 1e-3::DOUBLE AS r_dc,
   0.127::DOUBLE * pow(92::DOUBLE, (36 - (14::DOUBLE + pk % 10)) / 39) * 1e-3 AS d, CAST(1 + pk % 3 AS DOUBLE) AS strands, p.* FROM dparts CROSS JOIN {_PT} p),
  zz AS (SELECT *, d / sqrt(1.71e-8 / (pi() * f * (4e-7 * pi()))) AS z, turns / l_e * io / 79.58 AS h FROM co),
  sk AS (SELECT *, pow(z, 4) / 768 * pow(1 + (pow(z, 6) + 6.1 * pow(z, 5) + 32 * pow(z, 4) + 13 * pow(z, 3) + 90 * pow(z, 2) + 110 * z) / 36864, -0.5) AS skin,
    pow(pi() * strands * turns, 2) * d * d * pow(z, 4) / (192 * pow(pi() / 2 * (0.0236 + 0.0404), 2)) * pow(1 + (pow(z, 6) + 2.7 * pow(z, 5) - 1.3 * pow(z, 4) - 17 * pow(z, 3) + 85 * pow(z, 2) - 43 * z) / 1024, -0.5) AS near,
    0.01 / (0.01::DOUBLE + bb * pow(h, bc)) AS sh FROM zz),
  cl AS (SELECT *, CASE WHEN sh BETWEEN 0.25 AND 1 THEN sh END AS mu FROM sk), bp AS (SELECT *, 0.5 * (4e-7 * pi()) * mu * mu_r * turns / l_e * di AS b FROM cl)"""
_TS = f"ts AS (SELECT pk, qrr, trr * 4 AS trr, {_C.format('10 + pk % 50')} AS i_f, (100::DOUBLE + (pk % 9) * 50) * 1e6 AS a, coss * abs(vds) AS qoss FROM dparts)"
_FIT = f"""{_TS}, f1 AS (SELECT *, ln(10::DOUBLE) AS l, qrr > 0 AND trr > 0 AND i_f > 0 AS good FROM ts), f2 AS (SELECT *, (l - 2) / (2 * a * l) AS ca, trr / l AS cb FROM f1),
  f3 AS (SELECT *, CASE WHEN good AND cb * cb + 4 * ca * qrr >= 0 THEN 2 * qrr / (cb + sqrt(greatest(cb * cb + 4 * ca * qrr, 0))) END AS irrm FROM f2), f4 AS (SELECT *, (trr - irrm / a) / l AS td0 FROM f3), f5 AS (SELECT *, CASE WHEN td0 > 0 THEN td0 END AS td FROM f4),
  f6 AS (SELECT *, (i_f + irrm) / a AS t0 FROM f5), f7 AS (SELECT *, greatest(10 * td, 10 * t0, 1e-6) AS hi FROM f6),
  f8 AS (SELECT *, list_reduce(list_transform(range(101), lambda k: {{'lo': td * (1 + 1e-9), 'hi': hi}}), lambda s, x: {{
     'lo': CASE WHEN a * ((s.lo + s.hi) / 2 - td) * (1 - exp(-t0 / ((s.lo + s.hi) / 2))) - irrm < 0 THEN (s.lo + s.hi) / 2 ELSE s.lo END,
     'hi': CASE WHEN a * ((s.lo + s.hi) / 2 - td) * (1 - exp(-t0 / ((s.lo + s.hi) / 2))) - irrm < 0 THEN s.hi ELSE (s.lo + s.hi) / 2 END}}) AS r FROM f7 WHERE td IS NOT NULL)"""
PREDICTED_SQL = """q1 AS (SELECT *, life * td / (life - td) AS tm FROM q0), q2 AS (SELECT *, life * tm / (life + tm) AS d FROM q1),
  q3 AS (SELECT *, list_reduce(list_transform(range(101), lambda k: {'lo': 0::DOUBLE, 'hi': greatest(1::DOUBLE, 10 * oa * life)}), lambda s, x: {
     'lo': CASE WHEN oa * (life - d) * (1 - exp(-(oi + (s.lo + s.hi) / 2) / (oa * life))) - (s.lo + s.hi) / 2 > 0 THEN (s.lo + s.hi) / 2 ELSE s.lo END,
     'hi': CASE WHEN oa * (life - d) * (1 - exp(-(oi + (s.lo + s.hi) / 2) / (oa * life))) - (s.lo + s.hi) / 2 > 0 THEN s.hi ELSE (s.lo + s.hi) / 2 END}) AS o FROM q2),
  q4 AS (SELECT *, CASE WHEN life > 0 AND tm > 0 THEN (o.lo + o.hi) / 2 END AS x FROM q3)"""
FIT_SQL = _FIT
_L, _K = "list_aggregate(s.ys, 'median')", "CASE WHEN p.g / s.mean BETWEEN 0.75 AND 1.25 THEN 1 WHEN p.g / s.mean BETWEEN 1.5 AND 2.5 THEN 2 END"
_STAYS, _CLOSES = f"abs(p.y - {_L}) <= 15", f"len(s.ys) > 1 AND (s.prev IS NULL OR s.prev < {_L}) AND {{up}} AND (s.bx0 IS NULL OR s.xl - s.x0 > s.bx1 - s.bx0)"
_BETTER = "s.n + 1 > s.bn"

SQL = {
    "h15_predict": f"""WITH {DPARTS_SQL}, {_FIT}, q0 AS (SELECT pk, (r.lo + r.hi) / 2 AS life, td, {_C.format('30 + pk % 20')} AS oi, {_C.format('200 + (pk % 7) * 100')} * 1e6 AS oa FROM f8), {PREDICTED_SQL}
        SELECT pk, round((x * x / (2 * oa) + x * d) * 1e9, 5) AS qrr_nc, round((x / oa + d * ln(10::DOUBLE)) * 1e9, 5) AS trr_ns, round(x, 5) AS irrm FROM q4""",
    "h23_integral": f"""WITH {_CURVE}, e AS (SELECT user_id, min(v) AS lo, max(v) AS hi, arg_max(c, v) AS c_hi FROM cu GROUP BY user_id), g AS (SELECT e.*, i, CASE WHEN lo + (hi - lo) / 399 * i < hi THEN lo + (hi - lo) / 399 * i ELSE hi END AS x FROM e CROSS JOIN range(400) r(i)),
        s AS (SELECT user_id, v, c, lead(v) OVER w AS v2, lead(c) OVER w AS c2 FROM cu WINDOW w AS (PARTITION BY user_id ORDER BY v)),
        y AS (SELECT g.user_id, g.i, g.lo, g.hi, CASE WHEN g.x = g.hi THEN g.c_hi ELSE s.c + (s.c2 - s.c) * (g.x - s.v) / (s.v2 - s.v) END AS y FROM g LEFT JOIN s ON g.user_id = s.user_id AND g.x >= s.v AND g.x < s.v2)
        SELECT user_id, round((sum(y) - (max(CASE WHEN i = 0 THEN y END) + max(CASE WHEN i = 399 THEN y END)) / 2) * (max(hi) - max(lo)) / 399, 5) AS area FROM y GROUP BY user_id""",
    "h14_fit": f"""WITH {DPARTS_SQL}, {_FIT} SELECT f7.pk, round(f7.irrm, 6) AS irrm, round(f7.td * 1e9, 5) AS td_ns, round((f8.r.lo + f8.r.hi) / 2 * 1e9, 5) AS tau_ns,
        CASE WHEN NOT coalesce(f7.good, false) THEN 'input' WHEN f7.td IS NULL THEN 'ramp' END AS fault FROM f7 LEFT JOIN f8 ON f7.pk = f8.pk""",
    "h16_tau_at": f"WITH {DPARTS_SQL} SELECT pk, round(trr * 4 * 1e9 * pow((25::DOUBLE + pk % 100 + 273.15) / (25 + 273.15), 1.2), 6) AS tau_ns FROM dparts",
    "h20_diffusion": f"WITH {DPARTS_SQL}, {_TS} SELECT pk, round(CASE WHEN qoss IS NULL THEN qrr WHEN qrr - 0.1 * qoss > 0 THEN qrr - 0.1 * qoss END * 1e9, 6) AS q_nc FROM ts",
    "e17_pairs": """WITH g AS (SELECT l_partkey AS part, CAST(l_linenumber % 3 AS DOUBLE) AS i_f, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY hi / lo DESC, i_f) AS rn FROM g WHERE hi > lo)
        SELECT part, i_f, lo AS didt_lo, hi AS didt_hi FROM r WHERE rn = 1""",
    "h22_interpolate": f"WITH {_CURVE} SELECT user_id, " + ", ".join(f"round({_AT.format(x=x)}, 6) AS at_{x}" for x in (0, 17, 30, 59)) + " FROM (SELECT DISTINCT user_id FROM cu) u",
    "a26_collapse": f"WITH {_CURVE} SELECT user_id, v, round(c, 6) AS c FROM cu",
    "d14_calibrate": "SELECT text_row_id, round((bbox.x2 - bbox.x1) / (600 - bbox.x1) * 100, 6) AS lin, round(exp((bbox.x2 - bbox.x1) / (600 - bbox.x1) * ln(1000::DOUBLE)), 6) AS log FROM text_rows",
    "d15_tick_runs": f"""WITH u AS (SELECT DISTINCT mpn, page_num, bbox.y1 AS y FROM text_rows), g AS (SELECT *, lead(y) OVER (PARTITION BY mpn, page_num ORDER BY y) AS y2 FROM u WHERE y IS NOT NULL),
        l AS (SELECT mpn, page_num, list({{'a': y, 'b': y2, 'g': y2 - y, 'start': y, 'mean': y2 - y, 'n': 1, 'bf': NULL::DOUBLE, 'bl': NULL::DOUBLE, 'bn': 0, 'bs': NULL::DOUBLE}} ORDER BY y) AS gaps FROM g WHERE y2 IS NOT NULL GROUP BY mpn, page_num),
        r AS (SELECT mpn, page_num, list_reduce(gaps, lambda s, p: {{'a': p.a, 'b': p.b, 'g': p.g, 'start': CASE WHEN {_K} IS NULL THEN p.a ELSE s.start END, 'mean': CASE WHEN {_K} IS NULL THEN p.g ELSE (s.mean * s.n + p.g / {_K}) / (s.n + 1) END, 'n': CASE WHEN {_K} IS NULL THEN 1 ELSE s.n + 1 END,
          'bf': CASE WHEN {_K} IS NULL AND {_BETTER} THEN s.start ELSE s.bf END, 'bl': CASE WHEN {_K} IS NULL AND {_BETTER} THEN s.b ELSE s.bl END, 'bn': CASE WHEN {_K} IS NULL AND {_BETTER} THEN s.n + 1 ELSE s.bn END, 'bs': CASE WHEN {_K} IS NULL AND {_BETTER} THEN s.mean ELSE s.bs END}}) AS s FROM l)
        SELECT k.mpn, k.page_num, CASE WHEN {_BETTER} THEN s.start ELSE s.bf END AS first, CASE WHEN {_BETTER} THEN s.b ELSE s.bl END AS last, CAST(coalesce(CASE WHEN {_BETTER} THEN s.n + 1 ELSE s.bn END, 0) AS BIGINT) AS n, round(CASE WHEN {_BETTER} THEN s.mean ELSE s.bs END, 6) AS spacing
        FROM (SELECT DISTINCT mpn, page_num FROM text_rows) k LEFT JOIN r ON k.mpn IS NOT DISTINCT FROM r.mpn AND k.page_num IS NOT DISTINCT FROM r.page_num""",
    "d16_plateaus": f"""WITH {_CURVE}, l AS (SELECT user_id, list({{'x': v, 'y': c, 'ys': [c], 'x0': v, 'xl': v, 'prev': NULL::DOUBLE, 'bx0': NULL::DOUBLE, 'bx1': NULL::DOUBLE, 'bl': NULL::DOUBLE}} ORDER BY v, c) AS pts FROM cu GROUP BY user_id),
        r AS (SELECT user_id, list_reduce(pts, lambda s, p: {{'x': p.x, 'y': p.y, 'ys': CASE WHEN {_STAYS} THEN list_append(s.ys, p.y) ELSE [p.y] END, 'x0': CASE WHEN {_STAYS} THEN s.x0 ELSE p.x END, 'xl': p.x, 'prev': CASE WHEN {_STAYS} THEN s.prev ELSE s.y END,
          'bx0': CASE WHEN NOT ({_STAYS}) AND {_CLOSES.format(up=f'p.y > {_L}')} THEN s.x0 ELSE s.bx0 END, 'bx1': CASE WHEN NOT ({_STAYS}) AND {_CLOSES.format(up=f'p.y > {_L}')} THEN s.xl ELSE s.bx1 END, 'bl': CASE WHEN NOT ({_STAYS}) AND {_CLOSES.format(up=f'p.y > {_L}')} THEN {_L} ELSE s.bl END}}) AS s FROM l)
        SELECT user_id, CASE WHEN {_CLOSES.format(up='true')} THEN s.x0 ELSE s.bx0 END AS x_from, CASE WHEN {_CLOSES.format(up='true')} THEN s.xl ELSE s.bx1 END AS x_to, round(CASE WHEN {_CLOSES.format(up='true')} THEN {_L} ELSE s.bl END, 6) AS level FROM r""",
    "d1_overlap": """WITH t AS (SELECT text_row_id, bbox AS a, lead(bbox) OVER (PARTITION BY mpn, page_num ORDER BY text_row_id) AS b FROM text_rows) SELECT text_row_id,
        round(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / least(a.x2 - a.x1, b.x2 - b.x1), 6) AS x_share, round(greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)), 6) AS y_common, round(greatest(a.y2, b.y2), 6) AS y2 FROM t WHERE b IS NOT NULL""",
    "d6_neighbours": """WITH t AS (SELECT mpn, page_num, text_row_id AS id, bbox AS b FROM text_rows WHERE mpn IS NOT NULL), p AS (SELECT a.id, o.b.x1 - a.b.x2 AS r, a.b.x1 - o.b.x2 AS l, o.b.y1 - a.b.y2 AS u, a.b.y1 - o.b.y2 AS d,
          greatest(0, least(a.b.y2, o.b.y2) - greatest(a.b.y1, o.b.y1)) / nullif(least(a.b.y2 - a.b.y1, o.b.y2 - o.b.y1), 0) AS across, greatest(0, least(a.b.x2, o.b.x2) - greatest(a.b.x1, o.b.x1)) / nullif(least(a.b.x2 - a.b.x1, o.b.x2 - o.b.x1), 0) AS along
          FROM t a JOIN t o ON a.mpn = o.mpn AND a.page_num = o.page_num AND a.id <> o.id)
        SELECT id, 'right' AS direction, round(min(r), 4) AS gap FROM p WHERE r >= 0 AND across >= 0.4 GROUP BY id UNION ALL SELECT id, 'left', round(min(l), 4) FROM p WHERE l >= 0 AND across >= 0.4 GROUP BY id
        UNION ALL SELECT id, 'above', round(min(u), 4) FROM p WHERE u >= 0 AND along >= 0.4 GROUP BY id UNION ALL SELECT id, 'below', round(min(d), 4) FROM p WHERE d >= 0 AND along >= 0.4 GROUP BY id""",
    "d8_tables": """WITH s AS (SELECT mpn, page_num, lag(bbox.y1) OVER (PARTITION BY mpn, page_num ORDER BY bbox.y1 DESC, text_row_id) - bbox.y2 AS st, n_words <= 3 AS h FROM text_rows)
        SELECT mpn, page_num, CAST(sum(CASE WHEN st IS NULL OR st >= 30 OR h THEN 1 ELSE 0 END) AS BIGINT) AS tables, count(*) AS rows FROM s GROUP BY mpn, page_num""",
    "h24_verdicts": f"WITH {DPARTS_SQL} SELECT pk, {_V.format(e='abs((qrr - qg) / qg) * 100', w=10, f=30)} AS qrr, {_CAP} AS cap FROM dparts",
    "g7_tally": f"WITH {DPARTS_SQL}, v AS (SELECT mfr, {_CAP} AS v FROM dparts) SELECT mfr, " + ", ".join(f"count(*) FILTER (WHERE v = '{x}') AS {x.lower()}" for x in ("PASS", "WARN", "FAIL", "UNVERIFIED")) + " FROM v GROUP BY mfr",
    "g10_errors": f"WITH {DPARTS_SQL}, e AS (SELECT id / 100 - 1 AS err FROM dparts WHERE id IS NOT NULL), r AS (SELECT err, row_number() OVER (ORDER BY err) - 1 AS i, count(*) OVER () AS n FROM e) SELECT max(n) AS n, round(avg(err), 6) AS bias, " + ", ".join(f"round(max(CASE WHEN i = CAST(floor(n * {s}) AS BIGINT) THEN err END), 6) AS {c}" for c, s in (("median", 0.5), ("p90", 0.9), ("q1", 0.25), ("q3", 0.75))) + " FROM r",
    "h25_core": f"WITH {DPARTS_SQL}, {_COIL} SELECT pk, round(mu, 6) AS mu_share, round(l0 * mu * 1e6, 6) AS l_dc_uh, round(b, 8) AS b_pk, round((f / (la / pow(b * 1e4, 3) + lb / pow(b * 1e4, 2.3) + lc / pow(b * 1e4, 1.65)) + ld * b * 1e4 * b * 1e4 * f * f) * a_e * l_e * 1e3, 4) AS p_core FROM bp",
    "h26_wire": f"WITH {DPARTS_SQL}, {_COIL} SELECT pk, round(36 - 39 * (log10(d * 1e3 / 0.127) / log10(92::DOUBLE)), 6) AS awg, round(sqrt(1.71e-8 / (pi() * f * (4e-7 * pi()))) * 1e3, 6) AS skin_mm, round(skin, 6) AS skin, round(near, 5) AS near FROM sk",
    "h27_coil_loss": f"WITH {DPARTS_SQL}, {_COIL} SELECT pk, round((io * io + di * di / 12) * r_dc, 6) AS p_dcr, round(di * di / 12 * (1 + skin + near) * r_dc, 6) AS p_acr, round(pow(io * sqrt((vi - vo) * vo) / vi, 2) * 2e-3, 6) AS p_cin, round(di * di / 12 * 5e-3, 6) AS p_cout, round(io * duty * (1 - duty) / (f * 0.5) * 1e6, 6) AS c_in_uf, round(di / (8 * f * 0.1) * 1e6, 6) AS c_out_uf FROM sk",
    "h29_turns": f"WITH {DPARTS_SQL}, {_COIL} SELECT pk, min(CAST(t AS INTEGER)) AS turns FROM co CROSS JOIN range(1, 100) k(t) WHERE t * t * (4e-7::DOUBLE * pi() * mu_r * a_e / l_e) >= 40e-6 GROUP BY pk",
}

"""Queries of the loss models and rankings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampmill.operators import loss, specs
from ampmill.sources.derived import DPARTS_SQL, dparts


def _point(spark: SparkSession) -> DataFrame:
    return loss.operating_point(loss.scenario(spark))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.with_foms(specs.complete_gate_charge(dparts(spark, sf_dir)))


def _w(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def f5_vds_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = dparts(spark, sf_dir).crossJoin(F.broadcast(_point(spark)))
    return j.select("pk", loss.vds_in_range(F.col("vds")).alias("vds_ok"), loss.id_in_range(F.col("id"), F.lit(2.0)).alias("id_ok"))


def f7_preselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loss.preselect(dparts(spark, sf_dir), _point(spark)).select("pk", "mpn")


def f13_self_turn_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).filter(F.coalesce(~(F.col("qgd_qgs_ratio") > 1), F.lit(True))).select("pk", F.round("qgd_qgs_ratio", 6).alias("ratio"))


def f15_foms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("pk", *_w("fom", "fom_qrr", "fom_qsw", "fom_coss", "qgd_qgs_ratio", "coss_v0"), F.round(F.col("qg_sync") * 1e9, 6).alias("qg_sync_nc"), F.round(F.col("qg_odr") * 1e9, 6).alias("qg_odr_nc"))


def f16_gate_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion where some parts come with a switching charge and some with a threshold charge of their own."""
    pk = F.col("pk")
    parts = dparts(spark, sf_dir).withColumn("qsw_raw", F.when(pk % 5 == 0, F.col("qgd") * 1.3)).withColumn("qg_th", F.when(pk % 7 == 0, F.col("qgs") * 0.5))
    return specs.complete_gate_charge(parts).select("pk", *[F.round(F.col(c) * 1e9, 6).alias(f"{c}_nc") for c in ("qgs2", "qg_th", "qsw")], "qg_th_estimated")


def h5_gan_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The high-side losses with every part taken as GaN: lower drive voltage and plateau."""
    gan = _records(spark, sf_dir).withColumn("substrate", F.lit("GaN"))
    hs = loss.high_side(gan.crossJoin(F.broadcast(_point(spark))))
    return hs.select("pk", F.round(F.col("tr") * 1e9, 6).alias("tr_ns"), F.round(F.col("tf") * 1e9, 6).alias("tf_ns"), *_w("p_sw", "p_gd"), F.round(loss.hs_total(), 6).alias("p_total"))


def h3_hot_resistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resistance at junction temperatures: unknown, 25 °C, and one that the model doesn't support."""
    tj = F.when(F.col("pk") % 3 == 1, 25.0).when(F.col("pk") % 3 == 2, 100.0)
    return dparts(spark, sf_dir).select("pk", F.round(loss.resistance_at(F.col("rds_on"), tj) * 1e3, 6).alias("rds_mohm"))


def b2_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three report layouts over one evaluation of the losses: per part, high side, low side (long form: layout, pk, column, value)."""
    base = _records(spark, sf_dir).crossJoin(F.broadcast(_point(spark)))
    hs = loss.high_side(base)
    both = _low_side_of(hs)
    of = lambda layout, **cols: [F.struct(F.lit(layout).alias("layout"), F.lit(name).alias("name"), F.round(c, 6).alias("value")) for name, c in cols.items()]
    cells = [
        *of("part", vds=F.col("vds"), rds_mohm=F.col("rds_on") * 1e3, fom=F.col("fom"), p_hs=loss.hs_total(), p_ls=F.col("ls.p_total")),
        *of("hs", p_cl=F.col("p_cl"), p_sw=F.col("p_sw"), p_coss=F.col("p_coss"), p_gd=F.col("p_gd"), p_total=loss.hs_total()),
        *of("ls", p_cl=F.col("ls.p_cl"), p_rr=F.col("ls.p_rr"), p_coss=F.col("ls.p_coss"), p_gd=F.col("ls.p_gd"), p_dt=F.col("ls.p_dt"), p_total=F.col("ls.p_total")),
    ]
    return both.select("pk", F.inline(F.array(*cells))).filter("value is not null")


def _low_side_of(hs: DataFrame) -> DataFrame:
    """hs with the same part's losses as low side in a struct ls."""
    kept = [c for c in hs.columns if c not in ("p_cl", "p_sw", "p_coss", "p_rr", "p_gd", "p_dt", "q_oss")]
    named = hs.select(*kept, F.struct(*[F.col(c) for c in ("p_cl", "p_sw", "p_coss", "p_rr", "p_gd", "p_dt")]).alias("hs"))
    low = loss.low_side(named)
    low = low.withColumn("ls", F.struct("p_cl", "p_coss", "p_rr", "p_gd", "p_dt", loss.ls_total().alias("p_total")))
    return low.select(*kept, "ls", *[F.col("hs")[c].alias(c) for c in ("p_cl", "p_sw", "p_coss", "p_rr", "p_gd", "p_dt")])


def f17_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _records(spark, sf_dir)
    return df.select("pk", F.array_join(specs.violations(df), ",").alias("violations"))


def f18_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dparts(spark, sf_dir)
    return df.select("pk", F.array_join(specs.catalogue_faults(F.col("vds"), F.col("rds_on"), F.col("id"), F.col("vpl") * 4), ",").alias("faults"))


def h1_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operating points of every supplier row taken as a scenario (input 40..99 V, output 12..35 V)."""
    from ampmill.session import table

    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("sk"), (40.0 + k % 60).alias("vi"), (12.0 + k % 24).alias("vo"), (100.0 + (k * 37) % 900).alias("pin"), (20e3 + (k * 131 % 200) * 1e3).alias("f"), (0.1 + (k % 15) * 0.1).alias("ripple"))
    return loss.operating_point(s).select("sk", *_w("io", "duty", "di", "io_min", "io_max", "i2_mean", "i2_ac"), F.round(F.col("l") * 1e9, 3).alias("l_nh"), "ccm")


def h4_coss_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs = loss.high_side(_records(spark, sf_dir).crossJoin(F.broadcast(_point(spark))))
    return hs.select("pk", *_w("p_coss"), F.round(F.col("q_oss") * 1e9, 6).alias("q_oss_nc"))


def h5_hs_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs = loss.high_side(_records(spark, sf_dir).crossJoin(F.broadcast(_point(spark))))
    return hs.select("pk", F.round(F.col("tr") * 1e9, 6).alias("tr_ns"), F.round(F.col("tf") * 1e9, 6).alias("tf_ns"), *_w("p_cl", "p_sw", "p_coss", "p_gd"), F.round(loss.hs_total(), 6).alias("p_total"))


def h6_lcsi_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _records(spark, sf_dir).crossJoin(F.broadcast(_point(spark)))
    rise, fall = loss.switch_times_inductive(F.col("qgs2"), F.col("qgd"), F.coalesce("vpl", "vpl_fallback"), F.greatest("rg", "rg_on"), F.col("von"), F.col("voff"), F.col("io_min"), F.col("io_max"), F.lit(1e-9), F.lit(100e-9))
    return j.select("pk", F.round(rise * 1e9, 5).alias("tr_ns"), F.round(fall * 1e9, 5).alias("tf_ns"), F.round(loss.losses_from_times(F.when(F.col("pk") % 3 != 0, F.col("trr")), F.when(F.col("pk") % 3 != 1, F.col("trr") / 2)), 6).alias("p_trf"))


def h6_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rise and fall times by the two simpler models."""
    j = _records(spark, sf_dir).crossJoin(F.broadcast(_point(spark))).withColumn("vp", F.coalesce("vpl", "vpl_fallback")).withColumn("r", F.greatest("rg", "rg_on"))
    a, b = loss.switch_times_constant(F.col("qsw"), F.col("vp"), F.col("r"), F.col("von"), F.col("voff"))
    c, d = loss.switch_times_one_resistance(F.col("qgs2"), F.col("qgd"), F.col("vp"), F.col("vp") * F.try_divide("qg_th", "qgs"), F.col("r"), F.col("von"), F.col("voff"))
    return j.select("pk", *[F.round(x * 1e9, 6).alias(n) for n, x in (("tr_const_ns", a), ("tf_const_ns", b), ("tr_one_ns", c), ("tf_one_ns", d))])


def h7_ls_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = loss.low_side(_records(spark, sf_dir).crossJoin(F.broadcast(_point(spark))))
    return ls.select("pk", *_w("p_cl", "p_coss", "p_rr", "p_gd", "p_dt"), F.round(loss.ls_total(), 6).alias("p_total"))


def h10_hs_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = loss.rank_high_side(_records(spark, sf_dir), _point(spark))
    return r.select("pk", "mpn", "n", *_w("p_cl", "p_sw", "p_coss", "p_gd", "p_total"))


def h12_ls_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = loss.rank_low_side(_records(spark, sf_dir), _point(spark))
    return r.select("pk", "mpn", "n", *_w("p_cl", "p_rr", "p_coss", "p_gd", "p_dt", "p_total"))


def h13_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per part: both switch positions, alone and as two in parallel, in one projection."""
    both = _low_side_of(loss.high_side(_records(spark, sf_dir).crossJoin(F.broadcast(_point(spark)))))
    hs = both.select("*", F.round(loss.hs_total(), 6).alias("p_hs"))
    hs2 = loss.in_parallel(hs, F.lit(2)).select("pk", "p_hs", F.round(loss.hs_total(), 6).alias("p_hs_2"), "ls")
    ls = hs2.select("pk", "p_hs", "p_hs_2", F.round("ls.p_total", 6).alias("p_ls"), F.lit(0.0).alias("p_sw"), F.lit(0.0).alias("q_oss"), *[F.col("ls")[c].alias(c) for c in ("p_cl", "p_coss", "p_rr", "p_gd", "p_dt")])
    return loss.in_parallel(ls, F.lit(2)).select("pk", "p_hs", "p_hs_2", "p_ls", F.round(loss.ls_total(), 6).alias("p_ls_2"))


def h11_staged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loss.staged_pairs(_records(spark, sf_dir), _point(spark)).select("sw", "cond", "n", F.round("p", 6).alias("p"))


def w3_top_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = loss.rank_high_side(_records(spark, sf_dir), _point(spark))
    return loss.cheapest(r.filter("n = 1"), "p_total", 5000).select("pk", F.round("p_total", 6).alias("p_total"))


QUERIES = {f.__name__: f for f in (f5_vds_window, f7_preselect, f13_self_turn_on, f15_foms, f16_gate_charge, h5_gan_loss, h3_hot_resistance, b2_layouts, f17_violations, f18_catalogue, h1_operating_point, h4_coss_loss, h5_hs_loss, h6_lcsi_times, h6_variants, h7_ls_loss, h10_hs_ranking, h12_ls_ranking, h13_report, h11_staged_pairs, w3_top_losses)}

# The same models in SQL, with the scenario's numbers as literals.
_D = "CAST({} AS DOUBLE)"
_SC = f"""sc AS (SELECT {_D.format(62)} AS vi, {_D.format(27)} AS vo, 800 / {_D.format(27)} AS io, {_D.format('40e3')} AS f, {_D.format('300e-9')} AS t_dead,
   {_D.format(6)} AS rg_on, {_D.format(6)} AS rg_off, {_D.format(10)} AS von, {_D.format(0)} AS voff, {_D.format('4.5')} AS vplf, 2 AS maxp),
  op AS (SELECT *, io * {_D.format('0.3')} AS di, vo / vi AS duty FROM sc),
  pt AS (SELECT *, io - di / 2 AS io_min, io + di / 2 AS io_max,
     ((io + di / 2) * (io + di / 2) + (io + di / 2) * (io - di / 2) + (io - di / 2) * (io - di / 2)) / 3 AS i2 FROM op)"""
_REC = f"""rec AS (SELECT *, qgs * (1 - {_D.format('0.55')}) AS qg_th, qgs - qgs * (1 - {_D.format('0.55')}) AS qgs2, qgd + (qgs - qgs * (1 - {_D.format('0.55')})) AS qsw,
   CASE WHEN abs(vds) > 1 THEN abs(vds) / 2 END AS v0 FROM dparts)"""
_ALL = f"WITH {DPARTS_SQL}, {_REC}, {_SC}, j AS (SELECT * FROM rec CROSS JOIN pt)"
_VDS = "coalesce(abs(vds) < 2 OR (NOT (vds < vi * 1.1) AND NOT (vds > greatest(50, vi * 3))), true)"
_ID = "coalesce(NOT (id < io_max * 1.2 / {}), true)"
_PRE = f"pre AS (SELECT * FROM j WHERE {_VDS} AND {_ID.format(2)} AND coalesce(NOT (rds_on > vo * io * 0.01 / (io * io) * 2 * 2), true))"
_TIMES = """tm AS (SELECT *, coalesce(vpl, vplf) AS vp, coalesce(vpl, vplf) * (qg_th / qgs) AS vt FROM {src}),
  ti AS (SELECT *, (vp + vt) / 2 AS vir FROM tm),
  tt AS (SELECT *, CASE WHEN von > vp AND vp > vt THEN (qgs2 / (von - vir) + qgd / (von - vp)) * greatest(coalesce(rg, rg_on), rg_on) END AS tr,
    CASE WHEN von > vp AND vp > vt THEN (qgs2 / (vir - voff) + qgd / (vp - voff)) * greatest(coalesce(rg, rg_off), rg_off) END AS tf FROM ti)"""
_PC = "(CASE WHEN v0 > 0 THEN CAST(2 AS DOUBLE) / 3 * coss * pow(vi, 1.5) * sqrt(v0) ELSE CAST(2 AS DOUBLE) / 3 * coss * vi * vi END * f)"
_QO = "(CASE WHEN v0 > 0 THEN 2 * coss * sqrt(v0 * vi) ELSE 2 * coss * vi END)"
_HS = f"""hs AS (SELECT *, duty * i2 * rds_on * 1.22 AS p_cl, 0.5 * vi * f * (io_min * tr + io_max * tf) AS p_sw, {_PC} AS p_coss, {_QO} AS q_oss, (von - voff) * f * qg AS p_gd FROM tt)"""
_LS = f"""ls AS (SELECT *, (1 - duty) * i2 * rds_on * 1.22 AS p_cl, {_PC} * 2 AS p_coss, vi * f * qrr * 1.2 AS p_rr, (von - voff) * f * qg AS p_gd,
   abs(coalesce(nullif(vsd, 0), 1)) * (io_max + io_min) * t_dead * f AS p_dt FROM {{src}})"""
_R = "CAST(round({0}, 6) AS DOUBLE) AS {1}"


def _r(*names: str) -> str:
    return ", ".join(_R.format(n, n) for n in names)


_RULES = """CASE WHEN NOT (vpl BETWEEN 2 AND 9) THEN 'vpl' END, CASE WHEN NOT (rds_on * qg * 1e12 > 10 AND rds_on * qg * 1e12 < 20000) THEN 'fom' END,
  CASE WHEN NOT (qg > 0.2e-9 AND qg < 2000e-9) THEN 'qg' END, CASE WHEN NOT (qrr >= 0 AND qrr < 200e-6) THEN 'qrr' END,
  CASE WHEN NOT (qrr / trr BETWEEN 0.01 AND 40) THEN 'qrr_trr' END, CASE WHEN NOT (abs(vsd) > 0.2 AND abs(vsd) < 5) THEN 'vsd' END,
  CASE WHEN NOT (qg * rds_on > 2e-11 AND qg * rds_on < 2e-8) THEN 'qg_rds' END, CASE WHEN NOT (qg_th / qgs > 0.2 AND qg_th / qgs < 0.8) THEN 'qg_th_qgs' END"""

SQL = {
    "f5_vds_window": f"{_ALL} SELECT pk, {_VDS} AS vds_ok, {_ID.format(2)} AS id_ok FROM j",
    "f7_preselect": f"{_ALL}, {_PRE} SELECT pk, mpn FROM pre",
    "f13_self_turn_on": f"WITH {DPARTS_SQL} SELECT pk, round(qgd / qgs, 6) AS ratio FROM dparts WHERE coalesce(NOT (qgd / qgs > 1), true)",
    "f15_foms": f"""WITH {DPARTS_SQL}, {_REC} SELECT pk, round(rds_on * 1e3 * qg * 1e9, 6) AS fom, round(rds_on * 1e3 * qrr * 1e9, 6) AS fom_qrr, round(rds_on * 1e3 * qsw * 1e9, 6) AS fom_qsw,
        round(rds_on * 1e3 * coss * 1e12, 6) AS fom_coss, round(qgd / qgs, 6) AS qgd_qgs_ratio, round(v0, 6) AS coss_v0, round((qg - qgd) * 1e9, 6) AS qg_sync_nc, round((qg - qgd - qgs) * 1e9, 6) AS qg_odr_nc FROM rec""",
    "f16_gate_charge": f"""WITH {DPARTS_SQL}, g0 AS (SELECT *, CASE WHEN pk % 5 = 0 THEN qgd * 1.3 END AS qsw0, CASE WHEN pk % 7 = 0 THEN qgs * 0.5 END AS qth0 FROM dparts), g1 AS (SELECT *, CASE WHEN qsw0 > qgd THEN qsw0 - qgd END AS q2 FROM g0),
        g2 AS (SELECT *, coalesce(qth0, CASE WHEN qsw0 IS NOT NULL THEN qgs + qgd - qsw0 END, qgs - q2) AS known FROM g1), g3 AS (SELECT *, coalesce(known, qgs * (1 - {_D.format('0.55')})) AS qth FROM g2)
        SELECT pk, round(coalesce(q2, qgs - qth) * 1e9, 6) AS qgs2_nc, round(qth * 1e9, 6) AS qg_th_nc, round(coalesce(qsw0, qgd + coalesce(q2, qgs - qth)) * 1e9, 6) AS qsw_nc, known IS NULL AND qgs IS NOT NULL AS qg_th_estimated FROM g3""",
    "h5_gan_loss": (f"{_ALL}, {_TIMES.format(src='j')}, {_HS} SELECT pk, round(tr * 1e9, 6) AS tr_ns, round(tf * 1e9, 6) AS tf_ns, {_r('p_sw', 'p_gd')}, round(p_cl + p_coss + p_gd + p_sw, 6) AS p_total FROM hs").replace(f"{_D.format(10)} AS von", f"{_D.format(5)} AS von").replace(f"{_D.format('4.5')} AS vplf", f"{_D.format('2.25')} AS vplf"),
    "h3_hot_resistance": f"WITH {DPARTS_SQL} SELECT pk, round(CASE pk % 3 WHEN 0 THEN rds_on * 1.22 WHEN 1 THEN rds_on END * 1e3, 6) AS rds_mohm FROM dparts",
    "b2_layouts": f"""{_ALL}, {_TIMES.format(src='j')}, {_HS}, {_LS.format(src='j')}, b AS (SELECT hs.pk, hs.vds, hs.rds_on * 1e3 AS rds_mohm, hs.rds_on * 1e3 * hs.qg * 1e9 AS fom, hs.p_cl AS h_cl, hs.p_sw AS h_sw, hs.p_coss AS h_coss, hs.p_gd AS h_gd, hs.p_cl + hs.p_coss + hs.p_gd + hs.p_sw AS h_total,
        ls.p_cl AS l_cl, ls.p_rr AS l_rr, ls.p_coss AS l_coss, ls.p_gd AS l_gd, ls.p_dt AS l_dt, ls.p_cl + ls.p_coss + ls.p_gd + ls.p_dt + ls.p_rr AS l_total FROM hs JOIN ls ON hs.pk = ls.pk),
      u AS ({' UNION ALL '.join(f"SELECT pk, '{layout}' AS layout, '{name}' AS name, round({c}, 6) AS value FROM b" for layout, name, c in [('part', 'vds', 'vds'), ('part', 'rds_mohm', 'rds_mohm'), ('part', 'fom', 'fom'), ('part', 'p_hs', 'h_total'), ('part', 'p_ls', 'l_total'), ('hs', 'p_cl', 'h_cl'), ('hs', 'p_sw', 'h_sw'), ('hs', 'p_coss', 'h_coss'), ('hs', 'p_gd', 'h_gd'), ('hs', 'p_total', 'h_total'), ('ls', 'p_cl', 'l_cl'), ('ls', 'p_rr', 'l_rr'), ('ls', 'p_coss', 'l_coss'), ('ls', 'p_gd', 'l_gd'), ('ls', 'p_dt', 'l_dt'), ('ls', 'p_total', 'l_total')])})
      SELECT * FROM u WHERE value IS NOT NULL""",
    "h28_sweep": f"""WITH {DPARTS_SQL}, {_REC}, pw AS (SELECT 5 * pow({_D.format('1.1')}, i) AS pin FROM range(80) r(i)), {_SC.replace('sc AS (SELECT', 'sc AS (SELECT pin,').replace(f"800 / {_D.format(27)} AS io", f"pin / {_D.format(27)} AS io").replace(' AS maxp)', ' AS maxp FROM pw WHERE pin < 2000)').replace(f"io * {_D.format('0.3')} AS di, vo / vi AS duty", "vo / (f * 50e-6) * (1 - vo / vi) AS di, vo / vi AS duty")},
      j AS (SELECT * FROM rec CROSS JOIN pt WHERE di < 2 * io), {_TIMES.format(src='j')}, {_HS}
      SELECT round(pin, 4) AS pin, count(p_cl + p_coss + p_gd + p_sw) AS n, round(avg(p_cl + p_coss + p_gd + p_sw), 5) AS mean_loss, round(max(1 - (p_cl + p_coss + p_gd + p_sw) / pin), 6) AS best_efficiency FROM hs GROUP BY pin""",
    "g8_reasons": f"WITH {DPARTS_SQL}, {_REC}, u AS (SELECT mfr, unnest([{_RULES}]) AS reason FROM rec) SELECT mfr, reason, count(*) AS n FROM u WHERE reason IS NOT NULL GROUP BY mfr, reason",
    "f17_violations": f"WITH {DPARTS_SQL}, {_REC} SELECT pk, concat_ws(',', {_RULES}) AS violations FROM rec",
    "f18_catalogue": f"""WITH {DPARTS_SQL} SELECT pk, concat_ws(',', CASE WHEN NOT (rds_on * 1000 / abs(vds) BETWEEN 0.002 AND 1000) THEN 'rds_vds' END,
        CASE WHEN NOT (abs(vds) * id * 1e-3 > 0.1 AND abs(vds) * id * 1e-3 < CASE WHEN vds < 0 THEN 60 ELSE 95 END) THEN 'power' END, CASE WHEN NOT (vpl * 4 <= 15) THEN 'vth' END) AS faults FROM dparts""",
    "h1_operating_point": """WITH s AS (SELECT s_suppkey AS sk, CAST(40 + s_suppkey % 60 AS DOUBLE) AS vi, CAST(12 + s_suppkey % 24 AS DOUBLE) AS vo, CAST(100 + (s_suppkey * 37) % 900 AS DOUBLE) AS pin,
        CAST(20000 + (s_suppkey * 131 % 200) * 1000 AS DOUBLE) AS f, CAST(0.1 AS DOUBLE) + CAST(s_suppkey % 15 AS DOUBLE) * CAST(0.1 AS DOUBLE) AS ripple FROM supplier),
      o AS (SELECT *, pin / vo AS io, vo / vi AS duty FROM s), d AS (SELECT *, io * ripple AS di FROM o), l AS (SELECT *, vo / (f * di) * (1 - duty) AS l0 FROM d)
      SELECT sk, round(io, 6) AS io, round(duty, 6) AS duty, round(di, 6) AS di, round(io - di / 2, 6) AS io_min, round(io + di / 2, 6) AS io_max,
        round(((io + di / 2) * (io + di / 2) + (io + di / 2) * (io - di / 2) + (io - di / 2) * (io - di / 2)) / 3, 6) AS i2_mean, round(di * di / 12, 6) AS i2_ac,
        round(round(l0 * pow(CAST(10 AS DOUBLE), 2 - floor(log10(abs(l0))))) / pow(CAST(10 AS DOUBLE), 2 - floor(log10(abs(l0)))) * 1e9, 3) AS l_nh, di < 2 * io AS ccm FROM l""",
    "h4_coss_loss": f"{_ALL} SELECT pk, round({_PC}, 6) AS p_coss, round({_QO} * 1e9, 6) AS q_oss_nc FROM j",
    "h5_hs_loss": f"{_ALL}, {_TIMES.format(src='j')}, {_HS} SELECT pk, round(tr * 1e9, 6) AS tr_ns, round(tf * 1e9, 6) AS tf_ns, {_r('p_cl', 'p_sw', 'p_coss', 'p_gd')}, round(p_cl + p_coss + p_gd + p_sw, 6) AS p_total FROM hs",
    "h6_lcsi_times": f"""{_ALL}, q AS (SELECT *, coalesce(vpl, vplf) AS vp, greatest(coalesce(rg, rg_on), rg_on) AS r, 1e-9 * 100e-9 / (qgd * qgd) AS a FROM j)
      SELECT pk, round((qgs2 / ((von - vp) / (r + 1e-9 * io_min / qgs2)) + qgd / ((-r + sqrt(r * r + 4 * a * (von - vp))) / (2 * a))) * 1e9, 5) AS tr_ns,
        round((qgs2 / ((vp - voff) / (r + 1e-9 * io_max / qgs2)) + qgd / ((-r + sqrt(r * r + 4 * a * (vp - voff))) / (2 * a))) * 1e9, 5) AS tf_ns,
        round(0.5 * vi * f * (CASE WHEN pk % 3 <> 0 THEN trr ELSE trr / 2 END * io_min + CASE WHEN pk % 3 <> 1 THEN trr / 2 ELSE trr * 1.5 END * io_max), 6) AS p_trf FROM q""",
    "h6_variants": f"""{_ALL}, q AS (SELECT *, coalesce(vpl, vplf) AS vp, greatest(coalesce(rg, rg_on), rg_on) AS r FROM j), m AS (SELECT *, (vp + vp * (qg_th / qgs)) / 2 AS vm FROM q)
      SELECT pk, round(CASE WHEN von > vp THEN qsw * r / (voff - vp) END * 1e9, 6) AS tr_const_ns, round(CASE WHEN von > vp THEN qsw * r / (vp - voff) END * 1e9, 6) AS tf_const_ns,
        round((qgs2 / (von - vm) + qgd / (von - vp)) * r * 1e9, 6) AS tr_one_ns, round((qgs2 / (vm - voff) + qgd / (vp - voff)) * r * 1e9, 6) AS tf_one_ns FROM m""",
    "h7_ls_loss": f"{_ALL}, {_LS.format(src='j')} SELECT pk, {_r('p_cl', 'p_coss', 'p_rr', 'p_gd', 'p_dt')}, round(p_cl + p_coss + p_gd + p_dt + p_rr, 6) AS p_total FROM ls",
    "h10_hs_ranking": f"""{_ALL}, {_PRE}, {_TIMES.format(src='pre')}, {_HS},
      n AS (SELECT hs.pk, mpn, k.n, id, io_max, CASE WHEN k.n = 1 THEN p_cl ELSE p_cl / k.n * 0.9 END AS p_cl, p_sw, p_coss * k.n AS p_coss, p_gd * k.n AS p_gd FROM hs CROSS JOIN (SELECT CAST(1 AS INTEGER) AS n UNION ALL SELECT CAST(2 AS INTEGER)) k)
      SELECT pk, mpn, n, {_r('p_cl', 'p_sw', 'p_coss', 'p_gd')}, round(p_cl + p_coss + p_gd + p_sw, 6) AS p_total FROM n WHERE (n = 1 OR p_cl + p_coss + p_gd + p_sw IS NOT NULL) AND {_ID.format('n')}""",
    "h12_ls_ranking": f"""{_ALL}, {_PRE}, ok AS (SELECT * FROM pre WHERE coalesce(NOT (qgd / qgs > 1), true)), {_LS.format(src='ok')},
      n AS (SELECT ls.pk, mpn, k.n, id, io_max, CASE WHEN k.n = 1 THEN p_cl ELSE p_cl / k.n * 0.9 END AS p_cl, p_rr * k.n AS p_rr, p_coss * k.n AS p_coss, p_gd * k.n AS p_gd, p_dt FROM ls CROSS JOIN (SELECT CAST(1 AS INTEGER) AS n UNION ALL SELECT CAST(2 AS INTEGER)) k)
      SELECT pk, mpn, n, {_r('p_cl', 'p_rr', 'p_coss', 'p_gd', 'p_dt')}, round(p_cl + p_coss + p_gd + p_dt + p_rr, 6) AS p_total FROM n WHERE (n = 1 OR p_cl + p_coss + p_gd + p_dt + p_rr IS NOT NULL) AND {_ID.format('n')}""",
    "h13_report": f"""{_ALL}, {_TIMES.format(src='j')}, {_HS}, {_LS.format(src='j')}
      SELECT hs.pk, round(hs.p_cl + hs.p_coss + hs.p_gd + hs.p_sw, 6) AS p_hs, round(hs.p_cl / 2 * 0.9 + 2 * hs.p_coss + 2 * hs.p_gd + hs.p_sw, 6) AS p_hs_2,
        round(ls.p_cl + ls.p_coss + ls.p_gd + ls.p_dt + ls.p_rr, 6) AS p_ls, round(ls.p_cl / 2 * 0.9 + 2 * ls.p_coss + 2 * ls.p_gd + ls.p_dt + 2 * ls.p_rr, 6) AS p_ls_2 FROM hs JOIN ls ON hs.pk = ls.pk""",
    "h11_staged_pairs": f"""{_ALL}, {_PRE}, {_TIMES.format(src='pre')}, {_HS},
      b AS (SELECT pk, id, io_max, p_cl, p_sw, p_gd, p_coss, p_sw + p_gd + p_coss AS a, p_cl + p_gd + p_coss AS c FROM hs WHERE p_cl + p_coss + p_gd + p_sw IS NOT NULL),
      s0 AS (SELECT * FROM b ORDER BY a, pk LIMIT 5000), c0 AS (SELECT * FROM b ORDER BY c, pk LIMIT 5000),
      s AS (SELECT pk AS sw, id AS sid, a, p_cl / 2 * 0.9 + p_sw + 2 * (p_gd + p_coss) AS s2 FROM s0 WHERE p_sw <= 6 * (SELECT min(p_sw) FROM s0)),
      c1 AS (SELECT pk AS cond, k.n, id AS cid, io_max, CASE WHEN k.n = 1 THEN p_cl ELSE p_cl / k.n * 0.9 END AS sh, p_sw, p_gd + p_coss AS g FROM c0 CROSS JOIN (SELECT CAST(1 AS INTEGER) AS n UNION ALL SELECT CAST(2 AS INTEGER)) k),
      p AS (SELECT sw, cond, n, a + sh + n * g AS p, s2, sh / 2 * 0.9 + p_sw + 2 * n * g AS c2 FROM s CROSS JOIN c1 WHERE coalesce(NOT (sid < 1.2 * io_max), true) AND coalesce(NOT (cid * n < 1.2 * io_max), true)),
      q AS (SELECT *, min(p) OVER () AS best, min(p) OVER (PARTITION BY sw) AS sbest FROM p)
      SELECT sw, cond, n, round(p, 6) AS p FROM q WHERE p < 2 * best AND p < 1.5 * sbest AND p < s2 AND p < c2""",
    "w3_top_losses": f"""{_ALL}, {_PRE}, {_TIMES.format(src='pre')}, {_HS}
      SELECT pk, round(p_cl + p_coss + p_gd + p_sw, 6) AS p_total FROM hs WHERE {_ID.format(1)} ORDER BY CASE WHEN p_cl + p_coss + p_gd + p_sw > 0 THEN p_cl + p_coss + p_gd + p_sw ELSE 9e9 END, pk LIMIT 5000""",
}

"""Queries of the parametric search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampmill.operators import catalogue, specs
from ampmill.session import table
from ampmill.sources.derived import DPARTS_SQL, dparts

RANGED = ["vds", "rds_on", "id", "qg", "qrr", "vpl", "coss", "rg"]
FEATURES = {k: v for k, v in catalogue.WEIGHTS.items() if k != "vgs_th"}
QUERY_PART = 42


def _rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.with_foms(specs.complete_gate_charge(dparts(spark, sf_dir)))


def f1_substrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dparts(spark, sf_dir).filter(catalogue.substrate_filter(F.col("substrate"), ["Si"])).select("pk", "substrate")


def f2_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ampmill.session import table

    return table(spark, sf_dir, "listings").filter(catalogue.package_filter(F.col("package_case"), "TO-220")).select("listing_id", "package_case")


def f3_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dparts(spark, sf_dir).filter((F.col("vds") > 1) & F.col("vds").between(60, 120)).select("pk", "vds")


def f4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dparts(spark, sf_dir).filter(catalogue.token_search("P1 brand", [F.col("mfr"), F.col("mpn"), F.col("housing")])).select("pk", "mfr")


def f10_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dparts(spark, sf_dir)
    return df.filter(catalogue.in_facet(F.col("mfr"), ["brand#11", "brand#23", "brand#34"]) & catalogue.in_facet(F.col("substrate"), ["", "SiC"])).select("pk", "mfr", "substrate")


def f11_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dparts(spark, sf_dir)
    return df.filter(catalogue.wildcard_search("p1*7 BRAND", [F.col("mpn"), F.col("mfr"), F.col("housing")])).select("pk", "mpn")


def f12_sliders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dparts(spark, sf_dir)
    c = F.col
    return df.select(
        "pk",
        catalogue.in_slider(c("vds"), 60, 120, False, False).alias("in_window"),
        catalogue.in_slider(c("vds"), -60, 150, True, True).alias("in_full"),
        catalogue.in_slider(c("rg"), 1, 3, False, True).alias("in_open"),
    )


def f19_web_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = catalogue.web_rows(dparts(spark, sf_dir))
    return df.select("pk", "substrate", F.round("vsd", 6).alias("vsd"), F.size("extras").alias("n_extras"))


def g1_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.facets(dparts(spark, sf_dir), ["mfr", "housing", "substrate"])


def g2_ranges_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dparts(spark, sf_dir)
    scaled = df.select(*[(F.col(c) * (1e12 if c in ("qg", "qrr", "coss", "rds_on") else 1)).alias(c) for c in RANGED])
    r = catalogue.slider_ranges(scaled, RANGED, RANGED[:5])
    return r.select("column", *[F.round(c, 4).alias(c) for c in ("min", "max", "slider_max")])


def g3_log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.log_stats(_rec(spark, sf_dir), list(FEATURES)).select("feature", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


def j1_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every part against one."""
    df = _rec(spark, sf_dir)
    return catalogue.most_similar(df, "pk", QUERY_PART, 2_147_483_647, FEATURES)


def j2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.most_similar(_rec(spark, sf_dir), "pk", QUERY_PART, 10, FEATURES)


def b4_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dparts(spark, sf_dir)
    return df.select("pk", *[catalogue.significant(F.col(c) * 1e9, 5).alias(f"{c}_n") for c in ("qg", "qgs", "qrr")])


def b4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the export: makers and numbers as typed, quoted where they need it."""
    p = table(spark, sf_dir, "parts")
    return p.select("part_id", catalogue.csv_line(F.col("mfr"), F.col("mpn"), F.col("housing"), F.regexp_replace(catalogue.significant(F.col("Id")).cast("string"), r"\.0$", "")).alias("line"))


def c24_si_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dparts(spark, sf_dir)
    return df.select("pk", catalogue.si_text(F.col("rds_on"), "Ω").alias("rds_on"), catalogue.si_text(F.col("id"), "A").alias("id"))


def w2_sorted_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.ui_sorted(dparts(spark, sf_dir), "rg", True).select("pk", "rg")


def g6_by_maker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected and total parts of each maker."""
    chosen = (F.col("vds") > 1) & F.col("vds").between(60, 120)
    return dparts(spark, sf_dir).groupBy("mfr").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(chosen, F.lit(False))).alias("selected"))


QUERIES = {f.__name__: f for f in (f1_substrate, f2_package, f3_voltage, f4_text, f10_facets, f11_wildcard, f12_sliders, f19_web_rows, g1_facets, g2_ranges_p99, g3_log_stats, g6_by_maker, j1_similarity, j2_nearest, b4_export, b4_lines, c24_si_text, w2_sorted_first)}

_REC = "rec AS (SELECT *, qgd + (qgs - qgs * (1 - CAST(0.55 AS DOUBLE))) AS qsw, qgd / qgs AS qgd_qgs_ratio FROM dparts)"
_SCALE = {c: (" * 1e12" if c in ("qg", "qrr", "coss", "rds_on") else "") for c in RANGED}
_LOGS = " UNION ALL ".join(f"SELECT '{f}' AS feature, CASE WHEN {f} > 0 THEN ln({f}) END AS x FROM rec" for f in FEATURES)
_STATS = f"lg AS ({_LOGS}), st AS (SELECT feature, CASE WHEN count(x) < 2 THEN CAST(0 AS DOUBLE) ELSE avg(x) END AS mu, CASE WHEN count(x) < 2 OR stddev_samp(x) = 0 THEN CAST(1 AS DOUBLE) ELSE stddev_samp(x) END AS sigma FROM lg GROUP BY feature)"
_TERM = "coalesce(CASE WHEN q.{f} > 0 AND c.{f} > 0 THEN CASE WHEN ln(c.{f}) - ln(q.{f}) < 0 THEN {u} ELSE {o} END * pow((ln(c.{f}) - ln(q.{f})) / (SELECT sigma FROM st WHERE feature = '{f}'), 2) END, 0)"
_SCORE = f"""WITH {DPARTS_SQL}, {_REC}, {_STATS}, sc AS (SELECT c.pk, CAST(round({' + '.join(_TERM.format(f=f, u=u, o=o) for f, (u, o) in FEATURES.items())}, 4) AS DOUBLE) AS score
  FROM rec c CROSS JOIN (SELECT * FROM rec WHERE pk = {QUERY_PART}) q WHERE c.pk <> {QUERY_PART} AND q.vds > 0 AND c.vds > 0 AND q.rds_on > 0 AND c.rds_on > 0) SELECT pk, score FROM sc"""
_SIG = "CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) ELSE round({x} * pow(CAST(10 AS DOUBLE), {n} - 1 - floor(log10(abs({x}))))) / pow(CAST(10 AS DOUBLE), {n} - 1 - floor(log10(abs({x})))) END"

SQL = {
    "f1_substrate": f"WITH {DPARTS_SQL} SELECT pk, substrate FROM dparts WHERE substrate IS NULL OR substrate IN ('Si')",
    "f2_package": "SELECT listing_id, package_case FROM listings WHERE package_case IS NULL OR contains(package_case, 'TO220') OR contains(package_case, 'TO-220') OR contains(package_case, 'T220')",
    "f3_voltage": f"WITH {DPARTS_SQL} SELECT pk, vds FROM dparts WHERE vds > 1 AND vds BETWEEN 60 AND 120",
    "f4_text": f"WITH {DPARTS_SQL} SELECT pk, mfr FROM dparts WHERE contains(lower(mfr || chr(10) || mpn || chr(10) || housing), 'p1') AND contains(lower(mfr || chr(10) || mpn || chr(10) || housing), 'brand')",
    "f10_facets": f"WITH {DPARTS_SQL} SELECT pk, mfr, substrate FROM dparts WHERE mfr IN ('brand#11', 'brand#23', 'brand#34') AND coalesce(substrate, '') IN ('', 'SiC')",
    "f11_wildcard": f"WITH {DPARTS_SQL} SELECT pk, mpn FROM dparts WHERE lower(mpn || ' ' || mfr || ' ' || housing) LIKE '%p1%7%' AND lower(mpn || ' ' || mfr || ' ' || housing) LIKE '%brand%'",
    "f12_sliders": f"WITH {DPARTS_SQL} SELECT pk, coalesce(vds BETWEEN 60 AND 120, false) AS in_window, coalesce(vds >= -60, true) AS in_full, coalesce(rg >= 1 - 1e-9, false) AS in_open FROM dparts",
    "f19_web_rows": f"""WITH {DPARTS_SQL} SELECT pk, CASE WHEN substrate IN ('GaN', 'SiC') THEN substrate ELSE 'Si' END AS substrate, round(abs(vsd), 6) AS vsd,
        CAST((qgs IS NOT NULL)::INT + (qgd IS NOT NULL)::INT + (trr IS NOT NULL)::INT + (coss IS NOT NULL)::INT + (rg IS NOT NULL)::INT AS INTEGER) AS n_extras FROM dparts""",
    "g1_facets": f"WITH {DPARTS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS facet, coalesce({c}, '') AS value, count(*) AS n FROM dparts GROUP BY coalesce({c}, '')" for c in ("mfr", "housing", "substrate")),
    "g2_ranges_p99": f"WITH {DPARTS_SQL}, lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c}{_SCALE[c]} AS v FROM dparts WHERE {c} IS NOT NULL" for c in RANGED)
    + f"""), rk AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY col) AS n FROM lg)
      SELECT col AS "column", round(min(v), 4) AS min, round(max(v), 4) AS max, CASE WHEN col IN ({', '.join(repr(c) for c in RANGED[:5])}) AND max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.99) AS BIGINT)) THEN v END) < max(v)
        THEN round(max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.99) AS BIGINT)) THEN v END), 4) END AS slider_max FROM rk GROUP BY col""",
    "g3_log_stats": f"WITH {DPARTS_SQL}, {_REC}, {_STATS} SELECT feature, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM st",
    "g6_by_maker": f"WITH {DPARTS_SQL} SELECT mfr, count(*) AS total, count(*) FILTER (WHERE vds > 1 AND vds BETWEEN 60 AND 120) AS selected FROM dparts GROUP BY mfr",
    "j1_similarity": _SCORE,
    "j2_nearest": _SCORE + " ORDER BY score, pk LIMIT 10",
    "b4_export": f"WITH {DPARTS_SQL} SELECT pk, {', '.join(_SIG.format(x=f'({c} * 1e9)', n=5) + f' AS {c}_n' for c in ('qg', 'qgs', 'qrr'))} FROM dparts",
    "b4_lines": "SELECT part_id, concat_ws(',', " + ", ".join(f"""CASE WHEN regexp_matches({c}, '[",\\r\\n]') THEN concat('"', replace({c}, '"', '""'), '"') ELSE coalesce({c}, '') END""" for c in ("mfr", "mpn", "housing", f"regexp_replace(CAST(CASE WHEN NOT isnan(Id) THEN {_SIG.format(x='Id', n=5)} END AS VARCHAR), '\\.0$', '')")) + ") AS line FROM parts",
    "c24_si_text": f"WITH {DPARTS_SQL} SELECT pk, " + ", ".join("CASE WHEN {c} = 0 THEN '0 {u}' ".format(c=c, u=u) + " ".join(f"WHEN abs({c}) >= {f} THEN concat(regexp_replace(CAST({_SIG.format(x=f'({c} / {f})', n=3)} AS VARCHAR), '\\.0$', ''), ' {p}{u}')" for p, f in (("M", 1e6), ("k", 1e3), ("", 1.0), ("m", 1e-3), ("µ", 1e-6), ("n", 1e-9), ("p", 1e-12))) + f" END AS {c}" for c, u in (("rds_on", "Ω"), ("id", "A"))) + " FROM dparts",
    "w2_sorted_first": f"WITH {DPARTS_SQL} SELECT pk, rg FROM dparts",
}

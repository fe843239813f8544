"""Queries over observations and part numbers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampmill.operators import observations as ob
from ampmill.operators import registries
from ampmill.session import table
from ampmill.sources import partlists
from ampmill.sources.derived import DOBS_SQL, DPARTS_SQL, dobs, dparts

KEYS = ["part", "symbol"]
SYMBOLS = ["Qg", "Qgs", "Qgd", "Rds_on", "Vsd", "Coss", "Qrr"]
FILTERS = ["Qg.typ > 20", "!Vsd.max > 60", "Rds_on.unit == mΩ", "Qgs.n >= 2", "Coss.cond.vgs <= 6", "Qrr.unit ~= /C$/"]


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations among which every repair and every reason to reject finds rows: plateau and breakdown voltages, rise times, charges without unit."""
    o, n = dobs(spark, sf_dir), F.col("ord")
    was = F.col("symbol")
    symbol = F.when((was == "Coss") & (n % 3 == 0), "Vpl").when((was == "Coss") & (n % 3 == 1), "Vds").when((was == "Rds_on") & (n % 2 == 0), "tRise").when((was == "Rds_on") & (n % 5 == 0), "Crss").otherwise(was)
    scale = F.when((was == "Qrr") & (n % 2 == 0), 1 / 60).when((was == "Coss") & (n % 3 == 1), 1 / 20).when((was == "Coss") & (n % 3 == 0), F.when(n % 2 == 0, 1.0).otherwise(0.1)).when((was == "Vsd"), 0.1).otherwise(1.0)
    lone = (was == "Rds_on") & (n % 4 == 0)
    unit = F.when(was == "Qrr", F.when(n % 4 == 0, "C").when(n % 4 == 2, None).otherwise("nC")).when(was == "Coss", F.when(n % 9 == 1, "mV/°C").otherwise("V")).otherwise(F.col("unit"))
    return o.select("part", "ord", symbol.alias("symbol"), F.when(~lone, F.col("vmin") * scale).alias("vmin"), F.when(~lone, F.col("vtyp") * scale).alias("vtyp"), (F.col("vmax") * scale).alias("vmax"), unit.alias("unit"), "cond_vgs")


def _zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in which statistics of charges are 0 here and there, some several times in a row."""
    o, n = dobs(spark, sf_dir), F.col("ord")
    z = lambda c, k, m: F.when((n % k) < m, F.when(F.col(c).isNotNull(), 0.0)).otherwise(F.col(c)).alias(c)
    return o.select("part", "ord", "symbol", z("vmin", 5, 2), z("vtyp", 3, 1), z("vmax", 7, 3), "unit", "cond_vgs")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.fold(dobs(spark, sf_dir), KEYS)


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(s, 6).alias(s) for s in ob.STATS])


def c3_field_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "extracted_rows")
    return e.select("row_id", *[F.round(ob.field_value(F.col(f"row_values.{s}")), 9).alias(s) for s in ("min", "typ", "max")])


def c4_value_with_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ob.value_with_unit(F.col("row_values.typ"))
    return table(spark, sf_dir, "extracted_rows").select("row_id", F.round(x["value"], 9).alias("value"), x["unit"].alias("unit"))


def c5_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ob.canonical_units(dobs(spark, sf_dir)), "ord", "symbol", "unit")


def c6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ob.repaired(_faulty(spark, sf_dir)), "ord", "symbol")


def c7_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ob.repaired(_faulty(spark, sf_dir))
    return r.select("ord", ob.reject_reason(r).alias("reject"))


def e2_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_fused(spark, sf_dir), *KEYS)


def e2_zero_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold where zeros of charges give way to what follows."""
    return _rounded(ob.fold(_zeros(spark, sf_dir), KEYS), *KEYS)


def d10_richest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold that begins with the richest observation."""
    return _rounded(ob.fold(ob.richest_first(dobs(spark, sf_dir)), KEYS), *KEYS)


def e8_report_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report row per part; some resistances are those at 10 V, some currents those at 25 °C."""
    o, ten = dobs(spark, sf_dir), F.col("cond_vgs") == 10
    symbol = F.when((F.col("symbol") == "Rds_on") & ten, "Rds_on_10v").when(F.col("symbol") == "Coss", F.when(ten, "ID_25").otherwise("Id")).otherwise(F.col("symbol"))
    r = ob.report_row(ob.fold(o.withColumn("symbol", symbol), KEYS), "part")
    return r.select("part", *[F.round(c, 6).alias(c) for c in r.columns if c not in ("part", "vds_max")])


def e4_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fused(spark, sf_dir)
    orders = {"typ_or": ("typ", "max", "min"), "max_or_min": ("max", "min"), "max_or_typ": ("max", "typ"), "max_min_typ": ("max", "min", "typ"), "max_typ_min": ("max", "typ", "min")}
    return f.select(*KEYS, *[F.round(ob.accessor(*o), 6).alias(name) for name, o in orders.items()])


def e5_nearest_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = dobs(spark, sf_dir)
    return _rounded(ob.nearest_condition(obs, ob.fold(obs, KEYS), KEYS, {"vgs": 10.0}), *KEYS)


def e6_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest gate voltage under which each part's charge (else gate-source charge) was measured."""
    g = dobs(spark, sf_dir).groupBy("part").agg(F.max(F.when(F.col("symbol") == "Qg", F.col("cond_vgs"))).alias("a"), F.max(F.when(F.col("symbol") == "Qgs", F.col("cond_vgs"))).alias("b"))
    return g.select("part", F.coalesce("a", "b").alias("vgs"))


def e7_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ob.wide(_fused(spark, sf_dir), "part", SYMBOLS)
    return w.select("part", *[F.round(F.col(s) * (1e9 if s[0] == "Q" else 1e12 if s == "Coss" else 1e3), 6).alias(s.lower()) for s in SYMBOLS])


def e9_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = dobs(spark, sf_dir).groupBy("part").agg(F.collect_set("symbol").alias("have"))
    return have.select("part", F.array_join(ob.needed(F.col("have"), ["Qg", ("Qgs", "Qgd"), "Vsd", "Coss"]), ",").alias("missing"))


def e13_equal_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = dobs(spark, sf_dir)
    return ob.equal_count(obs.filter("cond_vgs = 10"), ob.fold(obs.filter("cond_vgs < 10"), KEYS), KEYS)


def e14_difference_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = dobs(spark, sf_dir)
    return ob.difference_count(obs, ob.fold(obs, KEYS), KEYS)


def f8_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.parts_where(dobs(spark, sf_dir), "part", FILTERS)


def g4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.coverage(dobs(spark, sf_dir), "part").select("symbol", "parts", F.round("share", 6).alias("share"))


def g5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.corpus_summary(_fused(spark, sf_dir), "part")


def _base() -> Column:
    return F.concat(F.when(F.col("pk") % 4 == 0, "ISC").otherwise("BSC"), "mpn", F.lit("N"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers: every part's whole number with its family before it and a packing code behind it."""
    tail = F.element_at(F.array(*map(F.lit, ["", "AKMA1", "XTMA1", "SC", "-T1", "ATMA10"])), (F.col("pk") % 6 + 1).cast("int"))
    return dparts(spark, sf_dir).select("mfr", F.concat(_base(), tail).alias("mpn")).distinct()


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated entries: of the parts whose plateau voltage is known."""
    r = dparts(spark, sf_dir).filter("vpl is not null").select(F.upper("mfr").alias("mfr"), _base().alias("base"), "vpl", "rds_on", "rg", "id").distinct()
    return r.withColumn("value", F.length("base"))


def e12_gate_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate specs of every order number: a full record with nulls where the entry is silent, null throughout where there is none."""
    return registries.served(_variants(spark, sf_dir), _registry(spark, sf_dir).select("mfr", "base", F.round("vpl", 6).alias("v_plateau"), F.round("rg", 6).alias("r_gate")), ["v_plateau", "r_gate"])


def h30_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner bounds of every order number with an entry: threshold and resistance at both corners, and how far they lie from the typical value."""
    r = _registry(spark, sf_dir).select("mfr", "base", (F.col("vpl") * 0.5).alias("vgs_th_min"), (F.col("vpl") * 0.6).alias("vgs_th_typ"), F.when(F.col("id") > 50, F.col("vpl") * 0.75).alias("vgs_th_max"), F.col("rds_on").alias("rds_typ"), (F.col("rds_on") * 1.2).alias("rds_max"))
    c = registries.corners(_variants(spark, sf_dir), r)
    return c.select("mfr", "mpn", "curated", *[F.round(x, 6).alias(x) for x in ("vgs_th_shift_min", "vgs_th_shift_max", "rds_ratio_max")])


def e11_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values filled from two registries where a part has none, with those that contradict it by more than a fifth."""
    own = dparts(spark, sf_dir).select("mfr", F.concat(_base(), F.lit("")).alias("mpn"), F.when(F.col("pk") % 3 == 0, F.col("vpl")).alias("vpl"), F.when(F.col("pk") % 2 == 0, F.col("rg") * 1.3).alias("rg")).distinct()
    r = _registry(spark, sf_dir)
    one, two = r.select("mfr", "base", "vpl"), r.filter("id > 40").select("mfr", "base", F.col("rg"), (F.col("vpl") * 1.5).alias("vpl"))
    e = registries.enriched(own, {"gate": one, "extra": two}, ["vpl", "rg"])
    return e.select("mfr", "mpn", F.round("vpl", 6).alias("vpl"), F.round("rg", 6).alias("rg"), F.array_join("disagree", ",").alias("disagree"))


def e10_base_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.base_lookup(_variants(spark, sf_dir), _registry(spark, sf_dir)).select("mfr", "mpn", "base", "value")


def e11_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry values attached where a part has one, null else."""
    v = _variants(spark, sf_dir)
    return v.join(ob.base_lookup(v, _registry(spark, sf_dir)).select("mfr", "mpn", "value"), ["mfr", "mpn"], "left").withColumn("value", F.col("value").cast("double"))


def e16_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.collapse_variants(_variants(spark, sf_dir))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dparts(spark, sf_dir)
    one = p.select("mfr", "mpn", F.lit("vendor").alias("source"), F.col("pk").alias("ord"), "vds", "rds_on", "id", F.col("vpl").alias("vgs_th_max"), F.col("qg").alias("qg_typ"), F.lit(None).cast("double").alias("qg_max"), F.lit(None).cast("string").alias("package"))
    two = p.filter("pk % 3 = 0").select("mfr", F.concat("mpn", F.when(F.col("pk") % 2 == 0, "AKMA1").otherwise("")).alias("mpn"), F.when(F.col("pk") % 9 == 0, "distributor").otherwise("brand").alias("source"), (F.col("pk") + 100000000).alias("ord"), F.when(F.col("pk") % 12 == 0, -F.col("vds")).otherwise(F.col("vds")).alias("vds"), F.lit(None).cast("double").alias("rds_on"), (F.col("id") * 0.5).alias("id"), (F.col("vpl") + 1).alias("vgs_th_max"), F.col("qg").alias("qg_typ"), (F.col("qg") * 1.5).alias("qg_max"), F.col("housing").alias("package"))
    return one.unionByName(two)


def e1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ob.merge_catalogues(_sources(spark, sf_dir))
    return m.select("mfr", "base", "vds", F.round(F.col("rds_on") * 1e3, 6).alias("rds_mohm"), "id", F.round("vgs_th_max", 6).alias("vgs_th_max"), F.round(F.col("qg_typ") * 1e9, 6).alias("qg_typ_nc"), F.round(F.col("qg_max") * 1e9, 6).alias("qg_max_nc"), "package", "n_records", F.array_join("conflict", ",").alias("conflict"))


def a16_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in the order of their trust, each one's rows behind those of the one before."""
    s = _sources(spark, sf_dir)
    u = partlists.all_sources(*[s.filter(F.col("source") == name) for name in ("vendor", "brand", "distributor")])
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mpn").alias("numbers"), F.min(F.shiftright("ord", 55)).alias("place"), F.max(F.shiftright("ord", 55)).alias("last_place"))


def a20_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir).select("mfr", "mpn", "ord", "id")
    return ob.upsert(s.filter("ord < 100000000"), s.filter("ord >= 100000000"), ["mfr", "mpn"], "ord")


def w6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units filled down the rows of each page and symbol."""
    e = table(spark, sf_dir, "extracted_rows").select("row_id", "mpn", "page_num", "symbol", "unit")
    return ob.filled_down(e, ["mpn", "page_num", "symbol"], "row_id", "unit").select("row_id", "unit_filled")


def w8_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text line with the twelve lines that begin with it, within its part and page."""
    from pyspark.sql import Window

    w = Window.partitionBy("mpn", "page_num").orderBy("text_row_id").rowsBetween(0, 11)
    t = table(spark, sf_dir, "text_rows")
    return t.select("text_row_id", F.size(F.collect_list("text_row_id").over(w)).alias("n_lines"), F.sum("n_words").over(w).alias("words"))


def w9_last_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each order number, rows loaded twice being one."""
    p = table(spark, sf_dir, "parts")
    return p.groupBy("mpn").agg(F.max_by("part_id", F.struct("loaded_at", "part_id")).alias("part_id"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (a16_union, a20_upsert, c3_field_value, c4_value_with_unit, c5_units, c6_repair, c7_rejects, e1_merge, e2_fold, e2_zero_charges, d10_richest_first, e8_report_row, e12_gate_specs, h30_corners, e11_registries, e4_accessors, e5_nearest_condition, e6_conditions, e7_wide, e9_needed, e10_base_lookup, e11_enrich, e13_equal_count, e14_difference_count, e16_collapse, f8_predicates, g4_coverage, g5_summary, w6_fill, w8_context, w9_last_loaded)}

_NZ = "symbol IN ('Qg', 'Qgs', 'Qgd')"
def _stat(s: str, lower: str) -> str:
    """The folded statistic s after a row r, given the bound under it."""
    return f"CASE WHEN (s.{s} IS NULL AND r.{s} >= {lower}) OR (s.z AND s.{s} = 0) THEN r.{s} ELSE s.{s} END"


_N = _stat("n", "s.b")
_T = _stat("t", f"coalesce({_N}, s.b)")
_X = _stat("x", f"coalesce({_T}, {_N}, s.b)")
_FOLD = f"""l AS (SELECT part, symbol, CASE WHEN {_NZ} THEN CAST(0 AS DOUBLE) ELSE CAST('-infinity' AS DOUBLE) END AS base, list({{{{'n': vmin, 't': vtyp, 'x': vmax}}}} ORDER BY {{order}}) AS a FROM {{src}} GROUP BY part, symbol),
  f AS (SELECT part, symbol, list_reduce(list_transform(a, lambda r: {{{{'n': r.n, 't': r.t, 'x': r.x, 'b': base, 'z': base = 0}}}}), lambda s, r: {{{{'n': {_N}, 't': {_T}, 'x': {_X}, 'b': s.b, 'z': s.z}}}}) AS r FROM l),
  fu AS (SELECT part, symbol, r.n AS vmin, r.t AS vtyp, r.x AS vmax FROM f)"""


def _folded(src: str, order: str = "ord") -> str:
    return _FOLD.format(src=src, order=order)


_F = f"WITH {DOBS_SQL}, {_folded('dobs')}"
FOLDED_SQL = _F
_MUL = "CASE WHEN unit IN ('uC', 'μC', 'µC', 'uc') THEN 1e3 WHEN unit = 'nF' THEN 1e3 WHEN unit IN ('uF', 'μF', 'µF') THEN 1e6 WHEN symbol LIKE 'R%' AND unit IN ('W', 'Ω') THEN 1e3 ELSE 1 END"
_FAULTY = """fy AS (SELECT part, ord, CASE WHEN symbol = 'Coss' AND ord % 3 = 0 THEN 'Vpl' WHEN symbol = 'Coss' AND ord % 3 = 1 THEN 'Vds' WHEN symbol = 'Rds_on' AND ord % 2 = 0 THEN 'tRise' WHEN symbol = 'Rds_on' AND ord % 5 = 0 THEN 'Crss' ELSE symbol END AS symbol,
    CASE WHEN symbol = 'Qrr' AND ord % 2 = 0 THEN 1::DOUBLE / 60 WHEN symbol = 'Coss' AND ord % 3 = 1 THEN 1::DOUBLE / 20 WHEN symbol = 'Coss' AND ord % 3 = 0 THEN CASE WHEN ord % 2 = 0 THEN 1::DOUBLE ELSE 0.1::DOUBLE END WHEN symbol = 'Vsd' THEN 0.1::DOUBLE ELSE 1::DOUBLE END AS k,
    symbol = 'Rds_on' AND ord % 4 = 0 AS lone, CASE WHEN symbol = 'Qrr' THEN CASE ord % 4 WHEN 0 THEN 'C' WHEN 2 THEN NULL ELSE 'nC' END WHEN symbol = 'Coss' THEN CASE WHEN ord % 9 = 1 THEN 'mV/°C' ELSE 'V' END ELSE unit END AS unit, vmin, vtyp, vmax FROM dobs),
  r0 AS (SELECT part, ord, symbol, unit, CASE WHEN NOT lone THEN vmin * k END AS vmin, CASE WHEN NOT lone THEN vtyp * k END AS vtyp, vmax * k AS vmax FROM fy)"""
_SH = "(substr(symbol, 1, 1) IN ('Q', 't') OR symbol IN ('Vsd', 'Coss')) AND vmax IS NULL AND vmin IS NOT NULL"
_MICRO = "symbol = 'Qrr' AND lower(coalesce(unit, '')) IN ('', 'c') AND coalesce(vmin > 0.1 AND vmin < 0.9, true) AND coalesce(vtyp > 0.1 AND vtyp < 0.9, true) AND coalesce(vmax > 0.1 AND vmax < 0.9, true)"
_LONE = "symbol IN ('Qgd', 'Qgs', 'Qg', 'tRise', 'tFall') AND vmax IS NOT NULL AND vmin IS NULL AND vtyp IS NULL"
_SWAP = "symbol = 'Vsd' AND vmax < vtyp AND vtyp / nullif(vmax, 0) < 1.5"
_REP = f"""{_FAULTY}, r1 AS (SELECT ord, part, symbol, unit, CASE WHEN {_SH} THEN NULL ELSE vmin END AS vmin, CASE WHEN {_SH} THEN vmin ELSE vtyp END AS vtyp, CASE WHEN {_SH} AND vtyp IS NOT NULL THEN vtyp ELSE vmax END AS vmax FROM r0),
  ra AS (SELECT ord, part, symbol, unit, vmin, CASE WHEN symbol = 'Vpl' AND vtyp > 30 AND vtyp < 60 THEN vtyp / 10 ELSE vtyp END AS vtyp, vmax FROM r1),
  rb AS (SELECT ord, part, symbol, unit, {', '.join(f"CASE WHEN symbol = 'Vds' AND abs({c}) < 1 THEN NULL ELSE {c} END AS {c}" for c in ob.STATS)} FROM ra),
  rc AS (SELECT ord, part, symbol, unit, {', '.join(f"CASE WHEN {_MICRO} THEN {c} * 1e3 ELSE {c} END AS {c}" for c in ob.STATS)} FROM rb),
  r2 AS (SELECT ord, part, symbol, unit, vmin, CASE WHEN {_LONE} THEN vmax ELSE vtyp END AS vtyp, CASE WHEN {_LONE} THEN NULL ELSE vmax END AS vmax FROM rc),
  r3 AS (SELECT ord, part, symbol, unit, vmin, CASE WHEN {_SWAP} THEN vmax ELSE vtyp END AS vtyp, CASE WHEN {_SWAP} THEN vtyp ELSE vmax END AS vmax FROM r2)"""
_BASE = "concat(CASE WHEN pk % 4 = 0 THEN 'ISC' ELSE 'BSC' END, mpn, 'N')"
_TAIL = "CASE pk % 6 WHEN 0 THEN '' WHEN 1 THEN 'AKMA1' WHEN 2 THEN 'XTMA1' WHEN 3 THEN 'SC' WHEN 4 THEN '-T1' ELSE 'ATMA10' END"
_VAR = f"va AS (SELECT DISTINCT mfr, concat({_BASE}, {_TAIL}) AS mpn FROM dparts), re AS (SELECT DISTINCT mfr, {_BASE} AS base, CAST(length({_BASE}) AS INTEGER) AS value, vpl, rds_on, rg, id FROM dparts WHERE vpl IS NOT NULL)"
_LOOK = f"""WITH {DPARTS_SQL}, {_VAR}, jo AS (SELECT va.mfr, va.mpn, base, value, vpl, rds_on, rg, id, substr(mpn, length(base) + 1) AS rest FROM va JOIN re ON va.mfr = re.mfr AND starts_with(mpn, base)),
  ok AS (SELECT *, row_number() OVER (PARTITION BY mfr, mpn ORDER BY length(base) DESC) AS rn FROM jo WHERE rest = '' OR regexp_full_match(rest, '[A-Z]{{2,5}}[0-9]') OR (substr(base, 1, 3) IN ('IQD', 'IQE', 'ISC') AND regexp_full_match(rest, '(CG|SC|CGSC)([A-Z]{{2,5}}[0-9])?')))"""
_SRC = f"""WITH {DPARTS_SQL}, src AS (SELECT mfr, mpn, 'vendor' AS source, pk AS ord, vds, rds_on, id, vpl AS vgs_th_max, qg AS qg_typ, CAST(NULL AS DOUBLE) AS qg_max, CAST(NULL AS VARCHAR) AS package FROM dparts UNION ALL
  SELECT mfr, concat(mpn, CASE WHEN pk % 2 = 0 THEN 'AKMA1' ELSE '' END), CASE WHEN pk % 9 = 0 THEN 'distributor' ELSE 'brand' END, pk + 100000000, CASE WHEN pk % 12 = 0 THEN -vds ELSE vds END, NULL, id * 0.5, vpl + 1, qg, qg * 1.5, housing FROM dparts WHERE pk % 3 = 0)"""
_VAL = "coalesce(vtyp, vmax, vmin)"
_WITH_UNIT = r"^\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s+([a-zA-ZµμΩ°][a-zA-ZµμΩ°/]*)\s*$"


def field_value_sql(c: str) -> str:
    """The SQL of observations.field_value."""
    a = f"regexp_replace(regexp_replace(trim({c}), '[L.]+$', ''), '[‐-―−]', '-', 'g')"
    b = f"trim(regexp_replace({a}, '^\\+- ', ''))"
    d = f"CASE WHEN regexp_matches({b}, '^[^,.]*[0-9],[0-9]{{3}}(\\.[^,]*)?$') THEN replace({b}, ',', '') ELSE {b} END"
    missing = ", ".join("'" + m.replace("'", "''") + "'" for m in ob.MISSING)
    return f"CASE WHEN {b} IN ({missing}) OR regexp_full_match({b}, '[-~]*') OR starts_with({b}, '+-') THEN NULL ELSE try_cast({d} AS DOUBLE) END"

SQL = {
    "c5_units": f"WITH {DOBS_SQL} SELECT ord, symbol, CASE WHEN unit IN ('uC', 'μC', 'µC', 'uc') THEN 'nC' WHEN unit IN ('nF', 'uF', 'μF', 'µF') THEN 'pF' WHEN symbol LIKE 'R%' AND unit IN ('mW', 'W', 'Ω') THEN 'mΩ' ELSE unit END AS unit, round(vmin * {_MUL}, 6) AS vmin, round(vtyp * {_MUL}, 6) AS vtyp, round(vmax * {_MUL}, 6) AS vmax FROM dobs",
    "c6_repair": f"WITH {DOBS_SQL}, {_REP} SELECT ord, symbol, round(vmin, 6) AS vmin, round(vtyp, 6) AS vtyp, round(vmax, 6) AS vmax FROM r3",
    "c7_rejects": f"""WITH {DOBS_SQL}, {_REP} SELECT ord, CASE WHEN symbol = 'Vds' AND regexp_matches(unit, '/°C|mV') THEN 'unit' WHEN vmax IS NOT NULL AND vtyp IS NOT NULL AND NOT coalesce(vmax / nullif(vtyp, 0) > 1 AND vmax / nullif(vtyp, 0) < CASE WHEN symbol = 'Crss' THEN 30 ELSE 5 END, false) THEN 'ratio' WHEN {_VAL} IS NULL THEN 'empty'
      WHEN symbol = 'Vpl' AND NOT ({_VAL} > 1 AND {_VAL} < 10) THEN 'range' WHEN symbol = 'Vsd' AND NOT (abs({_VAL}) > 0.1 AND abs({_VAL}) < 6) THEN 'range' END AS reject FROM r3""",
    "c3_field_value": f"SELECT row_id, {', '.join(f'round({field_value_sql(f'row_values.{c}')}, 9) AS {c}' for c in ('min', 'typ', 'max'))} FROM extracted_rows",
    "c4_value_with_unit": f"SELECT row_id, round(try_cast(nullif(regexp_extract(row_values.typ, '{_WITH_UNIT}', 1), '') AS DOUBLE), 9) AS value, nullif(regexp_extract(row_values.typ, '{_WITH_UNIT}', 2), '') AS unit FROM extracted_rows",
    "e2_zero_charges": f"""WITH {DOBS_SQL}, zo AS (SELECT part, ord, symbol, CASE WHEN ord % 5 < 2 AND vmin IS NOT NULL THEN 0 ELSE vmin END AS vmin, CASE WHEN ord % 3 < 1 AND vtyp IS NOT NULL THEN 0 ELSE vtyp END AS vtyp, CASE WHEN ord % 7 < 3 AND vmax IS NOT NULL THEN 0 ELSE vmax END AS vmax FROM dobs), {_folded('zo')}
      SELECT part, symbol, round(vmin, 6) AS vmin, round(vtyp, 6) AS vtyp, round(vmax, 6) AS vmax FROM fu""",
    "d10_richest_first": f"WITH {DOBS_SQL}, {_folded('dobs', 'CASE WHEN vmin IS NULL THEN 1 ELSE 0 END + CASE WHEN vtyp IS NULL THEN 1 ELSE 0 END + CASE WHEN vmax IS NULL THEN 1 ELSE 0 END, ord')} SELECT part, symbol, round(vmin, 6) AS vmin, round(vtyp, 6) AS vtyp, round(vmax, 6) AS vmax FROM fu",
    "e8_report_row": f"""WITH {DOBS_SQL}, rn AS (SELECT * REPLACE (CASE WHEN symbol = 'Rds_on' AND cond_vgs = 10 THEN 'Rds_on_10v' WHEN symbol = 'Coss' THEN CASE WHEN cond_vgs = 10 THEN 'ID_25' ELSE 'Id' END ELSE symbol END AS symbol) FROM dobs), {_folded('rn')}
      SELECT part, round(coalesce(max(CASE WHEN symbol = 'Rds_on_10v' THEN vmax END), max(CASE WHEN symbol = 'Rds_on' THEN vmax END)), 6) AS rds_max, round(coalesce(max(CASE WHEN symbol = 'ID_25' THEN {_VAL} END), max(CASE WHEN symbol = 'Id' THEN {_VAL} END)), 6) AS id, round(max(CASE WHEN symbol = 'Qg' THEN vmax END), 6) AS qg_max,
        {', '.join(f"round(max(CASE WHEN symbol = '{s}' THEN {_VAL} END), 6) AS {s.lower()}" for s in ('Qgs', 'Qgd', 'Vsd'))}, round(max(CASE WHEN symbol = 'Qrr' THEN vtyp END), 6) AS qrr_typ, round(max(CASE WHEN symbol = 'Qrr' THEN vmax END), 6) AS qrr_max FROM fu GROUP BY part""",
    "e12_gate_specs": f"{_LOOK} SELECT va.mfr, va.mpn, o.base IS NOT NULL AS curated, round(o.vpl, 6) AS v_plateau, round(o.rg, 6) AS r_gate FROM va LEFT JOIN (SELECT * FROM ok WHERE rn = 1) o ON va.mfr = o.mfr AND va.mpn = o.mpn",
    "h30_corners": f"""{_LOOK} SELECT va.mfr, va.mpn, o.base IS NOT NULL AS curated, round(o.vpl * 0.5 - o.vpl * 0.6, 6) AS vgs_th_shift_min, round(CASE WHEN id > 50 THEN o.vpl * 0.75 END - o.vpl * 0.6, 6) AS vgs_th_shift_max, round(o.rds_on * 1.2 / o.rds_on, 6) AS rds_ratio_max FROM va LEFT JOIN (SELECT * FROM ok WHERE rn = 1) o ON va.mfr = o.mfr AND va.mpn = o.mpn""",
    "e11_registries": f"""WITH {DPARTS_SQL}, ow AS (SELECT DISTINCT mfr, {_BASE} AS mpn, CASE WHEN pk % 3 = 0 THEN vpl END AS v, CASE WHEN pk % 2 = 0 THEN rg * 1.3 END AS g, CASE WHEN vpl IS NOT NULL THEN vpl END AS v1, CASE WHEN vpl IS NOT NULL AND id > 40 THEN vpl * 1.5 END AS v2, CASE WHEN vpl IS NOT NULL AND id > 40 THEN rg END AS g2 FROM dparts)
      SELECT mfr, mpn, round(coalesce(v, v1, v2), 6) AS vpl, round(coalesce(g, g2), 6) AS rg, concat_ws(',', CASE WHEN abs(v - v1) / abs(v) > 0.2 THEN 'gate.vpl' END, CASE WHEN abs(v - v2) / abs(v) > 0.2 THEN 'extra.vpl' END, CASE WHEN abs(g - g2) / abs(g) > 0.2 THEN 'extra.rg' END) AS disagree FROM ow""",
    "e2_fold": f"{_F} SELECT part, symbol, round(vmin, 6) AS vmin, round(vtyp, 6) AS vtyp, round(vmax, 6) AS vmax FROM fu",
    "e4_accessors": f"{_F} SELECT part, symbol, round({_VAL}, 6) AS typ_or, round(coalesce(vmax, vmin), 6) AS max_or_min, round(coalesce(vmax, vtyp), 6) AS max_or_typ, round(coalesce(vmax, vmin, vtyp), 6) AS max_min_typ, round(coalesce(vmax, vtyp, vmin), 6) AS max_typ_min FROM fu",
    "e5_nearest_condition": f"""{_F}, er AS (SELECT *, sqrt(pow((cond_vgs - 10) / (10 + 1e-3), 2)) AS e FROM dobs), bo AS (SELECT *, row_number() OVER (PARTITION BY part, symbol ORDER BY e, ord) AS rn FROM er),
      m AS (SELECT fu.part, fu.symbol, (coalesce(fu.vtyp, fu.vmax, fu.vmin) IS NULL OR b.e < 0.1) AS take, fu.vmin AS fn, fu.vtyp AS ft, fu.vmax AS fx, b.vmin AS bn, b.vtyp AS bt, b.vmax AS bx FROM fu JOIN bo b ON fu.part = b.part AND fu.symbol = b.symbol AND b.rn = 1)
      SELECT part, symbol, round(CASE WHEN take THEN bn ELSE fn END, 6) AS vmin, round(CASE WHEN take THEN bt ELSE ft END, 6) AS vtyp, round(CASE WHEN take THEN bx ELSE fx END, 6) AS vmax FROM m""",
    "e6_conditions": f"WITH {DOBS_SQL} SELECT part, coalesce(max(CASE WHEN symbol = 'Qg' THEN cond_vgs END), max(CASE WHEN symbol = 'Qgs' THEN cond_vgs END)) AS vgs FROM dobs GROUP BY part",
    "e7_wide": f"{_F} SELECT part, " + ", ".join(f"round(max(CASE WHEN symbol = '{s}' THEN {'coalesce(vmax, vtyp)' if s == 'Rds_on' else _VAL}{' * 1e3' if s == 'Vsd' else ''} END), 6) AS {s.lower()}" for s in SYMBOLS) + " FROM fu GROUP BY part",
    "e9_needed": f"""WITH {DOBS_SQL} SELECT part, concat_ws(',', CASE WHEN NOT bool_or(symbol = 'Qg') THEN 'Qg' END, CASE WHEN NOT bool_or(symbol IN ('Qgs', 'Qgd')) THEN 'Qgs|Qgd' END, CASE WHEN NOT bool_or(symbol = 'Vsd') THEN 'Vsd' END, CASE WHEN NOT bool_or(symbol = 'Coss') THEN 'Coss' END) AS missing FROM dobs GROUP BY part""",
    "e10_base_lookup": f"{_LOOK} SELECT mfr, mpn, base, value FROM ok WHERE rn = 1",
    "e11_enrich": f"{_LOOK} SELECT va.mfr, va.mpn, CAST(o.value AS DOUBLE) AS value FROM va LEFT JOIN (SELECT * FROM ok WHERE rn = 1) o ON va.mfr = o.mfr AND va.mpn = o.mpn",
    "e13_equal_count": f"WITH {DOBS_SQL}, lo AS (SELECT * FROM dobs WHERE cond_vgs < 10), {_folded('lo')}, er AS (SELECT d.part, d.symbol, min(abs(fu.vmin - d.vmin) / abs(d.vmin)) AS a, min(abs(fu.vtyp - d.vtyp) / abs(d.vtyp)) AS b, min(abs(fu.vmax - d.vmax) / abs(d.vmax)) AS c FROM dobs d JOIN fu ON d.part = fu.part AND d.symbol = fu.symbol WHERE cond_vgs = 10 GROUP BY d.part, d.symbol) SELECT part, CAST(sum(CASE WHEN a < 0.05 THEN 1 ELSE 0 END + CASE WHEN b < 0.05 THEN 1 ELSE 0 END + CASE WHEN c < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_equal FROM er GROUP BY part",
    "e14_difference_count": f"{_F}, er AS (SELECT d.part, greatest(" + ", ".join(f"CASE WHEN d.{s} IS NOT NULL AND fu.{s} IS NULL THEN 1 ELSE coalesce(abs(fu.{s} - d.{s}) / abs(d.{s}), 0) END" for s in ob.STATS) + ") AS w FROM dobs d LEFT JOIN fu ON d.part = fu.part AND d.symbol = fu.symbol) SELECT part, CAST(sum(CASE WHEN w >= 0.001 THEN 1 ELSE 0 END) AS BIGINT) AS n_different FROM er GROUP BY part",
    "e16_collapse": f"WITH {DPARTS_SQL}, {_VAR} SELECT mfr, mpn FROM va a WHERE NOT EXISTS (SELECT 1 FROM va b WHERE a.mfr = b.mfr AND a.mpn <> b.mpn AND starts_with(a.mpn, b.mpn))",
    "e1_merge": _SRC + """, k AS (SELECT *, regexp_replace(mpn, '(AKMA1|AKSA1|XKSA1|XKMA1)$', '') AS base FROM src), o AS (SELECT *, min(ord) OVER (PARTITION BY mfr, base) AS o0 FROM k), u AS (SELECT * FROM o WHERE source <> 'distributor' OR ord = o0)
      SELECT mfr, base, CASE WHEN min(vds) < 0 AND max(vds) > 0 THEN min(vds) ELSE arg_min(vds, ord) FILTER (WHERE vds IS NOT NULL) END AS vds, round(arg_min(rds_on, ord) FILTER (WHERE rds_on IS NOT NULL) * 1e3, 6) AS rds_mohm, min(id) AS id, round(max(vgs_th_max), 6) AS vgs_th_max,
        round(avg(qg_typ) * 1e9, 6) AS qg_typ_nc, round(max(qg_max) * 1e9, 6) AS qg_max_nc, arg_min(package, ord) FILTER (WHERE package IS NOT NULL) AS package, count(*) AS n_records,
        concat_ws(',', CASE WHEN stddev_pop(rds_on) / abs(avg(rds_on)) > 0.45 THEN 'rds_on' END, CASE WHEN stddev_pop(id) / abs(avg(id)) > 0.45 THEN 'id' END, CASE WHEN stddev_pop(vgs_th_max) / abs(avg(vgs_th_max)) > 0.3 THEN 'vgs_th_max' END,
          CASE WHEN stddev_pop(qg_typ) / abs(avg(qg_typ)) > 0.01 THEN 'qg_typ' END, CASE WHEN stddev_pop(qg_max) / abs(avg(qg_max)) > 0.2 THEN 'qg_max' END, CASE WHEN max(abs(vds)) > min(abs(vds)) THEN 'vds' END) AS conflict FROM u GROUP BY mfr, base""",
    "a16_union": _SRC + " SELECT source, count(*) AS n, count(DISTINCT mpn) AS numbers, CASE source WHEN 'vendor' THEN 0 WHEN 'brand' THEN 1 ELSE 2 END AS place, CASE source WHEN 'vendor' THEN 0 WHEN 'brand' THEN 1 ELSE 2 END AS last_place FROM src GROUP BY source",
    "a20_upsert": _SRC + " SELECT mfr, mpn, ord, id FROM (SELECT *, row_number() OVER (PARTITION BY mfr, mpn ORDER BY ord DESC) AS rn FROM src) WHERE rn = 1",
    "f8_predicates": f"""WITH {DOBS_SQL} SELECT part FROM dobs GROUP BY part HAVING bool_or(symbol = 'Qg' AND coalesce(vtyp > 20, false)) AND NOT bool_or(symbol = 'Vsd' AND coalesce(vmax > 60, false)) AND bool_or(symbol = 'Rds_on' AND unit = 'mΩ')
      AND count(*) FILTER (WHERE symbol = 'Qgs') >= 2 AND bool_or(symbol = 'Coss' AND cond_vgs <= 6) AND bool_or(symbol = 'Qrr' AND unit LIKE '%C')""",
    "g4_coverage": f"WITH {DOBS_SQL} SELECT symbol, count(DISTINCT part) AS parts, round(CAST(count(DISTINCT part) AS DOUBLE) / (SELECT count(DISTINCT part) FROM dobs), 6) AS share FROM dobs GROUP BY symbol",
    "g5_summary": f"{_F} SELECT count(DISTINCT part) AS parts, count(*) AS fields, CAST(count(vmin) + count(vtyp) + count(vmax) AS BIGINT) AS present_values FROM fu",
    "w6_fill": "SELECT row_id, last_value(unit IGNORE NULLS) OVER (PARTITION BY mpn, page_num, symbol ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit_filled FROM extracted_rows",
    "w8_context": "SELECT text_row_id, CAST(count(*) OVER w AS INTEGER) AS n_lines, CAST(sum(n_words) OVER w AS BIGINT) AS words FROM text_rows WINDOW w AS (PARTITION BY mpn, page_num ORDER BY text_row_id ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)",
    "w9_last_loaded": "SELECT mpn, arg_max(part_id, CAST(epoch_us(loaded_at) AS DOUBLE) * 1e3 + part_id) AS part_id, count(*) AS n FROM parts GROUP BY mpn",
}

"""Queries of the text rules, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampmill.operators import text as tx
from ampmill.plans.observed import field_value_sql
from ampmill.session import table


def c1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.normalize_text(table(spark, sf_dir, "text_rows"), "text_row_id", "text")


def c9_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    e = table(spark, sf_dir, "extracted_rows").select("row_id", tx.condition_map(F.col("cond")).alias("m"))
    return e.select("row_id", F.try_element_at(m, F.lit("Vds")).alias("vds"), F.try_element_at(m, F.lit("Vgs")).alias("vgs"), F.try_element_at(m, F.lit("Id")).alias("id"), F.try_element_at(m, F.lit("di/dt")).alias("didt"), F.try_element_at(m, F.lit("I")).alias("i"))


def c9_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conditions out of maps: one assignment under each position, or name and value apart."""
    pieces = F.split("cond", ", ")
    numbered = F.map_from_entries(F.transform(pieces, lambda p, i: F.struct(i.cast("string").alias("key"), p.alias("value"))))
    m = tx.condition_map(tx.condition_text(F.when(F.length("cond") > 0, numbered)))
    return table(spark, sf_dir, "extracted_rows").select("row_id", *[F.try_element_at(m, F.lit(k)).alias(n) for k, n in (("Vds", "vds"), ("Vgs", "vgs"), ("Id", "id"), ("I", "i"))])


def c10_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "extracted_rows").select("row_id", F.round(tx.scaled_assignment(F.col("cond"), "ID"), 9).alias("id_a"))


def c12_maker_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parts").select("part_id", tx.maker_tag(F.col("mfr")).alias("tag"))


def c13_housing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parts").select("part_id", tx.housing_family(F.col("housing")).alias("family"))


def c11_ensured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate charges in nC and resistances in Ω of the offers, as far as they are in range."""
    head = lambda c: F.trim(F.regexp_extract(c, "^([^@]*)", 1))
    return table(spark, sf_dir, "listings").select("listing_id", F.round(tx.ensured_charge(head("gate_charge"), 0.1, 500.0, True), 6).alias("qg_nc"), F.round(tx.ensured_resistance(head("rds_on"), 1e-4, 5.0), 9).alias("rds_ohm"))


def c14_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in the documents' texts: how many, and the first."""
    d = table(spark, sf_dir, "documents").select("doc_id", tx.dates_in(F.col("text")).alias("d"))
    return d.select("doc_id", F.try_element_at("d", F.lit(1)).cast("string").alias("first_date"), F.coalesce(F.size("d"), F.lit(0)).alias("n"))


def c25_sheet_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "listings").select("listing_id", tx.sheet_path(F.col("mfr"), F.col("mfr_part")).alias("path"))


def c16_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.mentions_part(F.col("text"), F.col("mpn")).alias("ok"))


def c17_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "text_rows")
    return t.select("text_row_id", tx.detect_symbol(F.col("text")).alias("symbol"))


def c18_row_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "extracted_rows")
    row = F.concat_ws(",", "symbol", *[F.coalesce(F.col(f"row_values.{s}"), F.lit("")) for s in ("min", "typ", "max")], F.coalesce("unit", F.lit("")))
    v = tx.row_values(row)
    return e.select("row_id", v["vmin"].alias("vmin"), v["vtyp"].alias("vtyp"), v["vmax"].alias("vmax"), v["unit"].alias("unit"))


def f9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parts").filter(F.contains(F.lower("mfr"), F.lit("semi")) & F.contains(F.lower("mpn"), F.lit("n10"))).select("part_id", "mfr", "mpn")


def f9_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts the substring filters leave, and the first twenty by maker and number."""
    hits = f9_substring(spark, sf_dir)
    first = hits.orderBy("mfr", "mpn", "part_id").limit(20)
    return first.crossJoin(F.broadcast(hits.agg(F.count(F.lit(1)).alias("n"))))


QUERIES = {f.__name__: f for f in (c11_ensured, c25_sheet_path, f9_count, c1_normalized, c9_conditions, c9_structured, c10_scaled, c12_maker_tag, c13_housing, c14_dates, c16_mentions, c17_symbols, c18_row_values, f9_substring)}

_COND = lambda names: f"try_cast(nullif(regexp_extract(cond, '(?i)(?:^|[,; ])(?:{names})\\s*=\\s*([-+]?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE)"
_SCALED = r"(?i)\bID\s*=\s*([-+]?[0-9.]+)\s*([mµμunkM]?)(?-i:[VAWΩFHsC]|Hz|Ohm)?"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_MONTH_NO = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(left({}, 3)))"


def _date_shape(pattern: str, y: int, m: str, d: str, rest: str = "") -> str:
    part = lambda i: f"regexp_extract(w, '{pattern}', {i})"
    return f"SELECT doc_id, text, w, CAST({part(y)} AS INTEGER) AS y, {m.format(*map(part, range(1, 4)))} AS m, {d.format(*map(part, range(1, 4)))} AS d FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{pattern}')) AS w FROM documents) {rest}"


_DATES = " UNION ALL ".join(
    [
        _date_shape(rf"(?i)\b(\d{{1,2}})[- ]({_MONTH})[- ](\d{{4}}|\d{{2}})\b", 3, _MONTH_NO.format("{1}"), "CAST({0} AS INTEGER)"),
        _date_shape(rf"(?i)\b({_MONTH})\.? (\d{{1,2}}), ?(\d{{4}})\b", 3, _MONTH_NO.format("{0}"), "CAST({1} AS INTEGER)"),
        _date_shape(rf"(?i)\b({_MONTH})\.? ?(20\d{{2}})\b", 2, _MONTH_NO.format("{0}"), "1"),
        _date_shape(r"\b(20\d{2})[-.](\d{1,2})[-.](\d{1,2})\b", 1, "CAST({1} AS INTEGER)", "CAST({2} AS INTEGER)"),
        _date_shape(r"\b(20\d{2})-(\d{2})\b(?:[-.]\d)?", 1, "CAST({1} AS INTEGER)", "1", r"WHERE NOT regexp_matches(w, '-\d{2}[-.]\d$')"),
    ]
)


def _row_values_sql() -> str:
    """The SQL of text.row_values: the three shapes of a table row in their order."""
    cell, unit = r"\s*([-+]?\d+(?:\.\d+)?|-{1,3}|~|)\s*", r"\s*([munpkµμ]?(?:Ω|Ohm|V|A|C|F|s|W|°C)|mOhm)\s*"
    tries = []
    for pattern, (a, b, c, u) in ((rf",{cell},{cell},{cell},{unit}(?:,|$)", (1, 2, 3, 4)), (rf",{cell},{cell},{unit}(?:,|$)", (None, 1, 2, 3)), (rf",{cell},{unit}(?:,|$)", (None, 1, None, 2))):
        get = lambda i, p=pattern: "CAST(NULL AS DOUBLE)" if i is None else field_value_sql(f"regexp_extract(r, '{p}', {i})")
        tries.append(f"WHEN regexp_matches(r, '{pattern}') AND coalesce({get(a)}, {get(b)}, {get(c)}) IS NOT NULL THEN {{'vmin': {get(a)}, 'vtyp': {get(b)}, 'vmax': {get(c)}, 'unit': regexp_extract(r, '{pattern}', {u})}}")
    return f"WITH w AS (SELECT row_id, concat_ws(',', symbol, coalesce(row_values.min, ''), coalesce(row_values.typ, ''), coalesce(row_values.max, ''), coalesce(unit, '')) AS r FROM extracted_rows), v AS (SELECT row_id, CASE {' '.join(tries)} END AS v FROM w) SELECT row_id, v.vmin AS vmin, v.vtyp AS vtyp, v.vmax AS vmax, v.unit AS unit FROM v"


SQL = {
    "c9_conditions": f"SELECT row_id, {_COND('VDS|VDD|VR')} AS vds, {_COND('VGS')} AS vgs, {_COND('ID')} AS id, {_COND('di/dt')} AS didt, {_COND('IF|IS')} AS i FROM extracted_rows",
    "c9_structured": f"SELECT row_id, {_COND('VDS|VDD|VR')} AS vds, {_COND('VGS')} AS vgs, {_COND('ID')} AS id, {_COND('IF|IS')} AS i FROM extracted_rows",
    "c12_maker_tag": "SELECT part_id, CASE " + " ".join("WHEN starts_with(lower(mfr), '{}') THEN '{}'".format(s, t) for t, s in tx.MAKER_TAGS) + " ELSE replace(lower(mfr), ' ', '_') END AS tag FROM parts",
    "c10_scaled": f"SELECT row_id, round(try_cast(nullif(regexp_extract(cond, '{_SCALED}', 1), '') AS DOUBLE) * CASE regexp_extract(cond, '{_SCALED}', 2) WHEN 'm' THEN 1e-3 WHEN 'µ' THEN 1e-6 WHEN 'μ' THEN 1e-6 WHEN 'u' THEN 1e-6 WHEN 'n' THEN 1e-9 WHEN 'k' THEN 1e3 WHEN 'M' THEN 1e6 ELSE 1 END, 9) AS id_a FROM extracted_rows",
    "c11_ensured": r"""WITH h AS (SELECT listing_id, trim(regexp_extract(gate_charge, '^([^@]*)', 1)) AS q, trim(regexp_extract(rds_on, '^([^@]*)', 1)) AS r FROM listings),
      v AS (SELECT listing_id, abs(try_cast(nullif(regexp_extract(q, '^\s*([-+]?[0-9.]+)\s*(?:[nuμµ]C)?\s*$', 1), '') AS DOUBLE) * CASE WHEN regexp_matches(q, '[uμµ]C\s*$') THEN 1e3 ELSE 1 END) AS q, try_cast(nullif(regexp_extract(r, '^\s*([-+]?[0-9.]+)\s*(?:m(?:Ohm|Ω|O|W))?\s*$', 1), '') AS DOUBLE) * CASE WHEN regexp_matches(r, 'm(?:Ohm|Ω|O|W)\s*$') THEN 1e-3 ELSE 1 END AS r FROM h)
      SELECT listing_id, round(CASE WHEN q BETWEEN 0.1 AND 500 THEN q END, 6) AS qg_nc, round(CASE WHEN r BETWEEN 1e-4 AND 5 THEN r END, 9) AS rds_ohm FROM v""",
    "c13_housing": f"""WITH a AS (SELECT part_id, trim(regexp_replace(translate(regexp_replace(housing, '&times;|&#215;', 'x', 'g'), '×‐‑–—', 'x----'), '\\s+', ' ', 'g')) AS c FROM parts), b AS (SELECT *, upper(regexp_replace(c, '[\\s.\\-()_]', '', 'g')) AS u FROM a)
      SELECT part_id, CASE WHEN lower(c) IN ('', '-', '--', 'nan', 'die form', 'bare die', 'die') THEN NULL {' '.join(f"WHEN {' OR '.join(f"starts_with(u, '{p}')" for p in starts)} THEN '{name}'" for name, starts in tx.HOUSING_FAMILIES)} ELSE c END AS family FROM b""",
    "c14_dates": f"""WITH s AS ({_DATES}), p AS (SELECT doc_id, strpos(text, w) AS place, try_cast(concat(CASE WHEN y < 100 THEN y + 2000 ELSE y END, '-', lpad(CAST(m AS VARCHAR), 2, '0'), '-', lpad(CAST(d AS VARCHAR), 2, '0')) AS DATE) AS d FROM s),
      g AS (SELECT doc_id, count(*) AS n, min({{'place': place, 'd': d}}).d AS d FROM p WHERE d IS NOT NULL GROUP BY doc_id)
      SELECT x.doc_id, CAST(g.d AS VARCHAR) AS first_date, CAST(coalesce(g.n, 0) AS INTEGER) AS n FROM documents x LEFT JOIN g ON x.doc_id = g.doc_id""",
    "c17_symbols": f"""WITH t AS (SELECT text_row_id, regexp_replace(text, '\\p{{Cyrillic}}', 'x', 'g') AS text FROM text_rows), h AS (SELECT text_row_id, regexp_extract(text, '^(.*?)(?:\\s[-+~<>≤±]*[0-9]|$)', 1) AS h FROM t)
      SELECT text_row_id, CASE WHEN length(h) > 80 THEN NULL {' '.join("WHEN regexp_matches(h, '(?i){}'){} THEN '{}'".format(p.replace("'", "''"), f" AND NOT regexp_matches(h, '(?i){stop}')" if stop else '', s) for s, p, stop in tx.SYMBOL_RULES)} END AS symbol FROM h""",
    "c18_row_values": _row_values_sql(),
    "c25_sheet_path": "SELECT listing_id, 'datasheets/' || mfr || '/' || translate(mfr_part, '/ ', '__') || '.pdf' AS path FROM listings",
    "f9_count": "WITH h AS (SELECT part_id, mfr, mpn FROM parts WHERE contains(lower(mfr), 'semi') AND contains(lower(mpn), 'n10')) SELECT h.*, (SELECT count(*) FROM h) AS n FROM h ORDER BY mfr, mpn, part_id LIMIT 20",
    "c16_mentions": """WITH d AS (SELECT doc_id, text, replace(regexp_replace(lower(text), '[-_ ]', '', 'g'), 'o', '0') AS t, left(regexp_replace(replace(regexp_replace(lower(regexp_replace(mpn, ',.*$', '')), '[-_ ]', '', 'g'), 'o', '0'), '[a-z]$', ''), 7) AS h FROM documents)
      SELECT doc_id, coalesce(length(text) >= 60 AND contains(t, h), false) AS ok FROM d""",
    "f9_substring": "SELECT part_id, mfr, mpn FROM parts WHERE contains(lower(mfr), 'semi') AND contains(lower(mpn), 'n10')",
}

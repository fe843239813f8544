"""Parametric search over part records: facets, ranges, filters, sorting, similarity."""

from __future__ import annotations

import math
import re
from functools import reduce
from urllib.parse import parse_qsl, quote, unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Similarity features with their weights where the candidate lies under and over the query.
WEIGHTS = {
    "vds": (3.0, 0.5), "id": (2.0, 0.3), "rds_on": (0.3, 2.0), "qg": (1.0, 1.0), "qsw": (1.0, 1.0),
    "qrr": (1.0, 1.0), "vgs_th": (0.5, 0.5), "vsd": (0.3, 0.3), "vpl": (0.3, 0.3), "qgd_qgs_ratio": (0.5, 0.5),
}
REQUIRED = ("vds", "rds_on")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of all columns at once by grouping sets, the most frequent values first, then by value; nulls count as ''."""
    df = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    sets = df.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    # the bit that is off tells the column
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    full = (1 << len(columns)) - 1
    for i, c in enumerate(columns):
        on = F.col("g") == (full ^ (1 << (len(columns) - 1 - i)))
        name, value = F.when(on, c).otherwise(name), F.when(on, F.col(c)).otherwise(value)
    return sets.select(name.alias("facet"), value.alias("value"), "n").orderBy("facet", F.desc("n"), "value")


def nearest_rank(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """(column, n, lo, hi, at_share): exact order statistic at index min(n - 1, floor(n x share))."""
    return nearest_ranks(df, columns, [share]).withColumn("at_share", F.col("at_share")[0])


def nearest_ranks(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(column, n, lo, hi, at_share): exact order statistics at the indexes min(n - 1, floor(n x share)), in one pass for all shares.

    Distinct values are counted first, so the ordering works on distinct values, not rows, and the
    ranks come from cumulative counts per column over range-partitioned blocks of values.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").filter("v is not null")
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("k"))
    # blocks by the value's magnitude: a column's values never have to meet in one task
    block = F.when(F.col("v") == 0, 0.0).otherwise(F.signum("v") * (F.floor(F.log2(F.abs("v")) * 4) + 10_000))
    counts = counts.withColumn("block", block)
    sums = counts.groupBy("column", "block").agg(F.sum("k").alias("bk"))
    up = Window.partitionBy("column").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # at most some ten thousand blocks a column
    sums = sums.withColumn("before", F.coalesce(F.sum("bk").over(up), F.lit(0))).withColumn("n", F.sum("bk").over(Window.partitionBy("column")))
    inside = Window.partitionBy("column", "block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("k").over(inside)).join(sums.select("column", "block", "before", "n"), ["column", "block"])
    last, first = F.col("before") + F.col("upto"), F.col("before") + F.col("upto") - F.col("k")
    return ranked.groupBy("column").agg(F.first("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.array(*[F.max(F.when((first <= at) & (at < last), F.col("v"))) for at in (F.least(F.col("n") - 1, F.floor(F.col("n") * s)) for s in shares)]).alias("at_share"))


def slider_ranges(df: DataFrame, columns: list[str], sliders: list[str]) -> DataFrame:
    """(column, min, max, slider_max): the slider ends at the 99 % rank where that lies below the maximum; empty columns have 0, 0."""
    names = df.sparkSession.createDataFrame([(c, c in sliders) for c in columns], "column string, slider boolean")
    r = nearest_rank(df, columns, 0.99)
    return F.broadcast(names).join(r, "column", "left").select("column", F.coalesce("lo", F.lit(0.0)).alias("min"), F.coalesce("hi", F.lit(0.0)).alias("max"), F.when(F.col("slider") & (F.col("at_share") < F.col("hi")), F.col("at_share")).alias("slider_max"))


def log_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mu, sigma) of the logarithms of positive values; fewer than two give (0, 1), equal ones sigma 1."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.when(F.col(f) > 0, F.ln(F.col(f))).alias("x")) for f in features])).alias("s")).select("s.*")
    g = long.groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    return g.select("feature", F.when(F.col("n") < 2, 0.0).otherwise(F.col("m")).alias("mu"), F.when((F.col("n") < 2) | (F.col("s") == 0), 1.0).otherwise(F.col("s")).alias("sigma"))


def similarity(query: str, candidate: str, sigma: dict[str, float] | None = None, features: dict = WEIGHTS) -> Column:
    """Asymmetric squared log distance of candidate to query (column prefixes); null where a required value is missing or not positive."""
    total = F.lit(0.0)
    for f, (under, over) in features.items():
        q, c = F.col(query + f), F.col(candidate + f)
        s = F.lit(sigma[f]) if sigma else F.col(f"sigma_{f}")
        d = (F.ln(c) - F.ln(q)) / s
        total = total + F.coalesce(F.when((q > 0) & (c > 0), F.when(d < 0, under).otherwise(over) * d * d), F.lit(0.0))
    ok = reduce(lambda a, b: a & b, [(F.col(query + f) > 0) & (F.col(candidate + f) > 0) for f in REQUIRED])
    return F.when(ok, total)


def most_similar(df: DataFrame, key: str, query_key, limit: int, features: dict = WEIGHTS) -> DataFrame:
    """The limit nearest parts of one part, itself excluded: (key, score). An unknown part gives no row.

    The query is one row and the statistics one row, both broadcast; the ranking is a top-k without full sort.
    """
    stats = log_stats(df, list(features)).groupBy().pivot("feature", list(features)).agg(F.first("sigma"))
    stats = stats.select(*[F.col(f).alias(f"sigma_{f}") for f in features])
    q = df.filter(F.col(key) == F.lit(query_key)).limit(1).select(*[F.col(f).alias(f"q_{f}") for f in features], F.lit(True).alias("q_found"))
    j = df.filter(F.col(key) != F.lit(query_key)).select(key, *[F.col(f).alias(f"c_{f}") for f in features]).crossJoin(F.broadcast(q)).crossJoin(F.broadcast(stats))
    scored = j.select(key, F.round(similarity("q_", "c_", features=features), 4).alias("score")).filter("score is not null")
    return scored.orderBy("score", key).limit(max(1, limit))


def in_facet(c: Column, chosen: list[str]) -> Column:
    """Facet membership with null as ''; no choice means all."""
    return F.coalesce(c, F.lit("")).isin(*chosen) if chosen else F.lit(True)


def wildcard_search(text: str, fields: list[Column]) -> Column:
    """Every token must occur in the joined fields; * stands for anything, case doesn't count."""
    hay = F.concat_ws(" ", *fields)
    parts = [hay.rlike("(?is)" + ".*".join(re.escape(p) if p else "" for p in t.split("*"))) for t in text.split()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def token_search(text: str, fields: list[Column]) -> Column:
    """Every token must be a substring of one of the fields, in lower case."""
    hay = F.lower(F.concat_ws("\n", *fields))
    return reduce(lambda a, b: a & b, [hay.contains(t) for t in text.lower().split()], F.lit(True))


def in_slider(c: Column, lo: float, hi: float, full_lo: bool, full_hi: bool) -> Column:
    """Range filter of a slider: missing values pass only where both ends are full; a full upper end cuts nothing off."""
    inside = ~(c < lo - 1e-9)
    if not full_hi:
        inside = inside & ~(c > hi + 1e-9)
    return F.when(c.isNull(), F.lit(full_lo and full_hi)).otherwise(inside)


def substrate_filter(c: Column, wanted: list[str]) -> Column:
    return c.isNull() | c.isin(*wanted)


def package_filter(c: Column, wanted: str) -> Column:
    """No package passes; TO-220 is found in its three spellings whatever was asked for besides its own clause."""
    own = c.contains("TO220") if wanted == "TO-220" else c.contains(wanted)
    return F.coalesce(own | c.contains("TO-220") | c.contains("T220"), F.lit(True)) if wanted == "TO-220" else F.coalesce(own, F.lit(True))


def web_rows(df: DataFrame) -> DataFrame:
    """Served rows: missing substrate is Si, |vsd|, map of the extra values that are present."""
    extras = F.map_filter(F.create_map(*[x for c in ("qgs", "qgd", "trr", "coss", "rg") for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    return df.withColumns({"substrate": F.when(F.col("substrate").isin("GaN", "SiC"), F.col("substrate")).otherwise("Si"), "vsd": F.abs("vsd"), "extras": extras})


def ui_sorted(df: DataFrame, col: str, descending: bool = False) -> DataFrame:
    """Numbers with missing as 0, texts by their lower case."""
    numeric = df.schema[col].dataType.typeName() in ("double", "long", "integer", "float")
    key = F.coalesce(F.col(col), F.lit(0)) if numeric else F.lower(F.coalesce(F.col(col), F.lit("")))
    return df.orderBy(key.desc() if descending else key.asc())


def significant(c: Column, n: int = 5) -> Column:
    """n significant digits as a number."""
    scale = F.pow(F.lit(10.0), n - 1 - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)


def csv_line(*cells: Column) -> Column:
    """A line of the export (B4): numbers to five significant digits, null as nothing, quotes where a cell needs them (RFC 4180)."""

    def shown(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[shown(c) for c in cells])


def write_export(df: DataFrame, path: str, columns: list[str], score: str | None = None) -> None:
    """The visible columns (and a score, where asked for) as CSV with byte order mark and CRLF (B4), in parts beside each other, the header in a part of its own.

    Doubles come out with five significant digits. Nothing is collected: each partition writes its part.
    """
    names = [*columns, *([score] if score else [])]
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    lines = df.select(csv_line(*[F.regexp_replace(significant(F.col(c)).cast("string"), r"\.0$", "") if c in doubles else F.col(c) for c in names]).alias("value"))
    head = df.sparkSession.createDataFrame([("\ufeff" + ",".join(names),)], "value string").coalesce(1)
    head.write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/header")
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/rows")


def si_text(c: Column, unit: str) -> Column:
    """A value with SI prefix and three significant digits, such as 4.7 mΩ."""
    out = F.lit(None).cast("string")
    for prefix, factor in (("p", 1e-12), ("n", 1e-9), ("µ", 1e-6), ("m", 1e-3), ("", 1.0), ("k", 1e3), ("M", 1e6)):
        out = F.when(F.abs(c) >= factor, F.concat(F.regexp_replace(significant(c / factor, 3).cast("string"), r"\.0$", ""), F.lit(f" {prefix}{unit}"))).otherwise(out)
    return F.when(c == 0, F.lit(f"0 {unit}")).otherwise(out)


class QuerySpec:
    """State of a search as a URL fragment and back: only what differs from the defaults, five significant digits."""

    def __init__(self, text: str = "", mfrs: list[str] | None = None, housings: list[str] | None = None, ranges: dict[str, tuple[float | None, float | None]] | None = None, sort: str = "fom", descending: bool = False):
        self.text, self.mfrs, self.housings, self.ranges, self.sort, self.descending = text, mfrs or [], housings or [], ranges or {}, sort, descending

    @staticmethod
    def _number(x: float | None) -> str:
        return "" if x is None else f"{x:.5g}"

    def encode(self) -> str:
        parts = [("q", self.text)] * bool(self.text) + [("mfr", m) for m in self.mfrs] + [("pkg", h) for h in self.housings]
        parts += [("r." + c, f"{self._number(lo)}~{self._number(hi)}") for c, (lo, hi) in sorted(self.ranges.items()) if lo is not None or hi is not None]
        parts += [("s", ("-" if self.descending else "") + self.sort)] * (self.sort != "fom" or self.descending)
        return "&".join(f"{k}={quote(v)}" for k, v in parts)

    @classmethod
    def decode(cls, fragment: str, bounds: dict[str, tuple[float, float]] | None = None) -> QuerySpec:
        out = cls()
        for k, v in parse_qsl(fragment.lstrip("#"), keep_blank_values=True):
            if k == "q":
                out.text = v
            elif k in ("mfr", "pkg"):
                (out.mfrs if k == "mfr" else out.housings).append(unquote(v))
            elif k.startswith("r."):
                ends = []
                for part in (v.split("~") + [""])[:2]:
                    try:
                        x = float(part)
                    except ValueError:
                        x = math.nan
                    ends.append(None if math.isnan(x) else x)
                if bounds and k[2:] in bounds:
                    lo, hi = bounds[k[2:]]
                    ends = [None if e is None else min(max(e, lo), hi) for e in ends]
                out.ranges[k[2:]] = (ends[0], ends[1])
            elif k == "s":
                out.descending, out.sort = v.startswith("-"), v.lstrip("-")
        return out

    def condition(self, fields: list[Column]) -> Column:
        c = wildcard_search(self.text, fields) & in_facet(F.col("mfr"), self.mfrs) & in_facet(F.col("housing"), self.housings)
        for col, (lo, hi) in self.ranges.items():
            c = c & in_slider(F.col(col), lo if lo is not None else -1e300, hi if hi is not None else 1e300, lo is None, hi is None)
        return c

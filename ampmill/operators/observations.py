"""Observations of datasheet symbols: repair, ordered fusion, nearest condition, wide records, predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spellings of a missing value; symbols that can't be zero; symbols whose lone minimum is a typical value, and whose lone maximum is.
MISSING = ["", "-", "~", ".", "=", '"', "'", "#", "~NA~", "N/A"]
NOT_ZERO = ["Qg", "Qgs", "Qgd"]
LONE_MAX_IS_TYP = ["Qgd", "Qgs", "Qg", "tRise", "tFall"]
STATS = ("vmin", "vtyp", "vmax")


def field_value(c: Column) -> Column:
    """A cell's text as double: missing marks and unreadable texts are null, one thousands comma is dropped."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), "[L.]+$", ""), "[‐-―−]", "-")
    s = F.trim(F.regexp_replace(s, r"^\+- ", ""))
    s = F.when(s.rlike(r"^[^,.]*\d,\d{3}(\.[^,]*)?$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(s)
    return F.when(s.isin(*MISSING) | s.rlike("^[-~]*$"), None).otherwise(s.try_cast("double"))


def value_with_unit(c: Column) -> Column:
    """Struct (value, unit) of "12 nC": exactly a number and a unit (C4)."""
    pattern = r"^\s*([-+]?[0-9.]+(?:[eE][-+]?\d+)?)\s+([a-zA-ZµμΩ°][a-zA-ZµμΩ°/]*)\s*$"
    return F.struct(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("double").alias("value"), F.nullif(F.regexp_extract(c, pattern, 2), F.lit("")).alias("unit"))


def canonical_units(df: DataFrame) -> DataFrame:
    """Charges to nC, capacitances to pF, resistances to mΩ, misread ms of rise and fall times to ns."""
    u, sym = F.col("unit"), F.col("symbol")
    r = F.substring(sym, 1, 1) == "R"
    factor = F.when(u.isin("uC", "μC", "µC", "uc"), 1e3).when(u == "nF", 1e3).when(u.isin("uF", "μF", "µF"), 1e6).when(r & u.isin("W", "Ω", "Ω"), 1e3).otherwise(1.0)
    unit = F.when(sym.isin("tRise", "tFall") & (F.lower(u) == "ms"), "ns").when(u.isin("uC", "μC", "µC", "uc"), "nC").when(u.isin("nF", "uF", "μF", "µF"), "pF").when(r & u.isin("mW", "W", "Ω", "Ω"), "mΩ").otherwise(u)
    return df.withColumns({**{s: F.col(s) * factor for s in STATS}, "unit": unit})


def repaired(df: DataFrame) -> DataFrame:
    """Statistics moved to where they belong and obvious misreadings put right, in this order."""
    sym = F.col("symbol")
    shifts = F.substring(sym, 1, 1).isin("Q", "t") | sym.isin("Vsd", "Coss")
    mn, ty, mx = (F.col(s) for s in STATS)
    two, one = shifts & mx.isNull() & mn.isNotNull() & ty.isNotNull(), shifts & mx.isNull() & mn.isNotNull() & ty.isNull()
    df = df.withColumns({"vmax": F.when(two, ty).otherwise(mx), "vtyp": F.when(two | one, mn).otherwise(ty), "vmin": F.when(two | one, None).otherwise(mn)})
    df = df.withColumn("vtyp", F.when((sym == "Vpl") & (ty > 30) & (ty < 60), ty / 10).otherwise(ty))
    df = df.withColumns({s: F.when((sym == "Vds") & (F.abs(s) < 1), None).otherwise(F.col(s)) for s in STATS})
    small = reduce(lambda a, b: a & b, [F.coalesce((F.col(s) > 0.1) & (F.col(s) < 0.9), F.lit(True)) for s in STATS])
    micro = (sym == "Qrr") & (F.coalesce(F.lower("unit"), F.lit("")).isin("", "c")) & small
    df = df.withColumns({s: F.when(micro, F.col(s) * 1e3).otherwise(F.col(s)) for s in STATS})
    lone = sym.isin(*LONE_MAX_IS_TYP) & mx.isNotNull() & mn.isNull() & ty.isNull()
    df = df.withColumns({"vtyp": F.when(lone, mx).otherwise(ty), "vmax": F.when(lone, None).otherwise(mx)})
    swap = (sym == "Vsd") & (mx < ty) & (F.try_divide(ty, mx) < 1.5)
    return df.withColumns({"vtyp": F.when(swap, mx).otherwise(ty), "vmax": F.when(swap, ty).otherwise(mx)})


def reject_reason(df: DataFrame) -> Column:
    """Why an observation is invalid, null if it is not (C7, C8): unit, ratio of maximum to typical value, nothing there, range."""
    sym, ratio = F.col("symbol"), F.try_divide("vmax", "vtyp")
    most = F.when(sym == "Crss", 30.0).otherwise(5.0)
    value = F.coalesce("vtyp", "vmax", "vmin")
    return (
        F.when((sym == "Vds") & F.col("unit").rlike("/°C|mV"), "unit")
        .when(F.col("vmax").isNotNull() & F.col("vtyp").isNotNull() & ~F.coalesce((ratio > 1) & (ratio < most), F.lit(False)), "ratio")
        .when(value.isNull(), "empty")
        .when((sym == "Vpl") & ~((value > 1) & (value < 10)), "range")
        .when((sym == "Vsd") & ~((F.abs(value) > 0.1) & (F.abs(value) < 6)), "range")
    )


def fold(obs: DataFrame, keys: list[str]) -> DataFrame:
    """One fused record (keys, vmin, vtyp, vmax) per key from observations in order ord.

    The first observation is the record; a later one fills a missing statistic if it is not below the
    statistic under it at that time (0 for charges). A charge of 0 doesn't stand: whatever the next
    observation has, even nothing, takes its place. In place of an ordered fold over a collected list,
    each statistic is the earliest acceptable one, given the time at which the one under it was set:
    three aggregations with partial (map-side) combination, so a key of any size never meets in one task.
    Only keys that hold a 0 of a charge have their rows put in order, for what follows a 0. Nulls are
    missing; equal ord values count as one observation's.
    """
    nz = F.col("symbol").isin(*NOT_ZERO)
    o = obs.select(*keys, "ord", *STATS, F.when(nz, 0.0).otherwise(F.lit(float("-inf"))).alias("base"))
    zero = lambda s: (F.col("base") == 0) & F.coalesce(F.col(s) == 0, F.lit(False))
    known = o.groupBy(*keys).agg(F.min("ord").alias("t0"), F.max(zero("vmin") | zero("vtyp") | zero("vmax")).alias("z"))
    o = o.join(known, keys)
    w = Window.partitionBy(*keys).orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    follows, starts, nothing = {}, {}, {}
    for s in STATS:
        begins = F.when(zero(s) & ~F.coalesce(F.lag(zero(s)).over(w), F.lit(False)), F.col("ord"))
        starts[f"{s}_begins"] = begins
        follows[f"{s}_after0"] = F.coalesce(F.lag(zero(s)).over(w), F.lit(False))
        nothing |= {f"{s}_after0": F.lit(False), f"{s}_begins": F.lit(None).cast("long"), f"{s}_run": F.lit(None).cast("long")}
    with_zero = o.filter("z").withColumns({**follows, **starts})
    # the run of zeros that ends right before a row or with it
    with_zero = with_zero.withColumns({f"{s}_run": F.coalesce(f"{s}_begins", F.last(f"{s}_begins", True).over(before)) for s in STATS})
    # for a run of the largest statistic, what the typical one was where it began
    typ_then = F.when(F.col("vmax_begins").isNotNull(), F.struct(zero("vtyp").alias("zero"), F.col("vtyp_run").alias("run")))
    with_zero = with_zero.withColumn("__then", typ_then).withColumn("typ_then", F.coalesce("__then", F.last("__then", True).over(before))).drop("__then")
    nothing["typ_then"] = F.lit(None).cast("struct<zero:boolean,run:bigint>")
    o = with_zero.unionByName(o.filter("not z").withColumns(nothing))

    def first(s: str, fits: Column, after_run: Column) -> Column:
        ok = F.col(s).isNotNull() & ~zero(s) & ((F.col("ord") == F.col("t0")) | fits | (F.col(f"{s}_after0") & after_run))
        return F.min(F.when(ok, F.struct("ord", s)))

    # a run of zeros stands if its first one does: as first observation, or where nothing above 0 lies under it
    under = lambda s, at: F.coalesce((F.col(f"{s}.ord") <= at), F.lit(False))
    a = o.groupBy(*keys).agg(first("vmin", F.col("vmin") >= F.col("base"), F.lit(True)).alias("m"), F.max(F.struct("ord", zero("vmin").alias("zero"))).alias("m_end"))
    j = o.join(a, keys)
    low = F.when(under("m", F.col("ord")), F.col("m.vmin")).otherwise(F.col("base"))
    typ_stands = lambda run: F.coalesce(run == F.col("t0"), F.lit(False)) | ~(under("m", run) & (F.col("m.vmin") > 0))
    stands_t = typ_stands(F.col("vtyp_run"))
    b = j.groupBy(*keys).agg(first("vtyp", F.col("vtyp") >= low, stands_t).alias("t"), F.min("m").alias("m"), F.min("m_end").alias("m_end"), F.max(F.struct("ord", (zero("vtyp") & stands_t).alias("zero"))).alias("t_end"))
    j = o.join(b, keys)
    low = F.when(under("t", F.col("ord")), F.col("t.vtyp")).when(zero("vtyp") & stands_t, 0.0).when(under("m", F.col("ord")), F.col("m.vmin")).otherwise(F.col("base"))
    at_run = F.when(under("t", F.col("vmax_run")), F.col("t.vtyp")).when(F.coalesce("typ_then.zero", F.lit(False)) & typ_stands(F.col("typ_then.run")), 0.0).when(under("m", F.col("vmax_run")), F.col("m.vmin")).otherwise(0.0)
    stands_x = F.coalesce(F.col("vmax_run") == F.col("t0"), F.lit(False)) | (at_run <= 0)
    c = j.groupBy(*keys).agg(first("vmax", F.col("vmax") >= low, stands_x).alias("x"), *[F.min(n).alias(n) for n in ("m", "m_end", "t", "t_end")], F.max(F.struct("ord", (zero("vmax") & stands_x).alias("zero"))).alias("x_end"))
    # a 0 that came last is the record's
    return c.select(*keys, *[F.coalesce(F.col(f"{n}.{s}"), F.when(F.col(f"{n}_end.zero"), 0.0)).alias(s) for n, s in (("m", "vmin"), ("t", "vtyp"), ("x", "vmax"))])


def accessor(*order: str) -> Column:
    """The first statistic that is there, in a given order of min, typ and max."""
    return F.coalesce(*[F.col(f"v{s}") for s in order])


def richest_first(obs: DataFrame) -> DataFrame:
    """Observations with ord such that those with more statistics come first, then as before."""
    present = sum(F.when(F.col(s).isNotNull(), 1).otherwise(0) for s in STATS)
    return obs.withColumn("ord", (3 - present).cast("long") * 10**15 + F.col("ord"))


def report_row(fused: DataFrame, key: str) -> DataFrame:
    """One report row per part (E8): the resistance at 10 V, else the plain one; the current at 25 °C, else the plain one."""
    of = lambda symbol, *order: F.max(F.when(F.col("symbol") == symbol, accessor(*order)))
    best = ("typ", "max", "min")
    return fused.groupBy(key).agg(
        F.coalesce(of("Rds_on_10v", "max"), of("Rds_on", "max")).alias("rds_max"), F.coalesce(of("ID_25", *best), of("Id", *best)).alias("id"), of("Vds", "max", "min").alias("vds_max"),
        of("Qg", "max").alias("qg_max"), of("Qgs", *best).alias("qgs"), of("Qgd", *best).alias("qgd"), of("Vsd", *best).alias("vsd"), of("Qrr", "typ").alias("qrr_typ"), of("Qrr", "max").alias("qrr_max"),
    )


def nearest_condition(obs: DataFrame, fused: DataFrame, keys: list[str], conditions: dict[str, float], threshold: float = 0.1) -> DataFrame:
    """Per key the observation whose test conditions come nearest, else the fused record (E5).

    Distance is the root mean square of relative differences, an absent condition counting as 0. An
    observation must be nearer than the threshold where a fused value exists; ties go to the earlier.
    obs has a column cond_<name> for each condition.
    """
    e = F.sqrt(sum(F.pow((F.coalesce(F.col(f"cond_{k}"), F.lit(0.0)) - v) / (abs(v) + 1e-3), F.lit(2.0)) for k, v in conditions.items()) / len(conditions))
    value = F.coalesce("vtyp", "vmax", "vmin")
    usable = obs.filter(~(F.col("symbol").isin(*NOT_ZERO) & F.coalesce(value == 0, F.lit(False))))
    best = usable.groupBy(*keys).agg(F.min(F.struct(e.alias("e"), "ord", *STATS)).alias("b"))
    f_value = F.coalesce("f.vtyp", "f.vmax", "f.vmin")
    j = fused.alias("f").join(best.alias("o"), keys, "full")
    take = F.col("b").isNotNull() & (f_value.isNull() | (F.col("symbol").isin(*NOT_ZERO) & (f_value == 0)) | (F.col("b.e") < threshold))
    return j.select(*keys, *[F.when(take, F.col(f"b.{s}")).otherwise(F.col(f"f.{s}")).alias(s) for s in STATS], F.when(take, F.col("b.e")).alias("error"))


def wide(fused: DataFrame, key: str, symbols: list[str]) -> DataFrame:
    """One row per part with the typical (else largest, else smallest) value of each symbol, in SI units."""
    value = F.coalesce("vtyp", "vmax", "vmin")
    pick = F.when(F.col("symbol") == "Rds_on", F.coalesce("vmax", "vtyp") * 1e-3).when(F.col("symbol").startswith("V"), value).when(F.col("symbol") == "Coss", value * 1e-12).otherwise(value * 1e-9)
    return fused.withColumn("si", pick).groupBy(key).pivot("symbol", symbols).agg(F.max("si"))


# --- predicates ---------------------------------------------------------------------------------

_PREDICATE = re.compile(r"^\s*(!)?\s*([A-Za-z_]\w*)(?:\.([A-Za-z_]\w*)(?:\.([A-Za-z_]\w*))?)?\s*(?:(==|!=|<=|>=|<|>|~=)\s*(.+?))?\s*$")
_COLUMN = {"min": "vmin", "typ": "vtyp", "max": "vmax", "unit": "unit", "source": "source"}


@dataclass
class Predicate:
    """One filter "[!]SYM[.ATTR[.KEY]] [OP VALUE]" over a part's observations."""

    negated: bool
    symbol: str
    attribute: str | None
    key: str | None
    op: str | None
    kind: str | None
    value: object

    @classmethod
    def parse(cls, text: str) -> Predicate:
        m = _PREDICATE.match(text)
        if not m or (m[4] and m[3] != "cond"):
            raise ValueError(f"not a filter: {text!r}")
        kind, value = _literal(m[6]) if m[5] else (None, None)
        if m[5] == "~=" and kind != "regex":
            raise ValueError(f"~= needs /pattern/: {text!r}")
        return cls(bool(m[1]), m[2], m[3], m[4], m[5], kind, value)

    def holds(self) -> Column:
        """Whether one observation row makes the filter true (before negation); never null."""
        if self.attribute is None or self.attribute == "n":
            return F.col("symbol") == self.symbol
        c = F.col(f"cond_{self.key.lower()}") if self.attribute == "cond" and self.key else F.col(_COLUMN[self.attribute])
        if self.op is None:
            ok = c.isNotNull()
        elif self.op == "~=":
            ok = F.coalesce(c.cast("string"), F.lit("")).rlike(str(self.value))
        elif self.kind in ("nan", "none"):
            # nothing equals a missing value, so everything differs from it
            ok = F.lit(self.op == "!=")
        else:
            left = c.try_cast("double") if self.kind == "num" else c
            test = {"==": left == self.value, "!=": left != self.value, "<": left < self.value, "<=": left <= self.value, ">": left > self.value, ">=": left >= self.value}[self.op]
            ok = F.when(c.isNull(), F.lit(self.op == "!=")).otherwise(F.coalesce(test, F.lit(False)))
        return (F.col("symbol") == self.symbol) & F.coalesce(ok, F.lit(False))

    def over_part(self) -> Column:
        """The aggregate over a part's observations."""
        if self.attribute == "n":
            n = F.count_if(self.holds())
            ok = n > 0 if self.op is None else {"==": n == self.value, "!=": n != self.value, "<": n < self.value, "<=": n <= self.value, ">": n > self.value, ">=": n >= self.value}[self.op]
        else:
            ok = F.coalesce(F.bool_or(self.holds()), F.lit(False))
        return ~ok if self.negated else ok


def _literal(s: str) -> tuple[str, object]:
    s = s.strip()
    if len(s) >= 2 and s[0] == s[-1] == "/":
        return "regex", s[1:-1]
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'":
        return "str", s[1:-1]
    if s in ("nan", "None", "null"):
        return ("nan" if s == "nan" else "none"), None
    try:
        return "num", float(s)
    except ValueError:
        return "str", s


def parts_where(obs: DataFrame, key: str, filters: list[str]) -> DataFrame:
    """Keys for which all filters hold: one conditional aggregation with partial combination for all filters together."""
    parsed = [Predicate.parse(f) for f in filters]
    g = obs.groupBy(key).agg(*[p.over_part().alias(f"f{i}") for i, p in enumerate(parsed)])
    return g.filter(reduce(lambda a, b: a & b, [F.col(f"f{i}") for i in range(len(parsed))], F.lit(True))).select(key)


def coverage(obs: DataFrame, key: str) -> DataFrame:
    """(symbol, parts, share): parts that have each symbol."""
    pairs = obs.select(key, "symbol").distinct()
    total = obs.select(key).distinct().agg(F.count(F.lit(1)).alias("total"))
    return pairs.groupBy("symbol").agg(F.count(F.lit(1)).alias("parts")).crossJoin(F.broadcast(total)).select("symbol", "parts", (F.col("parts") / F.col("total")).alias("share"))


def corpus_summary(fused: DataFrame, key: str) -> DataFrame:
    """One row: parts, fused fields, present values."""
    present = sum(F.when(F.col(s).isNotNull(), 1).otherwise(0) for s in STATS)
    return fused.groupBy(key).agg(F.count(F.lit(1)).alias("f"), F.sum(present).alias("v")).agg(F.count(F.lit(1)).alias("parts"), F.sum("f").alias("fields"), F.sum("v").alias("present_values"))


def needed(have: Column, wanted: list[str | tuple[str, ...]]) -> Column:
    """Wanted symbols still missing; a group of alternatives is met by any of them."""
    items = [F.when(~F.arrays_overlap(have, F.array(*[F.lit(x) for x in (w if isinstance(w, tuple) else (w,))])), F.lit("|".join(w) if isinstance(w, tuple) else w)) for w in wanted]
    return F.array_compact(F.array(*items))


def equal_count(reference: DataFrame, other: DataFrame, keys: list[str], threshold: float = 0.05) -> DataFrame:
    """Per part the number of (symbol, statistic) pairs in which the other's fused value comes within the threshold of some reference observation."""
    err = lambda s: F.try_divide(F.abs(F.col(f"o.{s}") - F.col(f"r.{s}")), F.abs(F.col(f"r.{s}")))
    j = reference.alias("r").join(other.alias("o"), keys).groupBy(*keys).agg(*[F.min(err(s)).alias(s) for s in STATS])
    return j.groupBy(keys[0]).agg(F.sum(sum(F.when(F.col(s) < threshold, 1).otherwise(0) for s in STATS)).alias("n_equal"))


def difference_count(reference: DataFrame, other: DataFrame, keys: list[str], threshold: float = 0.001) -> DataFrame:
    """Per part the number of reference observations that the other's record doesn't reproduce (E14): a statistic it lacks counts as error 1."""
    j = reference.alias("r").join(other.alias("o"), keys, "left")
    worst = F.greatest(*[F.when(F.col(f"r.{s}").isNotNull() & F.col(f"o.{s}").isNull(), 1.0).otherwise(F.coalesce(F.try_divide(F.abs(F.col(f"o.{s}") - F.col(f"r.{s}")), F.abs(F.col(f"r.{s}"))), F.lit(0.0))) for s in STATS])
    return j.groupBy(*[F.col(k) for k in keys[:1]]).agg(F.sum(F.when(worst >= threshold, 1).otherwise(0)).alias("n_different"))


# --- part numbers -------------------------------------------------------------------------------


def base_lookup(parts: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry entries of parts (mfr, mpn): exact number first, else the longest base of which the part is an orderable variant.

    A variant is a base with two to five letters and a digit behind it (for IQD, IQE and ISC bases also a
    layout code CG, SC or CGSC). The possible bases of a number are few, so the lookup is an equi join.
    Null makers and numbers match nothing. registry (mfr, base, value...) has unique keys.
    """
    tails = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(2), F.lit(10)), lambda i: i)))
    p = parts.withColumn("__n", F.explode(tails)).filter(F.length("mpn") > F.col("__n"))
    p = p.withColumn("base", F.left("mpn", F.length("mpn") - F.col("__n"))).withColumn("__rest", F.right("mpn", F.col("__n")))
    family = F.upper(F.left("base", F.lit(3))).isin("IQD", "IQE", "ISC")
    p = p.filter((F.col("__n") == 0) | F.col("__rest").rlike(r"^[A-Z]{2,5}\d$") | (family & F.col("__rest").rlike(r"^(CG|SC|CGSC)([A-Z]{2,5}\d)?$")))
    p = p.withColumn("__mfr", F.lower("mfr"))
    r = registry.withColumn("__mfr", F.lower("mfr")).drop("mfr")
    j = p.join(r, ["__mfr", "base"])
    keep = [c for c in r.columns if c not in ("__mfr", "base")]
    best = j.groupBy("mfr", "mpn").agg(F.min_by(F.struct("base", *keep), F.col("__n")).alias("b"))
    return best.select("mfr", "mpn", "b.*")


def collapse_variants(parts: DataFrame) -> DataFrame:
    """Parts (mfr, mpn) that don't start with a shorter number of the same maker (E16): an anti join on the number's own prefixes."""
    p = parts.select("mfr", "mpn").distinct()
    heads = p.select("mfr", F.col("mpn").alias("whole"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("mpn") - 1)), lambda i: F.left("mpn", i))).alias("mpn")).filter("whole <> mpn")
    covered = heads.join(p, ["mfr", "mpn"], "left_semi").select("mfr", F.col("whole").alias("mpn")).distinct()
    return p.join(covered, ["mfr", "mpn"], "left_anti")


def merge_catalogues(rows: DataFrame) -> DataFrame:
    """One record per (mfr, number without packing suffix) from sources in order ord.

    Voltage: the first; of opposite signs the negative one; rds: the first; id: least; vgs_th_max and
    qg_max: largest; qg_typ: mean; package: first. conflict lists values whose spread (deviation over
    mean) is beyond what the field allows. Records known from the distributor alone don't change a
    record that another source gave.
    """
    key = F.regexp_replace("mpn", "(AKMA1|AKSA1|XKSA1|XKMA1)$", "")
    own = F.col("source") != "distributor"
    r = rows.withColumn("base", key)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ord", c))).getField(c)
    named = r.join(r.groupBy("mfr", "base").agg(F.min("ord").alias("o0")), ["mfr", "base"]).filter(own | (F.col("ord") == F.col("o0")))
    spread = lambda c: F.try_divide(F.stddev_pop(c), F.abs(F.avg(c)))
    limits = {"rds_on": 0.45, "id": 0.45, "vgs_th_max": 0.3, "qg_typ": 0.01, "qg_max": 0.2}
    g = named.groupBy("mfr", "base").agg(
        F.when((F.min("vds") < 0) & (F.max("vds") > 0), F.min("vds")).otherwise(first("vds")).alias("vds"),
        first("rds_on").alias("rds_on"), F.min("id").alias("id"), F.max("vgs_th_max").alias("vgs_th_max"), F.avg("qg_typ").alias("qg_typ"), F.max("qg_max").alias("qg_max"), first("package").alias("package"), F.count(F.lit(1)).alias("n_records"),
        F.array_compact(F.array(*[F.when(spread(c) > limit, F.lit(c)) for c, limit in limits.items()], F.when((F.max(F.abs("vds")) > F.min(F.abs("vds"))), F.lit("vds")))).alias("conflict"),
    )
    return g


def upsert(table_rows: DataFrame, new_rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row per key by order, new rows over old ones (A20): a combining aggregation, not a window over a key's rows."""
    both = table_rows.withColumn("__new", F.lit(0)).unionByName(new_rows.withColumn("__new", F.lit(1)))
    rest = [c for c in table_rows.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__new", order)).alias("r"))
    return last.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted by several keys, '-' for descending, missing lowest."""
    return df.orderBy(*[F.col(k.lstrip("-")).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_first() for k in keys])


def filled_down(df: DataFrame, part: list[str], order: str, col: str, up: bool = False) -> DataFrame:
    """Missing cells from the last (or, upwards, next) one present within a table."""
    w = Window.partitionBy(*part).orderBy(order)
    v = F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if up else F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(f"{col}_filled", v)

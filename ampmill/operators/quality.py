"""Refresh lists, validation reports, scoreboards, recovery sweeps and further page operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampmill.functions.bind import let
from ampmill.functions.units import number, plain, spellings, unit_beside
from ampmill.operators import recovery

# Fields that a served part should have, with the range in which a value counts as present.
SERVED = {"vds": (1.0, 5000.0), "rds_on": (1e-6, 10.0), "id": (0.01, 2000.0), "qg": (1e-11, 2e-6), "vpl": (1.0, 10.0), "qrr": (0.0, 200e-6)}


def missing_fields(df: DataFrame) -> Column:
    """Labels of served fields that are missing or out of range, the lower bound itself being out except for qrr."""
    checks = [F.when(~F.coalesce((F.col(c) >= lo if c == "qrr" else F.col(c) > lo) & (F.col(c) < hi), F.lit(False)), F.lit(c)) for c, (lo, hi) in SERVED.items()]
    return F.array_compact(F.array(*checks))


def refreshed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New records where they have no more missing fields than the old ones, old ones else (E15's guard against regressions)."""
    fields = list(SERVED)
    o = old.select(key, F.struct(*fields).alias("o"), F.size(missing_fields(old)).alias("no"))
    n = new.select(key, F.struct(*fields).alias("n"), F.size(missing_fields(new)).alias("nn"))
    j = o.join(n, key, "full")
    take = F.col("o").isNull() | (F.col("n").isNotNull() & (F.col("nn") <= F.col("no")))
    return j.select(key, *[F.when(take, F.col("n")[f]).otherwise(F.col("o")[f]).alias(f) for f in fields], take.alias("refreshed"))


def reason_counts(df: DataFrame, group: str, reasons: Column) -> DataFrame:
    """(group, reason, n) of an array of reasons, texts cut at the first colon."""
    return df.select(group, F.explode(reasons).alias("r")).select(group, F.split("r", ":")[0].alias("reason")).groupBy(group, "reason").agg(F.count(F.lit(1)).alias("n"))


def scoreboard(obs: DataFrame, pipeline: str, symbols: list[str]) -> DataFrame:
    """Present values by pipeline and symbol."""
    present = sum(F.when(F.col(s).isNotNull(), 1).otherwise(0) for s in ("vmin", "vtyp", "vmax"))
    return obs.groupBy(pipeline).pivot("symbol", symbols).agg(F.sum(present)).na.fill(0)


def equal_scoreboard(reference: DataFrame, obs: DataFrame, pipeline: str, keys: list[str], threshold: float = 0.05) -> DataFrame:
    """(pipeline, symbol, n_equal): values of each pipeline within the threshold of the reference record's."""
    j = obs.alias("o").join(reference.alias("r"), keys)
    near = lambda s: F.when(F.try_divide(F.abs(F.col(f"o.{s}") - F.col(f"r.{s}")), F.abs(F.col(f"r.{s}"))) < threshold, 1).otherwise(0)
    return j.groupBy(pipeline, "symbol").agg(F.sum(sum(near(s) for s in ("vmin", "vtyp", "vmax"))).alias("n_equal"))


def shares(losses: DataFrame, group: str, col: str) -> DataFrame:
    """Each row's percentage of its group and of the whole (G11): two small aggregates joined back."""
    g = losses.groupBy(group).agg(F.sum(col).alias("group_sum"))
    return losses.join(g, group).crossJoin(F.broadcast(losses.agg(F.sum(col).alias("all_sum")))).select("*", (F.try_divide(F.col(col), "group_sum") * 100).alias("of_group"), (F.try_divide(F.col(col), "all_sum") * 100).alias("of_all"))


def fom_qrr_at(df: DataFrame) -> DataFrame:
    """Recovery charge and figure of merit at an operating point op_if, op_didt (H19): 0 for parts without recovery, null without a fit."""
    p = recovery.predict(recovery.fit(df))
    q = F.when(F.col("qrr") == 0, 0.0).otherwise(F.col("op_qrr"))
    return p.withColumn("qrr_op", q).withColumn("fom_qrr_op", F.col("rds_on") * q * 1e12)


def tau_exponent(rows: DataFrame, key: str, lo: float = 0.0, hi: float = 5.0) -> DataFrame:
    """Exponent of the lifetime over temperature that fits a part's charges best.

    rows has tj and qrr_ratio (charge over the one at 25 °C), taken to grow as the lifetime does. The
    summed squared log error is a parabola in the exponent, so its least value within lo..hi needs two
    sums. Missing, not positive and absurd rows don't count; points is the number of those that do; null
    where no row tells anything.
    """
    x, y = F.log(F.when(F.col("tj") > -273.15, (F.col("tj") + 273.15) / 298.15)), F.log(F.when(F.col("qrr_ratio") > 0, F.col("qrr_ratio")))
    ok = x.isNotNull() & y.isNotNull()
    g = rows.groupBy(key).agg(F.sum(F.when(ok, x * y)).alias("xy"), F.sum(F.when(ok, x * x)).alias("xx"), F.count_if(ok).alias("points"))
    slope = F.try_divide("xy", "xx")
    return g.select(key, F.when(slope.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), slope))).alias("n_tau"), "points")


def resolved_exponent(parts: DataFrame, measured: DataFrame, key: str, family: str, least_points: int = 3, conservative: float = recovery.N_TAU) -> DataFrame:
    """(key, n_tau, state) for each part (H16): the measured fit where it rests on enough points, else the mean of the family's, else the conservative value.

    state is 'measured', 'family' or 'conservative'. A null family has no pool.
    """
    own = parts.select(key, family).join(measured.filter(F.col("points") >= least_points).select(key, F.col("n_tau").alias("own")), key, "left")
    pool = own.filter(F.col("own").isNotNull() & F.col(family).isNotNull()).groupBy(family).agg(F.avg("own").alias("pooled"))
    j = own.join(pool, family, "left")
    return j.select(key, F.coalesce("own", "pooled", F.lit(conservative)).alias("n_tau"), F.when(F.col("own").isNotNull(), "measured").when(F.col("pooled").isNotNull(), "family").otherwise("conservative").alias("state"))


# Quantity of a symbol by its beginning, the first that fits wins.
_QUANTITIES = [("Rth", "thermal resistance"), ("R", "resistance"), ("Q", "charge"), ("V", "voltage"), ("C", "capacitance"), ("t", "time"), ("I", "current"), ("T", "temperature")]
# Ordered families of value cells over kinds of tokens: W word, C condition, N number, D mark for none, U unit, L line end, X the next symbol's line.
_LEAD, _COND, _END = "[WU]*L?(?:W+L){0,3}", "(?:C[WL]*)+", "(?=L|C|W*X|$)"
FAMILIES = [
    (name, re.compile(pattern))
    for name, pattern in [
        ("mtm_unit", rf"{_LEAD}(?P<min>[ND])U?L?(?P<typ>N)U?L?(?P<max>[ND])L?U{_END}"),
        ("cond_mtm_unit", rf"{_LEAD}{_COND}(?P<min>[ND])U?L?(?P<typ>[ND])U?L?(?P<max>[ND])L?U{_END}"),
        ("cond_typ_max_unit", rf"{_LEAD}(?:{_COND})?(?P<typ>N)U?L?(?P<max>[ND])L?U{_END}"),
        ("cond_max_unit", rf"{_LEAD}(?:{_COND})?(?P<typ>D)L?(?P<max>N)L?U{_END}"),
        ("mtm_unit_cond", rf"{_LEAD}(?:(?P<min>[ND])U?L?)?(?P<typ>[ND])U?L?(?P<max>[ND])L?UL?C"),
        ("mtm_cond_next", rf"{_LEAD}(?P<min>[ND])U?L?(?P<typ>N)U?L?(?P<max>[ND])U?L?{_COND}X"),
        ("cond_typ_next", rf"{_LEAD}{_COND}(?P<typ>N)U?L?X"),
        ("typ_max_unit", rf"{_LEAD}(?:{_COND})?(?P<typ>N)U?L?(?P<max>[ND])U?{_END}"),
        ("typ_next", rf"{_LEAD}(?P<min>D)L(?P<typ>N)L(?:(?P<max>[ND])L)?X"),
        ("cond_mtm", rf"{_LEAD}(?:{_COND})?(?P<min>[ND])U?L?(?P<typ>[ND])U?L?(?P<max>[ND])U?{_END}"),
        ("cond_max", rf"{_LEAD}(?:{_COND})?(?P<typ>D)L?(?P<max>N)U?{_END}"),
        ("single", rf"{_LEAD}(?:{_COND})?(?P<typ>N)L?U?{_END}"),
    ]
]
_SIZES: dict[str, dict[str, float]] = {}
for _q, _s, _f, _ in spellings():
    _SIZES.setdefault(_q, {})[_s] = _f
_UNIT = {q: "(?:" + "|".join(sorted(map(re.escape, s), key=lambda x: (-len(x), x))) + r")(?![^\W_]|[/(])" for q, s in _SIZES.items()}
_FIGURE = r"(?:(?:[<>≤≥~±]|\+/?-|\+) ?)*(?P<n>-?(?:\d+(?:[.,]\d+)*|[.,]\d+)(?:[eE][-+]?\d+)?)"
_CONDITION = r"[^\W\d_][\w/]*(?: ?\([^)]*\))? ?= ?(?:[-+]?[\d.,]+(?:[eE][-+]?\d+)? ?(?:[a-zA-Zμ°Ω%]+(?:/[a-zA-Zμ]+)?)?|[^\W\d_]+)(?=[,; )\n]|$)[,;]?"
_TOKENS = {q: re.compile(rf"(?P<C>{_CONDITION})|(?P<N>{_FIGURE}(?= ?{u}|[\s,;|()]|$))|(?P<D>(?:-{{1,3}}|[~—–]|(?i:n/a))(?= |\n|$))|(?P<U>{u})|(?P<L>\n)|(?P<W>[^\s,;|()]+)|[\s,;|()]") for q, u in _UNIT.items()}


def _figure(x: str) -> float | None:
    x = x.replace(",", "") if re.fullmatch(r"-?\d{1,3}(,\d{3})+(\.\d+)?", x) else x.replace(",", ".")
    try:
        return float(x)
    except ValueError:
        return None


def parse_values(symbol: str, lines: list[str], followed: bool) -> tuple | None:
    """(line, vmin, vtyp, vmax, unit, cond, family, consumed) of the first family that fits the lines behind a symbol; followed: another symbol's line comes next."""
    quantity = next((q for start, q in _QUANTITIES if symbol.startswith(start)), None)
    if quantity is None:
        return None
    found = [m for m in _TOKENS[quantity].finditer("\n".join(lines)) if m.lastgroup]
    kinds = "".join("N" if m["N"] else m.lastgroup for m in found)
    kinds += "LX" if followed else ""
    for name, family in FAMILIES:
        m = family.match(kinds)
        if not m:
            continue
        spans = {k: m.start(k) for k in m.groupdict() if m[k] == "N"}
        if not spans:
            continue
        last = max(spans.values())
        used = [t.group() for t, k in zip(found, kinds) if k == "U"]
        unit = used[-1] if used else None
        sizes, out = _SIZES[quantity], {}
        for k, i in spans.items():
            own = found[i + 1].group() if kinds[i + 1 : i + 2] == "U" else unit
            v = _figure(found[i]["n"])
            # cells of one line may differ in unit: all come out in the last one
            out[k] = v if own == unit or v is None else float(f"{v * sizes[own] / sizes[unit]:.12g}")
        cond = ", ".join(t.group().rstrip(",;") for t in found if t.lastgroup == "C")
        return kinds[:last].count("L"), out.get("min"), out.get("typ"), out.get("max"), unit, cond or None, name, m.group().count("L")
    return None


def text_values(lines: DataFrame, page: list[str], order: str, symbol: str, text: str, width: int = 12) -> DataFrame:
    """Values in the width lines from one that names a symbol (C19): (page, order, symbol, value_line, vmin, vtyp, vmax, unit, cond, family).

    The ordered families decide; a line with another symbol ends the window, and reading goes on after the
    lines consumed. Their state runs through a page: one Arrow-batched map over pages.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(symbol).alias("s"), plain(F.col(text)).alias("t"))))
    fields = "o long, symbol string, value_line long, vmin double, vtyp double, vmax double, unit string, cond string, family string"
    names = [*page, *[f.split()[0] for f in fields.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, ls in zip(zip(*[pdf[c] for c in page]), pdf["rows"]):
                i = 0
                while i < len(ls):
                    s, step = ls[i]["s"], 1
                    if s is not None:
                        end = i + 1
                        # a name's line may be followed by the same symbol's own line
                        if end < len(ls) and ls[end]["s"] == s and not re.search(r"\d|=", ls[i]["t"] or ""):
                            end += 1
                        while end < min(len(ls), i + width) and ls[end]["s"] is None:
                            end += 1
                        got = parse_values(s, [x["t"] or "" for x in ls[i:end]], end < len(ls) and ls[end]["s"] is not None)
                        if got:
                            out.append((*key, ls[i]["o"], s, i + 1 + got[0], *got[1:7]))
                            step = max(1, got[7] - 1)
                    i += step
            yield pd.DataFrame(out, columns=names)

    keys = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in page)
    return lines.groupBy(*page).agg(rows.alias("rows")).mapInPandas(run, f"{keys}, {fields}").withColumnRenamed("o", order)


# Recovery charge as the makers print it, with test conditions, by tag of the maker.
_N, _DIDT = "[-0-9.]+", r"(?<didt>[0-9.]+)\s*A/[uµμ]s"
RECOVERY_PATTERNS = {
    "infineon": rf"(?:Q\s?rr|reverse\srecovery\scharge[\s()0-9]+Q|Qrr\s+Reverse\s+Recovery\s+Charge)\s+(?:(?<min>{_N})\s+)?(?<typ>{_N})\s+(?<max>{_N})\s*(?<unit>nC)",
    "ti": rf"Qrr\nReverse Recovery Charge\nVDS=\s*(?<vds>[0-9.]+)\s*V,\s*IF\s*=\s*(?<if>[0-9.]+)\s*A,\ndi/dt\s*=\s*{_DIDT}\n(?<typ>[0-9.]+)\n(?<unit>nC)",
    "ao": r"Qrr\s+(?<typ>[0-9.]+)\s+(?<unit>nC)",
    "onsemi": rf"(?:IF =\s*(?<if>[0-9.]+)\s*A, di/dt =\s*{_DIDT}\s[\s\S]{{4,20}})?(?:Qrr\s+Reverse[-\s]Recovery Charge|Reverse[−\s]Recover[edy]{{1,2}}\s+Charge\s+QRR)\s+(?:ISD = (?<if2>[0-9.]+)\s*A, dISD/dt = {_DIDT.replace('didt', 'didt2')}\s+)?(?:(?<min>{_N})\s+)?(?<typ>{_N})\s+(?:(?<max>{_N})\s+)?(?<unit>nC)",
    "nxp": rf"Qrr?\s+recovered\s+charge\s+(?:IS = (?<if>[0-9.]+) A; dIS/dt = (?<didt>{_N}) A/[uµμ]s;\s+VGS = [0-9.]+ V;\s+VDS = (?<vds>[0-9.]+) V(?:;\s+Tj = {_N} °C;?)?[\s\S]{{0,20}}\s+)?(?<min>{_N})\s+(?<typ>{_N})\s+(?<max>{_N})\s+(?<unit>nC)",
    "st": rf"Qrr\s+Reverse\s+recovery\s+charge\s+(?<min>{_N})\s+(?<typ>{_N})\s+(?:(?<max>{_N})\s+)?(?<unit>nC)",
    "toshiba": r"trr\nQrr\nTest Condition\n[^\n]*\n[^\n]*(?:\n[^\n]*)?\n[^\n]*IDR = (?<if>[0-9.]+) A,\s+VGS = [0-9.]+ V,?\s+-dIDR/dt = (?<didt>[0-9.]+) A/[uµμ]s\s*\n"
    + r"\n".join(rf"{head}\n(?:{_N}\n)?{_N}\n{_N}\n[0-9.]+\n(?<{name}>[0-9.]+)" for head, name in (("Min", "min"), ("Typ.", "typ"), ("Max", "max")))
    + r"\nUnit\nA\nV\nns\n(?<unit>nC)",
    "diodes": rf"I[FS] = (?<if>[0-9.]+)A, di/dt = {_DIDT}\s*\n(?:Body Diode\s+)?Reverse Recovery Charge\s*\nQRR\s*\n(?<min>{_N})\s*\n(?<typ>{_N})\s*\n(?<max>{_N})\s*\n(?<unit>nC)",
    "vishay": rf"I[FSM]{{1,2}}\s*=\s*(?<if>[0-9.]+)\s*A,?\s+di/dt\s*=\s*{_DIDT},?[\s\S]{{0,60}}\n(?:Body Diode\s+)?Reverse Recovery Charge\s*\nQRR\s*\n(?<min>{_N})\s*\n(?<typ>{_N})\s*\n(?<max>{_N})\s*\n(?<unit>[nμ]C)",
    "epc": rf"QRR\nSource-Drain Recovery Charge\n(?<typ>{_N})",
    "mcc": rf"Qrr\n(?<typ>{_N})\s*\n(?:(?<unit>nC)|IF=\s*(?<if>[0-9.]+)\s*A,di/dt=\s*{_DIDT})",
}
_ASSIGNED = r"[\p{L}/()]+ ?(?:\([^)]*\))?\s*=\s*(?:[-+]?[\d.,]+(?:[eE][-+]?\d+)?\s*(?:[a-zA-Zμ°Ω%]+(?:/[a-zA-Zμ]+)?)?|[\p{L}]+)(?=[,;\s)]|$),?"


def _charges() -> tuple[str, Column]:
    """Pattern of all spellings of a charge, and a map from spelling to its size in nC."""
    known = {s: round(f / 1e-9, 6) for q, s, f, _ in spellings() if q == "charge"}
    return "|".join(sorted(map(re.escape, known), key=lambda s: (-len(s), s))), F.create_map(*[F.lit(x) for kv in known.items() for x in kv])


def recovery_rows(text: Column) -> Column:
    """Struct (vmin, vtyp, vmax, unit, i_f, didt, vr) of a recovery line with its test conditions, null where it has no charge (C20).

    Values are in nC, whatever each cell's unit; a cell without one has the line's, and a line without
    any is in nC. unit is the line's as printed, null if it has none. Of two cells the first is typical
    and the second the maximum, also where the first is a mark for none; a single one is typical.
    """
    units, size = _charges()
    unit = rf"(?:{units})(?![\p{{L}}\p{{N}}/(])"
    figure = r"(?:(?:[<>≤≥~±]|\+/?-|\+)\s?)*-?(?:\d+(?:[.,]\d+)*|[.,]\d+)(?:[eE][-+]?\d+)?"
    cell = rf"(?<![^\s;])(?:{figure}(?: ?{unit})?|\p{{Pd}}{{1,3}}|~|(?i:n/a))(?![^\s;,|])"

    def read(o: Column) -> Column:
        rest = F.regexp_replace(o["line"], _ASSIGNED, " ; ")
        tail = F.regexp_extract(rest, r"(?i)\bq\s?rr\b(.*)$", 1)
        return let(values, line=o["line"], cells=F.slice(F.regexp_extract_all(tail, F.lit(cell), F.lit(0)), 1, 3), unit=F.try_element_at(F.regexp_extract_all(rest, F.lit(rf"(?:(?<=[\d\s(\[~\p{{Pd}}]))({unit})"), F.lit(1)), F.lit(-1)))

    def values(o: Column) -> Column:
        charge = F.transform(o["cells"], lambda c: F.round(number(c) * F.coalesce(F.try_element_at(size, F.coalesce(F.nullif(unit_beside(c), F.lit("")), o["unit"])), F.lit(1.0)), 9))
        n = F.size(o["cells"])
        get = lambda i: F.get(charge, i)
        num = lambda name: number(F.regexp_extract(o["line"], rf"(?i)\b{name}\s*=\s*([-+\d.,]+(?:e[-+]?\d+)?)", 1))
        out = F.struct(get(F.when(n == 3, 0).otherwise(3)).alias("vmin"), get(F.when(n == 3, 1).otherwise(0)).alias("vtyp"), get(F.when(n == 3, 2).otherwise(1)).alias("vmax"), o["unit"].alias("unit"), num("I[FS]D?").alias("i_f"), num("di[FS]?D?/dt").alias("didt"), num("V[RD][DS]?").alias("vr"))
        return F.when(F.exists(charge, lambda x: x.isNotNull()), out)

    return F.when(plain(text).rlike(r"(?i)\bq\s?rr\b"), let(read, line=plain(text)))


def vendor_recovery(lines: DataFrame, page: list[str], order: str, tag: str) -> DataFrame:
    """(order, vmin, vtyp, vmax, unit, i_f, didt, vr) of the charges that a maker's own pattern finds over the lines of a page, at the line each begins on (C20).

    tag is the maker's; a charge that begins within one found before is the same.
    """
    names = ("all", "min", "typ", "max", "unit", "if", "if2", "didt", "didt2", "vds")
    rules = []
    for name, p in RECOVERY_PATTERNS.items():
        whole = rf"(?i)\A[^\n]*?(?<all>{p})"
        at = re.compile(re.sub(r"\(\?<(?=\w)", "(?P<", whole)).groupindex
        rules.append((name, whole, [at.get(n) for n in names]))
    rule = lines.sparkSession.createDataFrame(rules, "rule_tag string, pattern string, groups array<int>")
    w = Window.partitionBy(*page).orderBy(order)
    known = lines.filter(F.col(tag).isin(*RECOVERY_PATTERNS)).withColumn("at", F.row_number().over(w)).withColumn("ahead", F.array_join(F.collect_list("text").over(w.rowsBetween(0, 39)), "\n"))
    hit = known.join(F.broadcast(rule), F.col(tag) == F.col("rule_tag")).filter("ahead rlike pattern")
    hit = hit.select(*page, order, "at", *[F.expr(f"nullif(regexp_extract(ahead, pattern, groups[{i}]), '')").alias(f"g_{n}") for i, n in enumerate(names)])
    hit = hit.withColumn("before", F.max(F.col("at") + F.length(F.regexp_replace("g_all", r"[^\n]", ""))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    num = lambda n: F.col(f"g_{n}").try_cast("double")
    factor = F.when(F.col("g_unit") == "μC", 1e3).otherwise(1.0)
    return hit.filter("before is null or before < at").select(
        order, *[(num(k) * factor).alias(f"v{k}") for k in ("min", "typ", "max")], F.col("g_unit").alias("unit"), F.coalesce(num("if"), num("if2")).alias("i_f"), F.coalesce(num("didt"), num("didt2")).alias("didt"), num("vds").alias("vr")
    )


def json_fields(docs: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, symbol, vmin, vtyp, vmax, unit) of every object with a symbol anywhere in a JSON tree.

    The tree's depth is open, which SQL functions don't walk: one Arrow-batched map.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def number(v):
            try:
                return float(v)
            except (TypeError, ValueError):
                return None

        for pdf in batches:
            out = []
            for key, text in zip(pdf["id"], pdf["text"]):
                try:
                    stack = [json.loads(text)] if text else []
                except ValueError:
                    stack = []
                while stack:
                    x = stack.pop()
                    if isinstance(x, dict):
                        name = next((x[k] for k in ("symbol", "name", "parameter") if isinstance(x.get(k), str)), None)
                        if name and any(k in x for k in ("min", "typ", "max")):
                            out.append((key, name, number(x.get("min")), number(x.get("typ")), number(x.get("max")), x.get("unit") if isinstance(x.get("unit"), str) else None))
                        stack += list(x.values())[::-1]
                    elif isinstance(x, list):
                        stack += x[::-1]
            yield pd.DataFrame(out, columns=["id", "symbol", "vmin", "vtyp", "vmax", "unit"])

    return docs.select(F.col(id_col).alias("id"), F.col(col).alias("text")).mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, symbol string, vmin double, vtyp double, vmax double, unit string").withColumnRenamed("id", id_col)


def header_columns(words: DataFrame, page: list[str]) -> DataFrame:
    """(page, kind, x1, x2) of the columns that header words name.

    words has text, x1, y1, x2, y2. Header words whose rows touch or lie within half a height of each
    other are one header: words of one kind in it are merged to their common range. Where a page has
    several headers, the narrower range is kept for the value columns, the wider one for the others.
    """
    low = F.lower("text")
    kind = F.when(low.rlike(r"^(parameter|symbol|bezeichnung)"), "symbol").when(low.rlike(r"^min"), "min").when(low.rlike(r"^(typ|nom)"), "typ").when(low.rlike(r"^max"), "max").when(low.rlike(r"^(unit|einheit|unit[ée])"), "unit").when(low.rlike(r"^(condition|note|test|bedingung)"), "cond")
    h = words.withColumn("kind", kind).filter("kind is not null")
    w = Window.partitionBy(*page).orderBy("y1", "x1")
    below = F.max("y2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = h.withColumn("__new", F.when(below.isNull() | (F.col("y1") - below > 0.5 * (F.col("y2") - F.col("y1"))), 1).otherwise(0))
    h = h.withColumn("__header", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = h.groupBy(*page, "kind", "__header").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"))
    width = F.col("x2") - F.col("x1")
    best = F.min(F.struct(F.when(F.col("kind").isin("min", "typ", "max"), width).otherwise(-width).alias("w"), "x1", "x2"))
    return merged.groupBy(*page, "kind").agg(best.alias("b")).select(*page, "kind", "b.x1", "b.x2")


def cast_ray(boxes: DataFrame, edge: str, start: float, end: float) -> DataFrame:
    """Boxes whose edge lies in a range, in its order."""
    return boxes.filter(F.col(f"bbox.{edge}").between(start, end)).orderBy(f"bbox.{edge}")


def cells_with_units(cells: DataFrame, tab: list[str], row: str) -> DataFrame:
    """Cell rows with the unit column filled down, then up, within each run between header rows."""
    w = Window.partitionBy(*tab).orderBy(row)
    c = cells.withColumn("part", F.sum(F.when(F.lower("typ") == "typ", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.coalesce(F.lower("typ") != "typ", F.lit(True)))
    inner = Window.partitionBy(*tab, "part").orderBy(row)
    return c.withColumn("unit", F.coalesce("unit", F.last("unit", True).over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.first("unit", True).over(inner.rowsBetween(0, Window.unboundedFollowing)))).drop("part")


def summary_text(row: Column, unit: Column) -> Column:
    """An observation as text, ⎵ for missing."""
    show = lambda c: F.coalesce(F.regexp_replace(F.round(row[c], 3).cast("string"), r"\.0$", ""), F.lit("⎵"))
    return F.concat_ws(" ", show("vmin"), show("vtyp"), show("vmax"), F.coalesce(unit, F.lit("")))

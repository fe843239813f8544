"""Text rules of datasheets: normalisation, conditions, dates, makers, housings, symbol detection, row values."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampmill.operators.observations import field_value

# Condition names as printed (lower case, without blanks) and the canonical symbol.
CONDITION_NAMES = {
    "Vds": ["vds", "vdd", "vr", "vcc", "vbus", "vdr", "vpp"],
    "Vgs": ["vgs", "vge", "ves"],
    "Vgen": ["vgen"],
    "I": ["if", "is", "isd", "idr", "i_f", "i", "geif"],
    "Id": ["id", "ids", "aid", "ic"],
    "di/dt": ["di/dt", "didt", "dif/dt", "dis/dt", "didr/dt", "disd/dt", "dt", "d/dt", "f/dt", "dr/dt"],
    "dv/dt": ["dv/dt"],
    "Tj": ["tj", "tvj", "thj"],
    "Tc": ["tc"],
    "Ta": ["ta"],
    "Tmb": ["tmb"],
    "Rg": ["rg", "rgs"],
    "Rg_on": ["rgon", "rg_on"],
    "Rg_off": ["rgoff", "rg_off"],
    "Rg_ext": ["rgext", "rg_ext", "rg(ext)"],
    "RL": ["rl"],
    "Rgen": ["rgen"],
    "f": ["f", "frequency"],
    "tdead": ["tdead"],
    "Ig": ["ig"],
    "Ls": ["ls"],
}
# Makers by the beginning of their name, the first that fits wins.
MAKER_TAGS = [
    ("infineon", "infineon"), ("infineon", "international rectifier"), ("ti", "texas instruments"), ("ao", "alpha & omega"), ("nxp", "nxp"), ("nxp", "nexperia"),
    ("st", "stmicroelectronics"), ("toshiba", "toshiba"), ("vishay", "vishay"), ("diodes", "diodes inc"), ("diotec", "diotec"), ("rohm", "rohm"), ("good_ark", "good-ark"),
    ("mcc", "micro commercial"), ("mcc", "mcc"), ("renesas", "renesas"), ("ts", "taiwan semiconductor"), ("ts", "taiwansemi"), ("panjit", "panjit"), ("apm", "a power microelectronics"),
    ("jscj", "jiangsu changjing"), ("slkor", "slkor"), ("wuxi", "wuxi unigroup micro"), ("winsok", "winsok"), ("epc_space", "epc space"), ("goford", "goford"),
    ("littelfuse", "littelfuse"), ("littelfuse", "ixys"), ("onsemi", "onsemi"), ("onsemi", "fairchild"), ("analog_power", "analog power"), ("hxy", "hxy mosfet"),
]
# Housing families (makers' and JEDEC names as printed in data sheets) with the beginnings of their compact form, the first that fits wins; compact is upper case without blanks, dashes and dots.
HOUSING_FAMILIES = [
    ("TO-247-4", ["TO2474"]),
    ("TO-247", ["TO247", "MAX247", "PLUS247"]),
    ("TO-3P", ["TO3P", "TO264", "TO268", "D3PAK", "ISOTOP"]),
    ("TO-220", ["TO220", "ITO220", "FULLPAK220"]),
    ("I2PAK", ["I2PAK", "TO262"]),
    ("IPAK", ["IPAK", "TO251"]),
    ("SOT-227", ["SOT227", "MINIBLOC"]),
    ("D2PAK-7", ["D2PAK7", "TO2636", "TO2637", "TO2638", "TO263CA", "TO263CB"]),
    ("D2PAK", ["D2PAK", "TO263", "DDPAK"]),
    ("DPAK-4", ["DPAK4", "TO2524"]),
    ("DPAK", ["DPAK", "TO252", "H2PAK2", "SC63"]),
    ("TOLT", ["TOLT"]),
    ("TOLG", ["TOLG", "MTOLG"]),
    ("TOLL", ["TOLL", "STOLL"]),
    ("LFPAK88", ["LFPAK88", "SOT1235", "DFN8X8", "POWERPAK8X8", "POWERFLAT8X8"]),
    ("CCPAK", ["CCPAK1212", "SOT8000", "SOT8005"]),
    ("DirectFET", ["DIRECTFET"]),
    ("SO-8 (5x6)", ["LFPAK56", "SUPERSO8", "POWERPAKSO8", "POWERFLAT5X6", "PQFN5X6", "DFN5X6", "DFN85X6", "PDFN56", "PDFN5X6", "SOT669", "WSON", "VSONP"]),
    ("DFN 3x3", ["LFPAK33", "PQFN3X3", "PQFN33X33", "DFN3X3", "DFN33X33", "DFN83X3", "DFN833X33", "PDFN33", "POWERPAK1212", "SOT1210"]),
    ("SO-8", ["SO8", "SOP8", "SOIC8"]),
    ("DFN 2x2", ["DFN2X2", "DFN62X2", "POWERFLAT2X2"]),
    ("SOT-23-6", ["SOT236"]),
    ("SOT-223", ["SOT223"]),
    ("SOT-23", ["SOT23", "TSOT23"]),
    ("SOT-89", ["SOT89"]),
    ("TSOP-6", ["TSOP6"]),
    ("SOT-323", ["SOT323"]),
    ("SOT-363", ["SOT343", "SOT353", "SOT363", "SOT763"]),
    ("SOT-523", ["SOT523"]),
]
# Symbols of a parameter line, the first that fits wins, with words that rule it out.
SYMBOL_RULES = [
    ("Rds_on", r"\bR ?DS ?\(?on\)?|on-?state resistance|einschaltwiderstand|r[ée]sistance .{0,8}[ée]tat passant", "thermal"), ("Rg", r"\bR ?G\b|gate resistance|gate-widerstand|r[ée]sistance de grille", ""),
    ("Vpl", r"\bV ?(?:pl|GP|plateau)\b|plateau", ""), ("Vgs_th", r"\bV ?(?:GS\(th\)|TH)\b|threshold voltage|schwellenspannung|tension de seuil", ""), ("Vsd", r"\bV ?(?:SD|F)\b|diode forward|diodenfluss", ""), ("Vds", r"\b(?:V ?\(BR\)DSS|BVDSS|VDSS)\b|breakdown|durchbruch|claquage", ""),
    ("Qrr", r"\bQ ?rr\b|reverse recovery charge|sperrverz|recouvrement inverse", "time"), ("Qgs", r"\bQ ?gs\b|gate-source charge|gate-source-ladung|grille-source", ""), ("Qgd", r"\bQ ?gd\b|gate-drain charge|gate-drain-ladung|grille-drain", ""), ("Qoss", r"\bQ ?oss\b|output charge|ausgangsladung|charge de sortie", ""), ("Qg", r"\bQ ?g(?:\(tot\))?\b|total gate charge|gate-ladung|charge de grille", ""),
    ("Ciss", r"\bC ?iss\b|input capacitance|eingangskapaz|capacit[ée] d'entr", ""), ("Crss", r"\bC ?rss\b|reverse transfer|r[üu]ckwirkung|transfert inverse", ""), ("Coss", r"\bC ?oss\b|output capacitance|ausgangskapaz|capacit[ée] de sortie", ""),
    ("trr", r"\bt ?rr\b|reverse recovery time|sperrverzugszeit", ""), ("tRise", r"\bt ?r\b|rise time|anstiegszeit", ""), ("tFall", r"\bt ?f\b|fall time|abfallzeit", ""), ("IDSS", r"\bI ?DSS\b|zero gate voltage|reststrom", ""), ("ID", r"\bI ?D\b|drain current|drainstrom", ""), ("Tj", r"\bT ?j\b|junction temperature|sperrschichttemp", "resistance"), ("RthJC", r"\bR ?th|thermal resistance|w[äa]rmewiderstand", ""),
]


def condition_map(text: Column) -> Column:
    """Map of canonical condition -> first value assigned in a text such as "VDS=75 V, VGS=0 V" (C9).

    Names are matched without blanks and case, doubled V and l for i in slew rates being misreadings; of
    a longer name its shortest known ending counts. Unknown names are dropped; null and '' give an empty map.
    """
    aliases = [x for sym, names in CONDITION_NAMES.items() for n in names for x in (F.lit(n), F.lit(sym))]
    # longest known ending of each name, tokens dropped from the left
    pattern = r"([A-Za-z][A-Za-z _/()]{0,24}?)\s*=\s*[-+]?[0-9]"
    value = r"[A-Za-z)]\s*=\s*([-+]?[0-9]+(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    names, values = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(value), 1)

    def canonical(name: Column) -> Column:
        tokens = F.split(F.trim(name), r"\s+")
        tails = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.lower(F.array_join(F.slice(tokens, i, F.size(tokens)), "")))
        folded = F.transform(tails, lambda t: F.regexp_replace(F.when(t.startswith("d") & t.endswith("/dt"), F.translate(t, "l", "i")).otherwise(t), "^vv", "v"))
        return F.get(F.array_compact(F.transform(folded, lambda t: F.try_element_at(F.create_map(*aliases), t))), F.lit(0))

    pairs = F.zip_with(names, values, lambda n, v: F.struct(canonical(n).alias("k"), F.translate(v, ",", ".").try_cast("double").alias("v")))
    known = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    # first occurrence wins
    seen = F.aggregate(known, F.array().cast("array<struct<k:string,v:double>>"), lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.coalesce(F.map_from_entries(seen), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))


def condition_text(cells: Column) -> Column:
    """Structured conditions (a map of name to value, or of position to text) as one text for condition_map (C9): numbered cells hold whole assignments."""
    named = lambda k, v: F.when(k.rlike(r"^\d+$"), v).otherwise(F.concat(k, F.lit("="), v))
    return F.array_join(F.transform(F.map_entries(cells), lambda e: named(e["key"], e["value"])), ", ")


def scaled_assignment(text: Column, name: str) -> Column:
    """The value assigned to a name, with SI prefix, as in ID = 250 mA -> 0.25."""
    pattern = rf"(?i)\b{name}\s*=\s*([-+]?[0-9.]+)\s*([mµμunkM]?)(?-i:[VAWΩFHsC]|Hz|Ohm)?"
    prefix = F.regexp_extract(text, pattern, 2)
    factor = F.when(prefix == "m", 1e-3).when(prefix.isin("µ", "μ", "u"), 1e-6).when(prefix == "n", 1e-9).when(prefix == "k", 1e3).when(prefix == "M", 1e6).otherwise(1.0)
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double") * factor


def ensured_charge(text: Column, lo: float, hi: float, absolute: bool = False) -> Column:
    """A charge such as "12 nC", "0.5 uC" or "12" in nC, of which the amount may count; null where it is unreadable or out of lo..hi (C11)."""
    value = F.nullif(F.regexp_extract(text, r"^\s*([-+]?[0-9.]+)\s*(?:[nuμµ]C)?\s*$", 1), F.lit("")).try_cast("double")
    value = F.when(text.rlike(r"[uμµ]C\s*$"), value * 1e3).otherwise(value)
    value = F.abs(value) if absolute else value
    return F.when(value.between(lo, hi), value)


def ensured_resistance(text: Column, lo: float, hi: float) -> Column:
    """A resistance such as "4.9 mOhm" or "0.0049" in Ω (also mΩ, mO and mW for misread ones); null where it is unreadable or out of lo..hi (C11)."""
    value = F.nullif(F.regexp_extract(text, r"^\s*([-+]?[0-9.]+)\s*(?:m(?:Ohm|Ω|O|W))?\s*$", 1), F.lit("")).try_cast("double")
    value = F.when(text.rlike(r"m(?:Ohm|Ω|O|W)\s*$"), value * 1e-3).otherwise(value)
    return F.when(value.between(lo, hi), value)


def sheet_path(mfr: Column, mpn: Column) -> Column:
    """Where the sheet of a part lies (C25): slashes and blanks of its number become underscores; null where maker or number is missing."""
    return F.concat(F.lit("datasheets/"), mfr, F.lit("/"), F.translate(mpn, "/ ", "__"), F.lit(".pdf"))


def maker_tag(name: Column) -> Column:
    """Tag of a maker by the beginning of its name, else the name with blanks as underscores."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.startswith(start), F.lit(tag)) for tag, start in MAKER_TAGS], F.translate(low, " ", "_"))


def housing_family(raw: Column) -> Column:
    """Family of a housing by its compact form; empty marks are null, unknown ones stay as typed."""
    clean = F.trim(F.regexp_replace(F.translate(F.regexp_replace(raw, r"&times;|&#215;", "x"), "×‐‑–—", "x----"), r"\s+", " "))
    compact = F.upper(F.regexp_replace(clean, r"[\s.\-()_]", ""))
    rules = [F.when(reduce(lambda a, b: a | b, [compact.startswith(s) for s in starts]), F.lit(name)) for name, starts in HOUSING_FAMILIES]
    return F.when(F.lower(clean).isin("", "-", "--", "nan", "die form", "bare die", "die"), None).otherwise(F.coalesce(*rules, clean))


_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _month(c: Column) -> Column:
    head = F.initcap(F.left(c, F.lit(3)))
    return F.array_position(F.array(*map(F.lit, _MONTHS)), head).cast("int")


def dates_in(text: Column) -> Column:
    """Dates printed in a text, in the order of their places (C14): 01-Feb-16, August 18, 2014, November 2021, 2022-03-28, 2020.1.9."""
    name = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
    shapes = [
        (rf"(?i)\b(\d{{1,2}})[- ]({name})[- ](\d{{4}}|\d{{2}})\b", lambda g: (g(3), _month(g(2)), g(1))),
        (rf"(?i)\b({name})\.? (\d{{1,2}}), ?(\d{{4}})\b", lambda g: (g(3), _month(g(1)), g(2))),
        (rf"(?i)\b({name})\.? ?(20\d{{2}})\b", lambda g: (g(2), _month(g(1)), None)),
        (r"\b(20\d{2})[-.](\d{1,2})[-.](\d{1,2})\b", lambda g: (g(1), g(2).try_cast("int"), g(3))),
        (r"\b(20\d{2})-(\d{2})\b(?![-.]\d)", lambda g: (g(1), g(2).try_cast("int"), None)),
    ]

    def reader(pattern: str, parts):
        def one(w: Column) -> Column:
            y, m, d = parts(lambda i: F.regexp_extract(w, pattern, i))
            year = y.try_cast("int")
            day = F.lit("1") if d is None else d
            full = F.concat_ws("-", F.when(year < 100, year + 2000).otherwise(year).cast("string"), m.cast("string"), day)
            return F.struct(F.instr(text, w).alias("at"), F.try_to_timestamp(full, F.lit("y-M-d")).cast("date").alias("d"))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), one)

    found = [reader(pattern, parts) for pattern, parts in shapes]
    return F.transform(F.array_sort(F.filter(F.concat(*found), lambda x: x["d"].isNotNull())), lambda x: x["d"])


def metadata_date(c: Column) -> Column:
    """Date of a document's property "D:YYYYMMDD..." (C15)."""
    return F.try_to_timestamp(F.regexp_extract(c, r"^D:(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")


def mentions_part(text: Column, mpn: Column) -> Column:
    """Whether a text of sixty characters or more mentions a part by the first seven characters of its number."""
    plain = lambda c: F.translate(F.regexp_replace(F.lower(c), r"[-_ ]", ""), "o", "0")
    head = F.left(F.regexp_replace(plain(F.regexp_replace(mpn, ",.*$", "")), r"[a-z]$", ""), F.lit(7))
    return F.coalesce((F.length(text) >= 60) & F.contains(plain(text), head), F.lit(False))


def detect_symbol(line: Column) -> Column:
    """The first symbol whose pattern stands in a line of up to 80 characters before its first number, in the rules' order (C17)."""
    head = F.regexp_extract(line, r"^(.*?)(?=\s[-+~<>≤±]*\d|$)", 1)
    rules = [F.when(head.rlike(f"(?i){p}") & (~head.rlike(f"(?i){stop}") if stop else F.lit(True)), F.lit(s)) for s, p, stop in SYMBOL_RULES]
    return F.when(F.length(head) <= 80, F.coalesce(*rules))


def row_values(row: Column) -> Column:
    """Struct (vmin, vtyp, vmax, unit) of a comma-joined table row (C18): three value cells and a unit, two, one with a unit."""
    cell = r"\s*([-+]?\d+(?:\.\d+)?|-{1,3}|~|)\s*"
    unit = r"\s*([munpkµμ]?(?:Ω|Ohm|V|A|C|F|s|W|°C)|mOhm)\s*"
    shapes = [(rf",{cell},{cell},{cell},{unit}(?:,|$)", (1, 2, 3, 4)), (rf",{cell},{cell},{unit}(?:,|$)", (None, 1, 2, 3)), (rf",{cell},{unit}(?:,|$)", (None, 1, None, 2))]
    none = F.lit(None).cast("double")
    tries = []
    for pattern, (a, b, c, u) in shapes:
        get = lambda i, p=pattern: none if i is None else field_value(F.regexp_extract(row, p, i))
        s = F.struct(get(a).alias("vmin"), get(b).alias("vtyp"), get(c).alias("vmax"), F.regexp_extract(row, pattern, u).alias("unit"))
        tries.append(F.when(row.rlike(pattern) & F.coalesce(get(a), get(b), get(c)).isNotNull(), s))
    return F.coalesce(*tries)


def right_strip(values: Column, keep: int) -> Column:
    """An array with at most keep empty cells at its end."""
    full = F.transform(values, lambda v: F.when(F.coalesce(v, F.lit("")) == "", 0).otherwise(1))
    last = F.coalesce(F.array_max(F.transform(full, lambda v, i: F.when(v == 1, i + 1).otherwise(0))), F.lit(0))
    return F.slice(values, F.lit(1), F.least(F.size(values), last + keep))


def ocr_plain(c: Column) -> Column:
    """Characters that recognition takes for bars and quotes put right."""
    return F.trim(F.regexp_replace(F.translate(c, "{},→’‘“”", "||,-''\"\""), r"[ \t\x00-\x08\x0b\x0c]+", " "))


def normalize_text(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, text): compatibility decomposition, plain dashes, blanks and line ends, Latin and Greek letters kept.

    Needs Unicode decomposition, which the JVM functions lack: one Arrow-batched map over two columns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dashes = {ord(c): "-" for c in "‐‑‒–—―−"} | {ord("•"): "*", 0xA0: " "}

        def one(s: str | None) -> str | None:
            if s is None:
                return None
            s = unicodedata.normalize("NFKD", s.translate(dashes).replace("\r\n", "\n"))
            s = "".join(c for c in s if not unicodedata.combining(c))
            return "".join(c if c in "\n≈°μ§Ω" or c.isascii() or "GREEK" in unicodedata.name(c, "") else " " for c in s)

        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "text": [one(s) for s in pdf["text"]]})

    return df.select(F.col(id_col).alias("id"), F.col(col).alias("text")).mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, text string").toDF(id_col, col)

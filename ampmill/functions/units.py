"""Spellings of units and numbers as they stand in datasheets."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# SI prefixes.
PREFIXES = {"f": 1e-15, "p": 1e-12, "n": 1e-9, "μ": 1e-6, "u": 1e-6, "m": 1e-3, "": 1.0, "k": 1e3, "M": 1e6}
WORD_PREFIXES = {"femto": 1e-15, "pico": 1e-12, "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "": 1.0, "kilo": 1e3, "mega": 1e6}
# Symbols that take a prefix, and words, by quantity. On resistances W and (cid:2) are misread Ω.
SYMBOLS = {
    "charge": (["C", "As", "c"], ["coulomb", "coulombs"]),
    "resistance": (["Ω", "Ohm", "ohm", "Ohms", "ohms", "OHM", "R", "W", "(cid:2)"], ["ohm", "ohms"]),
    "voltage": (["V", "v", "Vdc", "VDC", "Volt", "Volts", "volt", "volts"], ["volt", "volts"]),
    "capacitance": (["F", "f"], ["farad", "farads"]),
    "time": (["s", "S", "sec", "Sec", "secs"], ["second", "seconds"]),
    "current": (["A", "a", "Adc", "ADC", "Amp", "Amps", "amps"], ["ampere", "amperes", "amp", "amps"]),
}
# Temperatures as (factor to K steps, offset in °C), thermal resistances as factor to K/W.
TEMPERATURES = {"°C": (1.0, 0.0), "deg C": (1.0, 0.0), "degC": (1.0, 0.0), "C": (1.0, 0.0), "Celsius": (1.0, 0.0), "celsius": (1.0, 0.0), "K": (1.0, -273.15), "kelvin": (1.0, -273.15), "Kelvin": (1.0, -273.15), "°F": (5 / 9, -160 / 9), "deg F": (5 / 9, -160 / 9), "degF": (5 / 9, -160 / 9), "F": (5 / 9, -160 / 9), "Fahrenheit": (5 / 9, -160 / 9)}
THERMAL_TOPS, THERMAL_BOTTOMS = ["K", "°C", "deg C", "degC", "C"], {"W": 1.0, "kW": 1e-3, "mW": 1e3}


def spellings() -> list[tuple[str, str, float, float]]:
    """(quantity, spelling, factor, offset): value in the base unit = printed x factor + offset."""
    out: dict[tuple[str, str], tuple[float, float]] = {}
    for quantity, (symbols, words) in SYMBOLS.items():
        for p, factor in PREFIXES.items():
            for s in symbols:
                out.setdefault((quantity, p + s), (factor, 0.0))
        for p, factor in WORD_PREFIXES.items():
            for w in words:
                out.setdefault((quantity, p + w), (factor, 0.0))
    out |= {("temperature", s): v for s, v in TEMPERATURES.items()}
    for top in THERMAL_TOPS:
        for bottom, factor in THERMAL_BOTTOMS.items():
            for p in ("", "m"):
                out["thermal resistance", f"{p}{top}/{bottom}"] = (factor * PREFIXES[p], 0.0)
    return [(q, s, *v) for (q, s), v in out.items()]


def _alike() -> dict[str, str]:
    """Single characters that print like a plain one: by compatibility decomposition, and the letters of other scripts that occur in units."""
    out = {}
    for a, b in ((0xFF01, 0xFF5E), (0x2160, 0x217F), (0x2126, 0x212A)):
        for c in map(chr, range(a, b + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain != c:
                out[c] = plain
    # Look-alike letters, signs, blanks and dashes.
    out |= dict(zip("АВЕЅІЈКМНОРСТУХԜаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXWaesijopcyxhdqw"))
    out |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορ", "ABEZHIKMNOPTYXavop"))
    out |= {"µ": "μ", "º": "°", "˚": "°", "‐": "-", "‑": "-", "−": "-"}
    blanks = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
    return out | dict.fromkeys(map(chr, blanks), " ")


ALIKE = _alike()
# Code points without visible effect, dropped.
INVISIBLE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10), 0xFEFF)))


def plain(col: Column) -> Column:
    """A string with look-alike characters made plain, unit squares spelled out and blanks squeezed; null stays null."""
    out = F.translate(col, "".join(ALIKE) + INVISIBLE, "".join(ALIKE.values()))
    squares = [chr(c) for c in (*range(0x3380, 0x338D), *range(0x33B0, 0x33BA), 0x33C0, 0x33C1, 0x2103, 0x2109)]
    spelled = col
    for c in squares:
        spelled = F.replace(spelled, F.lit(c), F.lit(unicodedata.normalize("NFKC", c).replace("µ", "μ").replace("Ω", "Ω")))
    # nearly all strings are plain already: only the rest goes through the longer ways
    squeezed = F.trim(F.regexp_replace(out, r"\s+", " "))
    odd = F.trim(F.regexp_replace(F.translate(spelled, "".join(ALIKE) + INVISIBLE, "".join(ALIKE.values())), r"\s+", " "))
    return F.when(col.rlike(r"^[!-~Ω°±μ≤≥—–]*(?: [!-~Ω°±μ≤≥—–]+)*$"), col).when(col.rlike("[㎀-㏁℃℉]"), odd).otherwise(squeezed)


def number(col: Column) -> Column:
    """The first number of a plain string as double, signs before it (<, ±, +-) dropped except a lone minus, null where there is none.

    One to three digits, a comma and exactly three digits are a whole number; any other comma is a decimal comma.
    """
    found = F.regexp_extract(col, r"^(?:[<>≤≥~±\s]|\+/?-|\+)*(-?\s?\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?|-?[.,]\d+(?:[eE][-+]?\d+)?)", 1)
    found = F.regexp_replace(found, r"\s", "")
    whole = F.when(found.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(found, F.lit(","), F.lit(""))).otherwise(F.replace(found, F.lit(","), F.lit(".")))
    return F.when(found != "", whole.try_cast("double"))


def unit_beside(col: Column) -> Column:
    """What stands behind the number of a plain string, '' if nothing does."""
    return F.regexp_extract(col, r"^[<>≤≥~±+\-/\s]*[\d.,]+(?:[eE][-+]?\d+)?\s*(.*)$", 1)

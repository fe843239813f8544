"""Problem 5: one consistent form for text that looks the same but differs in its characters.

Method: every value is mapped to its look-alike key with built-in string functions; the distinct
values are grouped by that key under the accent-sensitive Unicode collation, which alone decides that
combining and single-letter accents, doubled signs and characters without weight fall together; each
class names one deterministic canonical member, which is joined back to the cells, and a cell is changed
if it isn't that member. All of it runs in the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters without visible effect.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︀︎️﻿"
# Blanks that look like a space, hyphens that look like the ASCII one.
BLANKS = "               　"
HYPHENS = "‐‑−"
# Signs that look like °, Ω or μ.
SIGNS = {"º": "°", "˚": "°", "Ω": "Ω", "µ": "μ", "K": "K", "\u212b": "\u00c5"}
# Letters of other scripts that look like Latin ones.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԜԚаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXWQaesijopcyxhdqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορικ", "ABEZHIKMNOPTYXavopik"))
#: Cyrillic letters for Latin ones inside otherwise Cyrillic words.
LATIN_TO_CYRILLIC = {b: a for a, b in CYRILLIC.items() if a in "АВЕКМНОРСТУХаеорсух"}


def _compatible() -> dict[str, str]:
    """Single characters that look like a plain sequence, by compatibility decomposition within blocks whose forms look alike."""
    blocks = [(0xFF01, 0xFF5E), (0xFB00, 0xFB06), (0x2160, 0x217F), (0x3371, 0x33DF), (0x2103, 0x2103), (0x2109, 0x2109), (0x1D400, 0x1D7FF)]
    out = {}
    for a, b in blocks:
        for c in map(chr, range(a, b + 1)):
            plain = unicodedata.normalize("NFKC", c).replace("µ", "μ").replace("Ω", "Ω")
            if plain != c:
                out[c] = plain
    return out


def _composed() -> dict[str, str]:
    """Letter and combining accents -> single letter, wherever such a letter exists."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x400, 0x4FA), *range(0x1E00, 0x1F00)):
        c = chr(code)
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and unicodedata.normalize("NFC", apart) == c:
            out[apart] = c
            if len(apart) > 2:
                out[unicodedata.normalize("NFC", apart[:2]) + apart[2:]] = c
    return out


COMPATIBLE, COMPOSED = _compatible(), _composed()
_ONE = {c: p for c, p in COMPATIBLE.items() if len(p) == 1}
#: Characters that stand for several, those that stand for the most first.
_MANY = dict(sorted(((c, p) for c, p in COMPATIBLE.items() if len(p) > 1), key=lambda x: -len(x[1])))
_ONLY = "".join(_MANY)
#: Ranges in which they lie (a class of ranges is much faster to match than one of single characters).
_NEAR = "[\ufb00-\ufb06\u2160-\u217f\u3371-\u33df\u2103\u2109]"
#: By accent: the letters that compose with it, and what they compose to.
_ACCENTS: dict[str, dict[str, str]] = {}
for _apart, _letter in COMPOSED.items():
    if len(_apart) == 2:
        _ACCENTS.setdefault(_apart[1], {})[_apart[0]] = _letter


def _translate(col: Column, table: dict[str, str]) -> Column:
    return F.translate(col, "".join(table), "".join(table.values()))


def _spell(token: Column) -> Column:
    """A single character of _MANY spelled out: its n-th letters, where it has that many (translate drops the rest)."""
    nth = [F.translate(token, _ONLY, "".join(p[n] for p in _MANY.values() if len(p) > n)) for n in range(max(map(len, _MANY.values())))]
    return F.when((F.length(token) == 1) & (F.instr(F.lit(_ONLY), token) > 0), F.concat(*nth)).otherwise(token)


def _compose(token: Column) -> Column:
    """A letter and its next accent as one letter, where there is one; further accents stay behind it."""
    letter, accent = F.substring(token, 1, 1), F.substring(token, 2, 1)
    made = F.concat(letter, accent)
    for a, letters in _ACCENTS.items():
        made = F.when((accent == a) & (F.instr(F.lit("".join(letters)), letter) > 0), _translate(letter, letters)).otherwise(made)
    return F.when(~token.rlike(r"^\p{L}\p{M}"), token).otherwise(F.concat(made, F.substring(token, 3, 1_000_000)))


def _by_token(col: Column, boundary: str, replace) -> Column:
    return F.array_join(F.transform(F.split(col, boundary, -1), replace), "")


def _spelled(df: DataFrame, name: str) -> DataFrame:
    """Ligatures and the like spelled out, blanks, hyphens and signs plain, the invisible dropped; accents as they are.

    Each step is a column of its own, so that no step's expression is repeated within the next.
    """
    simple = _ONE | dict.fromkeys(BLANKS, " ") | dict.fromkeys(HYPHENS, "-") | SIGNS
    col = F.col(name)
    df = df.withColumn(name, F.when(col.rlike(r"[^\x00-\x7f]"), F.translate(col, "".join(simple) + INVISIBLE, "".join(simple.values()))).otherwise(col))
    return df.withColumn(name, F.when(col.rlike(_NEAR), _by_token(col, f"(?<={_NEAR})|(?={_NEAR})", _spell)).otherwise(col))


def composed(df: DataFrame, name: str, accents: int = 2) -> DataFrame:
    """df with letters and up to so many combining accents as single letters, where such letters exist."""
    col = F.col(name)
    for _ in range(accents):
        df = df.withColumn(name, F.when(col.rlike(r"\p{L}\p{M}"), _by_token(col, r"(?=\p{L}\p{M})|(?<=\p{M})(?!\p{M})", _compose)).otherwise(col))
    return df


def _word(w: Column) -> Column:
    """A word of mixed scripts in Latin letters if its look-alikes allow, else in Cyrillic ones if they do."""
    latin, cyrillic = _translate(w, CYRILLIC | GREEK), _translate(w, LATIN_TO_CYRILLIC)
    return F.when(~w.rlike(MIXED), w).when(~latin.rlike(OTHER) | cyrillic.rlike(r"\p{IsLatin}"), latin).otherwise(cyrillic)


#: A letter that isn't Latin, and a word with letters of more than one script; Ω and μ belong to any.
OTHER = r"[\p{IsCyrillic}\p{IsGreek}&&[^Ωμ]]"
_REST = r"[\p{L}\p{M}]*"
MIXED = "|".join(f"{a}{_REST}{b}" for a, b in ((r"\p{IsLatin}", OTHER), (OTHER, r"\p{IsLatin}"), (r"\p{IsCyrillic}", r"[\p{IsGreek}&&[^Ωμ]]"), (r"[\p{IsGreek}&&[^Ωμ]]", r"\p{IsCyrillic}")))


def with_key(df: DataFrame, value: str, is_unit: Column, name: str = "key") -> DataFrame:
    """df with the look-alike key of a string column: its plain form but for accents, which stay as they are.

    In running text words wholly in one script stay as they are and words of mixed scripts come out in
    one; in a unit only Latin letters, Ω and μ are plain.
    """
    df = _spelled(df.withColumn(name, F.col(value)), name)
    col = F.col(name)
    words = F.split(col, r"(?<=[\p{L}\p{M}])(?![\p{L}\p{M}])|(?<![\p{L}\p{M}])(?=[\p{L}\p{M}])", -1)
    of_text = F.when(col.rlike(MIXED), F.array_join(F.transform(words, _word), "")).otherwise(col)
    return df.withColumn(name, F.when(is_unit, _translate(col, CYRILLIC | GREEK)).otherwise(of_text))


def canonical_cells(cells: DataFrame) -> DataFrame:
    """cells (field, row_id, value) with columns canonical and changed.

    field 'unit' has the rules of units, any other those of running text. Null values stay null and
    unchanged, empty ones are plain; repeated rows are kept. A cell is changed if it isn't its class's
    canonical member, that is, if it has a character that only looks like, or adds nothing visible to,
    the plain form. The canonical member is the shortest spelling of the class, then the first in binary
    order; where every member has an accent of its own character, the spelling with single letters
    stands for the class.

    Cells of printable ASCII pass without a shuffle: two such strings are never equal under the
    collation, and a class that meets one has it as its shortest spelling whether or not it occurs. All
    other distinct values, plain ones too, are combined on the map side, keyed once, written and grouped.
    """
    from ampmill.session import materialize

    settled = F.coalesce(F.col("value").rlike(r"^[ -~]*\z"), F.lit(True))
    plain = cells.filter(settled).select("field", "row_id", "value", F.col("value").alias("canonical"), F.lit(False).alias("changed"))
    others = cells.filter(~settled)
    keyed = with_key(others.select("field", "value").distinct(), "value", F.col("field") == "unit")
    keyed = materialize(composed(keyed.withColumn("spelling", F.col("key")), "spelling"), "look-alikes")
    named = F.collate("key", "UNICODE")
    classes = keyed.groupBy("field", named.alias("class")).agg(F.min(F.struct(F.length("spelling").alias("size"), F.col("spelling"))).getField("spelling").alias("canonical"))
    members = keyed.withColumn("class", named).join(classes, ["field", "class"])
    members = members.select("field", "value", "canonical", (F.col("canonical") != F.col("value")).alias("changed"))
    return plain.unionByName(others.join(members, ["field", "value"]).select("field", "row_id", "value", "canonical", "changed"))


def datasheet_cells(text_rows: DataFrame, extracted_rows: DataFrame) -> DataFrame:
    """The cells (field, row_id, value) of text_rows.text and extracted_rows.unit."""
    return text_rows.select(F.lit("text").alias("field"), F.col("text_row_id").alias("row_id"), F.col("text").alias("value")).unionByName(
        extracted_rows.select(F.lit("unit").alias("field"), "row_id", F.col("unit").alias("value"))
    )

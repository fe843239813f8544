"""Which typed-in values carry information at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that only say that nothing is known, lower-case, without outer blanks, quotes, brackets and full stops.
STAND_INS = [
    "-", "--", "---", "?", "??", "???", "~", "*", "/", "x", "xx", "xxx",
    "n/a", "n.a", "na", "#n/a", "nan", "null", "none", "nil", "void", "empty", "blank",
    "tbd", "t.b.d", "tba", "tbc", "to be defined", "to be determined", "to be confirmed",
    "unknown", "unk", "not known", "unbekannt", "inconnu", "desconocido", "未知", "不详",
    "not specified", "unspecified", "nicht angegeben", "non spécifié", "no especificado", "not available", "not given", "not stated", "no data", "missing",
    "k. a", "k.a", "ka", "keine angabe", "keine angaben", "s/o", "sans objet", "n.d", "nd", "n. d", "s/d", "sin datos", "other", "various", "undefined",
]


def is_stand_in(col: Column) -> Column:
    """True for null, blank and texts that only say that nothing is known; never null."""
    plain = F.lower(F.regexp_replace(col, r"^[\s ​﻿\"'(\[.]+|[\s ​﻿\"')\].]+$", ""))
    plain = F.regexp_replace(plain, "[‐-―−]", "-")
    return F.coalesce((plain == "") | plain.isin(*STAND_INS) | plain.rlike(r"^[-–—_?.~*/\s]*$"), F.lit(True))

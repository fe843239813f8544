"""Manufacturer part numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A packing code behind a base number that ends in digit and letter: two to five letters and a digit.
PACKING = r"(?<=[0-9][A-Z])[-/ ._]?[A-Z]{2,5}[0-9]$"


def base_mpn(col: Column) -> Column:
    """The base part number: upper case, without outer blanks and without a packing code. Null stays null."""
    return F.regexp_replace(F.upper(F.trim(col)), PACKING, "")


def voltage_code(base: Column) -> Column:
    """The voltage class in a base number (two characters between the channel letter and the last letter), '' if it has none."""
    return F.regexp_extract(base, r"[NP]([0-9A-Z][0-9])[A-Z]$", 1)


def series(base: Column) -> Column:
    """The base number up to and with the channel letter, '' if it has no voltage class."""
    return F.regexp_extract(base, r"^(.+[NP])[0-9A-Z][0-9][A-Z]$", 1)

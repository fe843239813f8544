"""Queries of the general training-data problems (1: filling gaps, 4: common units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ampmill.functions.values import STAND_INS
from ampmill.operators import imputation, units
from ampmill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells whose value doesn't come from the record itself, by the provenance of the filling operator."""
    return p1_filled(spark, sf_dir).filter("method <> 'given'").select("part_id", "field")


def p1_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the three fields with its value, whether it was filled, and from what."""
    return imputation.fill_missing(table(spark, sf_dir, "parts"), table(spark, sf_dir, "canon_values"))


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of extracted_rows in its symbol's common unit."""
    return units.to_common_units(table(spark, sf_dir, "extracted_rows"), table(spark, sf_dir, "text_rows"), table(spark, sf_dir, "symbol_units")).select(
        "row_id", "stat", "printed", "written", "source", "common_unit", "value", "milli", "converted"
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers whose unit has another size or zero point than the common one."""
    return p4_values(spark, sf_dir).filter("converted").select("row_id", "stat", "milli")


QUERIES = {f.__name__: f for f in (p1_found, p1_filled, p4_found, p4_values)}

_UNKNOWN = ", ".join("'" + s.replace("'", "''") + "'" for s in STAND_INS)
SQL = {
    "p1_found": f"""
        SELECT part_id, 'Qrr' AS field FROM parts
        WHERE NOT coalesce(NOT isnan(Qrr) AND Qrr >= 0 AND Qrr <= 200e-6 AND (Qrr > 0 OR lower(trim(substrate)) = 'gan'), false)
        UNION ALL SELECT part_id, 'V_pl' FROM parts WHERE NOT coalesce(NOT isnan(V_pl) AND V_pl BETWEEN 1 AND 10, false)
        UNION ALL SELECT part_id, 'housing' FROM parts
        WHERE housing IS NULL OR trim(lower(housing), ' .''"()[]') IN ('', {_UNKNOWN}) OR regexp_full_match(housing, '[-–—_?.~*/\\s]*')""",
}

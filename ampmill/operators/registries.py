"""Curated registries served to parts by their base number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampmill.operators.observations import base_lookup


def served(parts: DataFrame, registry: DataFrame, attributes: list[str]) -> DataFrame:
    """(mfr, mpn, curated, attributes) for every part (mfr, mpn).

    A part whose base number has an entry gets all attributes, null where the entry is silent; one
    without entry gets null throughout, never a guess. registry (mfr, base, attributes) has unique keys.
    """
    hits = base_lookup(parts.select("mfr", "mpn"), registry.select("mfr", "base", *attributes))
    j = parts.select("mfr", "mpn").join(hits, ["mfr", "mpn"], "left")
    return j.select("mfr", "mpn", F.col("base").isNotNull().alias("curated"), *attributes)


def corners(parts: DataFrame, registry: DataFrame) -> DataFrame:
    """Corner bounds as a consumer takes them (H30): how far the threshold lies from its typical value at both corners, and the largest over the typical resistance."""
    s = served(parts, registry, ["vgs_th_min", "vgs_th_typ", "vgs_th_max", "rds_typ", "rds_max"])
    return s.select("*", (F.col("vgs_th_min") - F.col("vgs_th_typ")).alias("vgs_th_shift_min"), (F.col("vgs_th_max") - F.col("vgs_th_typ")).alias("vgs_th_shift_max"), F.try_divide("rds_max", "rds_typ").alias("rds_ratio_max"))


def enriched(parts: DataFrame, sources: dict[str, DataFrame], attributes: list[str], apart: float = 0.2) -> DataFrame:
    """parts with each attribute filled, where it is missing, from the first registry that has it.

    Registries are independent: each is looked up for itself and fills attribute by attribute. disagree
    names "<registry>.<attribute>" where a part's own value differs from the entry's by more than the
    given share. parts has mfr, mpn and the attributes; each registry mfr, base and some of them.
    """
    out, warnings = parts, []
    values: dict[str, list[Column]] = {a: [F.col(a)] for a in attributes}
    for name, registry in sources.items():
        has = [a for a in attributes if a in registry.columns]
        hits = base_lookup(parts.select("mfr", "mpn"), registry.select("mfr", "base", *has)).select("mfr", "mpn", F.struct(*has).alias(f"__{name}"))
        out = out.join(hits, ["mfr", "mpn"], "left")
        for a in has:
            entry = F.col(f"__{name}")[a]
            values[a].append(entry)
            warnings.append(F.when(F.try_divide(F.abs(F.col(a) - entry), F.abs(F.col(a))) > apart, F.lit(f"{name}.{a}")))
    return out.select("mfr", "mpn", *[F.coalesce(*v).alias(a) for a, v in values.items()], F.array_compact(F.array(*warnings)).alias("disagree"))

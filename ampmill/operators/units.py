"""Problem 4: quantities recorded in different units, converted to their symbol's common unit.

Method: the numbers of one device and symbol, in the order they were read, are a hidden Markov model
with the unit as hidden state. What is written (beside the number, in the unit column, in the line) is
evidence for a unit, as is the absence of any unit for the common one; the other emission is how far the
printed logarithm, as each unit would have it, lies from the level of the device, which the other
numbers of the chain and, where they are few, the symbol's numbers on all devices tell; switching units
costs. Viterbi gives the units: the level decides where a unit is written but can't be read, and
overrules a written one that it contradicts by orders of magnitude while another unit fits.

A row whose best unit leads by two switches or more is on the best path in that unit whatever stands
around it. So a chain is cut behind such rows without changing the result, and no device, however hot,
is one task's work.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampmill.functions.bind import let
from ampmill.functions.units import number, plain, spellings, unit_beside
from ampmill.session import materialize

#: Consecutive text_row_ids whose rows of one chain are decoded in one piece; the pieces end where the path is certain.
BLOCK = 65_536
#: Log-probabilities: of a unit other than the written one, of one other than the common where none is written, of a switch.
OTHER_THAN_WRITTEN, OTHER_THAN_COMMON, SWITCH = -7.0, -9.0, -2.0
#: A level's share of strays, and their density per decade; least deviation within a device, in decades.
STRAY, STRAY_DENSITY, LEAST_DEVIATION = 1e-5, 0.1, 0.15
#: Chains with more than one in this many numbers are hot: their levels are broadcast.
HOT_SHARE = 2_000
#: What makes a chain (its hash is the key); what is kept of a row.
CHAIN = ["mfr", "mpn", "symbol"]
KEPT = ["row_id", "symbol", "stat", "printed", "written", "source"]


def _dimension(symbol_units: DataFrame) -> DataFrame:
    """(symbol, common_unit, spelling, factor, offset): to the common unit; a few hundred rows for each symbol list."""
    spark = symbol_units.sparkSession
    known = spark.createDataFrame(spellings(), "quantity string, spelling string, factor double, shift double")
    base = symbol_units.select("symbol", "quantity", plain(F.col("common_unit")).alias("common_unit"))
    own = known.select(F.col("quantity"), F.col("spelling").alias("common_unit"), F.col("factor").alias("f0"), F.col("shift").alias("s0"))
    # powers of ten don't divide exactly: rounded, their quotients are the doubles meant
    ratio = "factor / f0"
    return base.join(own, ["quantity", "common_unit"]).join(known, "quantity").select(
        "symbol", "common_unit", "spelling", F.expr(f"if({ratio} >= 0.5, if(quantity = 'temperature', {ratio}, round({ratio}, 6)), round({ratio}, 20))").alias("factor"), ((F.col("shift") - F.col("s0")) / F.col("f0")).alias("shift")
    )


def _line_unit(line: Column, cond: Column, quantity: Column) -> Column:
    """The last unit of the quantity that stands in a line outside its test conditions, null if none does.

    A unit stands behind a number or a mark for none, in brackets, or behind "in". Each quantity has a
    literal pattern, compiled once.
    """
    rest = F.when(F.length(cond) > 0, F.replace(line, cond, F.lit(" ; "))).otherwise(line)
    rest = F.regexp_replace(rest, r"[\p{L}/()]+ ?(?:\([^)]*\))?\s*=\s*(?:[-+]?[\d.,]+(?:[eE][-+]?\d+)?\s*(?:[a-zA-Zμ°Ω%]+(?:/[a-zA-Zμ]+)?)?|[\p{L}]+)(?=[,;\s)]|$)", " ; ")
    before = r"(?:(?<=\b(?:in|en) )|(?<=[(\[] ?)|(?<=[\d~\p{Pd}] {0,2})|(?<=(?i:n/a) ))"
    by_quantity: dict[str, list[str]] = {}
    for q, spelling, _, _ in spellings():
        if not re.fullmatch("[a-rt-z]", spelling):
            by_quantity.setdefault(q, []).append(spelling)
    found = F.lit(None).cast("array<string>")
    for q, names in by_quantity.items():
        pattern = before + "(" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + r")(?![\p{L}\p{N}/(])"
        found = F.when(quantity == q, F.regexp_extract_all(rest, F.lit(pattern), F.lit(1))).otherwise(found)
    return F.try_element_at(found, F.lit(-1))


def _numbers(rows: DataFrame) -> DataFrame:
    """One row per number in row_values: (row_id, text_row_id, mfr, mpn, symbol, cond, stat, printed, beside, unit).

    Parsing happens inside the generator, so that no filter or projection above it parses again. Marks
    for "no value" have no digit and are gone before anything is parsed.
    """
    stats = F.filter(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"row_values.{s}").alias("raw")) for s in ("min", "typ", "max")]), lambda c: c["raw"].rlike(r"\p{Nd}"))

    def parsed(o: Column) -> Column:
        one = lambda c: let(lambda p: F.struct(c["stat"].alias("stat"), number(p["x"]).alias("printed"), unit_beside(p["x"]).alias("beside"), o["unit"].alias("unit")), x=plain(c["raw"]))
        return F.filter(F.transform(o["stats"], one), lambda n: n["printed"].isNotNull())

    return rows.select("row_id", "text_row_id", "mfr", "mpn", "symbol", "cond", F.inline(let(parsed, stats=stats, unit=plain(F.col("unit")))))


def _evidence(rows: DataFrame, text_rows: DataFrame, symbol_units: DataFrame) -> DataFrame:
    """(row_id, text_row_id, mfr, mpn, symbol, stat, printed, written, source): one row per number."""
    has_own = (F.length("beside") > 0) | F.coalesce(F.length("unit") > 0, F.lit(False))
    own = _numbers(rows).filter(has_own).withColumn("line_unit", F.lit(None).cast("string"))
    # only rows without a unit in its column, which is told without parsing a number, need their line
    unitless = rows.filter(F.coalesce(plain(F.col("unit")), F.lit("")) == "")
    lines = text_rows.select("text_row_id", "text").join(unitless.select("text_row_id"), "text_row_id", "left_semi").select("text_row_id", plain(F.col("text")).alias("line"))
    bare = _numbers(unitless).filter(~has_own).join(lines, "text_row_id", "left").join(F.broadcast(symbol_units.select("symbol", "quantity")), "symbol", "left")
    bare = bare.withColumn("line_unit", _line_unit(F.col("line"), plain(F.col("cond")), F.col("quantity"))).drop("line", "quantity")
    both = own.unionByName(bare)
    written = F.coalesce(F.nullif("beside", F.lit("")), F.nullif("unit", F.lit("")), F.col("line_unit"))
    source = F.when(F.length("beside") > 0, "number").when(F.length("unit") > 0, "column").when(F.col("line_unit").isNotNull(), "line").otherwise("none")
    return both.select("row_id", "text_row_id", "mfr", "mpn", "symbol", "stat", "printed", written.alias("written"), source.alias("source"))


def _levels(e: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(chains, symbols, total) of evidence rows: what is known of the level, in decades of the common unit.

    chains: (chain, n, s, numbers), count and sum of the sure logarithms; symbols: (symbol, mu, between,
    within, uses), the mean over all devices, the variances between and within devices, and how often
    each unit was read; total: the number of rows.
    """
    sure = _decades_of("sure")
    chains = materialize(e.groupBy("chain", "symbol").agg(F.count(sure).alias("n"), F.coalesce(F.sum(sure), F.lit(0.0)).alias("s"), F.coalesce(F.sum(sure * sure), F.lit(0.0)).alias("ss"), F.count(F.lit(1)).alias("numbers")), "unit-levels")
    own = F.coalesce(F.col("ss") - F.try_divide(F.col("s") * F.col("s"), F.col("n")), F.lit(0.0))
    spread = chains.groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(own).alias("own"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("free"), F.sum("numbers").alias("numbers"))
    mu, within = F.try_divide("s", "n"), F.greatest(F.lit(LEAST_DEVIATION**2), F.coalesce(F.try_divide("own", "free"), F.lit(0.0)))
    spread = spread.select("symbol", "numbers", F.coalesce(mu, F.lit(0.0)).alias("mu"), within.alias("within"), F.greatest(F.lit(LEAST_DEVIATION**2), F.coalesce(F.try_divide("ss", "n") - mu * mu, F.lit(9.0)) - within).alias("between"))
    uses = e.filter("read is not null").groupBy("symbol", "read").agg(F.count(F.lit(1)).alias("n")).groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("read", "n"))).alias("uses"))
    # a few dozen rows: symbols by their units
    symbols = materialize(spread.join(uses, "symbol", "left"), "unit-symbols")
    return chains.select("chain", "n", "s", "numbers"), symbols.drop("numbers"), symbols.agg(F.sum("numbers")).first()[0] or 0


def _decades_of(name: str) -> Column:
    """The decimal logarithm of an amount; null for zeros and absurd ones."""
    amount = F.abs(name)
    return F.when((amount > 1e-11) & (amount < 1e11), F.log10(amount))


def _with_level(e: DataFrame, chains: DataFrame, total: int) -> DataFrame:
    """e with its chain's n and s. Hot chains' levels are broadcast (at most HOT_SHARE of them), the others joined by shuffle."""
    hot = F.col("numbers") > max(total // HOT_SHARE, 1_000)
    near = chains.filter(hot).select("chain", F.col("n").alias("hn"), F.col("s").alias("hs"))
    e = e.join(F.broadcast(near), "chain", "left")
    cold = e.filter("hn is null").drop("hn", "hs").join(chains.filter(~hot).drop("numbers"), "chain")
    return e.filter("hn is not null").withColumnsRenamed({"hn": "n", "hs": "s"}).unionByName(cold)


def _weighed(e: DataFrame) -> DataFrame:
    """e with state (of a certain row) or emission (of another): the log-probabilities of what is written and printed under each unit.

    A row is certain if its best unit leads by two switches: leaving that unit for this row alone can't
    pay. Where the printed number lies near the level in the written unit (or, without one, in the common
    unit), that is told without weighing the others, none of which can fit better than a hit of the level.
    """
    n, s = F.col("n") - _decades_of("sure").isNotNull().cast("long"), F.col("s") - F.coalesce(_decades_of("sure"), F.lit(0.0))
    # a row doesn't vouch for itself
    sureness = 1 / F.col("between") + n / F.col("within")
    e = e.withColumn("level", (F.col("mu") / F.col("between") + s / F.col("within")) / sureness).withColumn("variance", F.col("within") + 1 / sureness)
    none, zero = F.col("source") == "none", F.col("printed") == 0
    other = F.when(F.col("read").isNotNull(), OTHER_THAN_WRITTEN).when(none, OTHER_THAN_COMMON)
    far = _decades_of("sure") - F.col("level")
    near = F.coalesce(zero | (far * far / (2 * F.col("variance")) <= -other + 2 * SWITCH), F.lit(False))
    all_uses = F.aggregate(F.map_values(F.coalesce("uses", F.create_map().cast("map<int,bigint>"))), F.lit(0).cast("bigint"), lambda a, b: a + b)

    def emission(u: Column, k: Column) -> Column:
        off = F.log10(F.greatest(F.abs(F.col("printed") * u["factor"] + u["shift"]), F.lit(1e-12))) - F.col("level")
        fits = F.log((1 - STRAY) * F.exp(-off * off / (2 * F.col("variance"))) / F.sqrt(2 * math.pi * F.col("variance")) + STRAY * STRAY_DENSITY)
        often = F.log((F.coalesce(F.try_element_at("uses", k.cast("int")), F.lit(0)) + 0.5) / (all_uses + 0.5 * F.size("units")))
        written = F.when(F.col("read").isNotNull(), F.when(k == F.col("read"), 0.0).otherwise(OTHER_THAN_WRITTEN)).when(none, F.when(u["odd"], OTHER_THAN_COMMON).otherwise(0.0)).otherwise(often)
        return written + F.when(zero, 0.0).otherwise(fits)

    told = near & other.isNotNull()
    e = e.withColumn("state", F.when(told, F.coalesce("read", F.lit(0)))).withColumn("emission", F.when(~told, F.transform("units", emission)))
    top = F.array_max("emission")
    lead = top - F.coalesce(F.array_max(F.filter("emission", lambda x: x < top)), F.lit(-1e9))
    alone = F.size(F.filter("emission", lambda x: x == top)) == 1
    certain = F.coalesce(F.col("emission").isNotNull() & alone & (lead >= -2 * SWITCH), F.lit(False))
    return e.withColumn("state", F.when(certain, (F.array_position("emission", top) - 1).cast("int")).otherwise(F.col("state")))


def _pieces(e: DataFrame) -> DataFrame:
    """e with piece and entry: the block in which a row is decoded, and the certain unit before its first row (null at a chain's start).

    Rows behind their block's last certain row go to the next block that has one.
    """
    e = e.withColumn("block", F.floor(F.col("text_row_id") / BLOCK)).withColumn("at", F.struct("text_row_id", "row_id", "stat"))
    blocks = e.groupBy("chain", "block").agg(F.max(F.when(F.col("state").isNotNull(), F.struct("at", "state"))).alias("last"))
    of = Window.partitionBy("chain").orderBy("block")
    before = F.last("last.state", True).over(of.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(F.col("last").isNotNull(), F.col("block")), True).over(of.rowsBetween(1, Window.unboundedFollowing))
    final = F.max("block").over(Window.partitionBy("chain"))
    cuts = blocks.select("chain", "block", F.col("last.at").alias("until"), F.col("last.state").alias("left"), before.alias("entry"), F.coalesce(after, final).alias("next"))
    e = e.join(cuts, ["chain", "block"])
    moved = (F.col("until").isNull() | (F.col("at") > F.col("until"))) & (F.col("next") > F.col("block"))
    # the certain row before a moved row is its own block's last one, if it has one
    return e.withColumn("piece", F.when(moved, F.col("next")).otherwise(F.col("block"))).withColumn("entry", F.when(moved & F.col("until").isNotNull(), F.col("left")).otherwise(F.col("entry")))


def _viterbi(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by piece and position with their emissions (one list for each row) or certain state -> the decoded states of the others.

    All pieces of a batch advance together: the loop is over positions, not over rows.
    """
    import numpy as np

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        chain, piece = pdf["chain"].to_numpy(), pdf["piece"].to_numpy()
        start = np.flatnonzero(np.r_[True, (chain[1:] != chain[:-1]) | (piece[1:] != piece[:-1])])
        length = np.diff(np.r_[start, len(pdf)])
        known = pdf["known"].to_numpy(dtype=float)
        k = int(pdf["units"].max())
        emission = np.full((len(pdf), k), -np.inf)
        for i, e in enumerate(pdf["emission"]):
            if np.isnan(known[i]):
                emission[i, : len(e)] = e
            else:
                emission[i, int(known[i])] = 0.0
        entry = pdf["entry"].to_numpy(dtype=float)[start]
        come = np.where(np.isnan(entry)[:, None] | (np.arange(k) == entry[:, None]), 0.0, SWITCH)
        score, back = emission.copy(), np.zeros((len(pdf), k), dtype=np.int8)
        score[start] += come
        for t in range(1, length.max(initial=0)):
            at = start[length > t] + t
            before = score[at - 1]
            best = before.argmax(axis=1)
            switch = before[np.arange(len(at)), best][:, None] + SWITCH
            stay = before >= switch
            back[at] = np.where(stay, np.arange(k), best[:, None])
            score[at] = emission[at] + np.where(stay, before, switch)
        state = np.zeros(len(pdf), dtype=np.int64)
        last = start + length - 1
        state[last] = score[last].argmax(axis=1)
        for t in range(length.max(initial=0) - 2, -1, -1):
            at = start[length > t + 1] + t
            state[at] = back[at + 1, state[at + 1]]
        out = pdf[KEPT].copy()
        out["state"] = state
        return out[np.isnan(known)]

    rest: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if rest is None or rest.empty else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        whole = ((pdf["chain"] != pdf["chain"].iloc[-1]) | (pdf["piece"] != pdf["piece"].iloc[-1])).to_numpy()
        rest = pdf[~whole].reset_index(drop=True)
        if whole.any():
            yield decode(pdf[whole].reset_index(drop=True))
    if rest is not None and not rest.empty:
        yield decode(rest)


def to_common_units(extracted_rows: DataFrame, text_rows: DataFrame, symbol_units: DataFrame) -> DataFrame:
    """(row_id, stat, printed, written, source, unit, common_unit, value, milli, converted): one row per number in row_values.

    source says where the unit was written ('number', 'column', 'line' or 'none'); unit is the decoded
    state as "x factor + shift" of the common unit; converted is true where the unit has another size or
    zero point. Cells without a number and symbols without common unit give no row; a missing text line
    counts as a line without unit; null makers and numbers are a chain like any other; repeated rows are
    kept.
    """
    dim = _dimension(symbol_units)
    unit = F.struct(((F.col("factor") != 1) | (F.col("shift") != 0)).alias("odd"), "factor", "shift")
    # the common unit itself sorts first; a few hundred rows for each symbol list
    states = dim.groupBy("symbol").agg(F.first("common_unit").alias("common_unit"), F.array_sort(F.collect_set(unit)).alias("units"))
    read = dim.join(states.select("symbol", "units"), "symbol").select("symbol", F.col("spelling").alias("written"), (F.array_position("units", unit) - 1).cast("int").alias("read"), "factor", "shift")
    read, states = materialize(read, "unit-spellings"), materialize(states, "unit-states")
    e = _evidence(extracted_rows, text_rows, symbol_units).withColumn("chain", F.xxhash64(*CHAIN)).drop("mfr", "mpn")
    e = e.join(F.broadcast(read), ["symbol", "written"], "left").join(F.broadcast(states.select("symbol")), "symbol", "left_semi")
    sure = F.when(F.col("read").isNotNull(), F.col("printed") * F.col("factor") + F.col("shift")).when(F.col("source") == "none", F.col("printed"))
    e = materialize(e.withColumn("sure", sure).drop("factor", "shift"), "unit-evidence")
    chains, symbols, total = _levels(e)
    weighed = _weighed(_with_level(e, chains, total).join(F.broadcast(symbols), "symbol").join(F.broadcast(states), "symbol"))
    weighed = materialize(weighed.select("chain", "text_row_id", *KEPT, "state", F.when(F.col("state").isNull(), F.col("emission")).alias("emission"), F.size("units").alias("units")), "unit-weights")
    # the path runs through the certain rows; it is decoded where there are others
    open_chains = weighed.filter("state is null").select("chain").distinct()
    pieces = _pieces(weighed.join(open_chains, "chain", "left_semi")).withColumnRenamed("state", "known")
    pieces = pieces.repartition("chain", "piece").sortWithinPartitions("chain", "piece", "text_row_id", "row_id", "stat").select("chain", "piece", "entry", *KEPT, "known", "emission", "units")
    decoded = pieces.mapInPandas(_viterbi, "row_id long, symbol string, stat string, printed double, written string, source string, state int")
    both = weighed.filter("state is not null").select(*KEPT, "state").unionByName(decoded).join(F.broadcast(states), "symbol")
    u = F.get("units", F.col("state"))
    value = F.col("printed") * u["factor"] + u["shift"]
    return both.select(
        "row_id", "stat", "printed", "written", "source", F.struct(u["factor"].alias("factor"), u["shift"].alias("shift")).alias("unit"), "common_unit", value.alias("value"), F.round(value * 1000).cast("long").alias("milli"), u["odd"].alias("converted")
    )

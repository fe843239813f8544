"""Curves: interpolation, integrals, axis calibration, tick runs, plateaus, fidelity verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampmill.functions.bind import let


def collapsed_points(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Points with equal x averaged."""
    return points.groupBy(*keys, x).agg(F.avg(y).alias(y))


def as_curve(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """One array of (x, y), ascending, per curve. A curve is one digitised line: some hundred points."""
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("curve"))


def interpolate(curve: Column, at: Column) -> Column:
    """Piecewise linear value; null outside the curve."""

    def between(p: Column) -> Column:
        a, b = p["a"], p["b"]
        return F.when(a["x"] == b["x"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (at - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)))

    return let(between, a=F.array_max(F.filter(curve, lambda p: p["x"] <= at)), b=F.array_min(F.filter(curve, lambda p: p["x"] >= at)))


def integral(curve: Column, lo: Column, hi: Column, points: int = 400) -> Column:
    """Trapezoid integral on an even grid; null where the curve doesn't reach."""

    def values(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: interpolate(s["c"], F.least(s["lo"] + (s["hi"] - s["lo"]) / (points - 1) * i, s["hi"])))

    def total(t: Column) -> Column:
        v = t["v"]
        ends = (F.get(v, F.lit(0)) + F.get(v, F.lit(points - 1))) / 2
        return F.when(F.forall(v, lambda x: x.isNotNull()), (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) - ends) * t["step"])

    return let(total, v=let(values, c=curve, lo=lo, hi=hi), step=(hi - lo) / (points - 1))


def calibrated(pixel: Column, left: Column, right: Column, v0: Column, v1: Column, logarithmic: bool = False) -> Column:
    """Axis value of a pixel by the affine map between two ticks."""
    share = F.try_divide(pixel - left, right - left)
    return F.exp(F.ln(v0) + share * (F.ln(v1) - F.ln(v0))) if logarithmic else v0 + share * (v1 - v0)


def tick_runs(ticks: DataFrame, keys: list[str], position: str, tolerance: float = 0.25) -> DataFrame:
    """Longest run of equally spaced ticks per axis: (keys, first, last, n, spacing).

    A run goes on while the gap is one or two times the running mean within the tolerance; the mean makes
    it stateful, so each axis (some dozen ticks) is one small group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.sort(pdf[position].dropna().unique())
        best, i = (0, None, None, None), 0
        while i < len(p) - 1:
            mean, n, j = p[i + 1] - p[i], 1, i + 1
            while j + 1 < len(p):
                ratio = (p[j + 1] - p[j]) / mean
                k = round(ratio)
                if k not in (1, 2) or abs(ratio - k) > tolerance * k:
                    break
                mean, n, j = (mean * n + (p[j + 1] - p[j]) / k) / (n + 1), n + 1, j + 1
            if j - i + 1 > best[0]:
                best = (j - i + 1, p[i], p[j], mean)
            i = max(j, i + 1)
        row = [*(pdf[k].iloc[0] for k in keys), best[1], best[2], best[0], best[3]]
        return pd.DataFrame([row], columns=[*keys, "first", "last", "n", "spacing"])

    types = ", ".join(f"{k} {ticks.schema[k].dataType.simpleString()}" for k in keys)
    return ticks.groupBy(*keys).applyInPandas(run, f"{types}, first double, last double, n long, spacing double")


def plateaus(points: DataFrame, keys: list[str], x: str, y: str, tolerance: float) -> DataFrame:
    """Longest flat run of each chart: (keys, x_from, x_to, level), approached from below and left upwards where it can be seen.

    A run goes on while y stays within the tolerance of its running median; each chart is one small group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[x, y]).sort_values([x, y])
        xs, ys = pdf[x].to_numpy(), pdf[y].to_numpy()
        best, i = None, 0
        while i < len(xs):
            j = i
            while j + 1 < len(xs) and abs(ys[j + 1] - np.median(ys[i : j + 1])) <= tolerance:
                j += 1
            level = float(np.median(ys[i : j + 1]))
            rising = (i == 0 or ys[i - 1] < level) and (j + 1 == len(ys) or ys[j + 1] > level)
            if j > i and rising and (best is None or xs[j] - xs[i] > best[1] - best[0]):
                best = (float(xs[i]), float(xs[j]), level)
            i = j + 1
        head = [pdf[k].iloc[0] if len(pdf) else None for k in keys]
        return pd.DataFrame([[*head, *(best or (None, None, None))]] if len(pdf) else [], columns=[*keys, "x_from", "x_to", "level"])

    types = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    return points.groupBy(*keys).applyInPandas(run, f"{types}, x_from double, x_to double, level double")


# Bounds in percent between pass and warning, and warning and failure.
VERDICT_BOUNDS = {"cap": (5.0, 15.0), "qoss": (10.0, 25.0), "qrr": (10.0, 30.0)}


def verdict(model: Column, reference: Column, kind: str) -> Column:
    """PASS, WARN, FAIL, or UNVERIFIED where either side is missing or the reference is 0."""
    warn, fail = VERDICT_BOUNDS[kind]
    err = F.abs(F.try_divide(model - reference, reference)) * 100
    return F.when(err.isNull(), "UNVERIFIED").when(err <= warn, "PASS").when(err <= fail, "WARN").otherwise("FAIL")


def verdict_tally(rows: DataFrame, key: str, col: str) -> DataFrame:
    """Counts of the four verdicts per key."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(col) == v).alias(v.lower()) for v in ("PASS", "WARN", "FAIL", "UNVERIFIED")])


def error_stats(errors: DataFrame, col: str) -> DataFrame:
    """One row: n, median (sorted[n // 2]), p90 (sorted[int(0.9 n)]), q1, q3 and mean of an error column."""
    from ampmill.operators.catalogue import nearest_ranks

    shares = {"median": 0.5, "p90": 0.9, "q1": 0.25, "q3": 0.75}
    ranks = nearest_ranks(errors, [col], list(shares.values()))
    # one row each
    return errors.agg(F.count(col).alias("n"), F.avg(col).alias("bias")).crossJoin(F.broadcast(ranks.select(*[F.col("at_share")[i].alias(name) for i, name in enumerate(shares)])))


def words_from_chars(chars: DataFrame, page: list[str]) -> DataFrame:
    """Words from character boxes (x1, y1, x2, y2, c): a gap above a quarter of the height, or another line, begins a word."""
    w = Window.partitionBy(*page, "line").orderBy("x1")
    gap = F.col("x1") - F.lag("x2").over(w)
    first = F.when(gap.isNull() | (gap > 0.25 * (F.col("y2") - F.col("y1"))) | (F.col("c") == " "), 1).otherwise(0)
    n = chars.withColumn("first", first).withColumn("word", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("c <> ' '")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "c"))), lambda s: s["c"]), "")
    return n.groupBy(*page, "line", "word").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), text.alias("text"))


def same_line(rows: DataFrame, page: list[str], tolerance: float = 0.25) -> DataFrame:
    """Adds line: rows whose upper edges differ by less than a share of their height from the row before (D3)."""
    w = Window.partitionBy(*page).orderBy("y1", "x1")
    step = F.abs(F.col("y1") - F.lag("y1").over(w)) / F.greatest(F.col("y2") - F.col("y1"), F.lit(1e-9))
    return rows.withColumn("__new", F.when(step.isNull() | (step >= tolerance), 1).otherwise(0)).withColumn("line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def phrases(words: DataFrame, line: list[str], share: float = 0.5) -> DataFrame:
    """Adds phrase: words of a line whose gap to the one before is at most a share of their height."""
    w = Window.partitionBy(*line).orderBy("x1")
    gap = (F.col("x1") - F.lag("x2").over(w)) / F.greatest(F.col("y2") - F.col("y1"), F.lit(1e-9))
    return words.withColumn("__new", F.when(gap.isNull() | (gap > share), 1).otherwise(0)).withColumn("phrase", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def box_union(*boxes: str) -> Column:
    return F.struct(F.least(*[f"{b}.x1" for b in boxes]).alias("x1"), F.least(*[f"{b}.y1" for b in boxes]).alias("y1"), F.greatest(*[f"{b}.x2" for b in boxes]).alias("x2"), F.greatest(*[f"{b}.y2" for b in boxes]).alias("y2"))


def overlap(a: str, b: str, axis: str, relative: bool = True) -> Column:
    """Common length of two boxes along x or y, as a share of the smaller one or absolute."""
    lo, hi = f"{axis}1", f"{axis}2"
    common = F.greatest(F.lit(0.0), F.least(f"{a}.{hi}", f"{b}.{hi}") - F.greatest(f"{a}.{lo}", f"{b}.{lo}"))
    return F.try_divide(common, F.least(F.col(f"{a}.{hi}") - F.col(f"{a}.{lo}"), F.col(f"{b}.{hi}") - F.col(f"{b}.{lo}"))) if relative else common


def _turned(b: Column, direction: str) -> Column:
    """A box turned so that what lies in the direction lies to its right."""
    flip = lambda a, c: (-F.col(c), -F.col(a))
    x, y = (f"{b}.x1", f"{b}.x2"), (f"{b}.y1", f"{b}.y2")
    along, across = (x, y) if direction in ("right", "left") else (y, x)
    lo, hi = tuple(map(F.col, along)) if direction in ("right", "above") else flip(*along)
    return F.struct(lo.alias("x1"), F.col(across[0]).alias("y1"), hi.alias("x2"), F.col(across[1]).alias("y2"))


def nearest_in_direction(boxes: DataFrame, page: list[str], limit: int = 1, least: float = 0.4, direction: str = "right") -> DataFrame:
    """(page, id, other, gap): the limit nearest boxes to the right, left, above or below with enough common extent across (D6); y grows upwards.

    A join within the page and, against crowded pages, within bands of the extent across. Ties go to the smaller id.
    """
    band = 50.0
    t = boxes.select(*page, "id", _turned("bbox", direction).alias("bbox"))
    b = t.withColumn("band", F.explode(F.sequence(F.floor(F.col("bbox.y1") / band), F.floor(F.col("bbox.y2") / band))))
    a = b.select(*page, "band", F.col("id"), F.col("bbox").alias("a"))
    o = b.select(*page, "band", F.col("id").alias("other"), F.col("bbox").alias("b"))
    j = a.join(o, [*page, "band"]).filter((F.col("id") != F.col("other")) & (F.col("b.x1") >= F.col("a.x2")) & (overlap("a", "b", "y") >= least))
    # a pair meets once in each common band: it is the pair's distance that counts
    pairs = j.groupBy(*page, "id", "other").agg(F.min(F.col("b.x1") - F.col("a.x2")).alias("gap"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*page, "id").orderBy("gap", "other"))).filter(F.col("rank") <= limit).drop("rank")


def table_groups(rows: DataFrame, page: list[str], gap: float = 30.0) -> DataFrame:
    """Adds table_no: a vertical gap of so many points, or a header row, begins a table (D8). rows has bbox and is_header."""
    w = Window.partitionBy(*page).orderBy(F.desc("bbox.y1"), "id")
    step = F.lag("bbox.y1").over(w) - F.col("bbox.y2")
    return rows.withColumn("__new", F.when(step.isNull() | (step >= gap) | F.col("is_header"), 1).otherwise(0)).withColumn("table_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def cells_in_columns(words: DataFrame, headers: DataFrame, page: list[str], least: float = 0.8, rows: DataFrame | None = None) -> DataFrame:
    """(page, word, header), with rows also row: words that lie under a header by its width and, where rows (symbols) are given, beside a row by its height and to its right (D9). y grows upwards."""
    w = words.select(*page, F.col("id").alias("word"), F.col("bbox").alias("w"))
    h = headers.select(*page, F.col("id").alias("header"), F.col("bbox").alias("h"))
    found = w.join(h, page).filter((overlap("w", "h", "x") > least) & (F.col("w.y2") <= F.col("h.y1")))
    if rows is None:
        return found.select(*page, "word", "header")
    r = rows.select(*page, F.col("id").alias("row"), F.col("bbox").alias("r"))
    return found.join(r, page).filter((overlap("w", "r", "y") > least) & (F.col("w.x1") >= F.col("r.x2"))).select(*page, "word", "header", "row")

"""Filling of gaps (1) and common units (4) on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ampmill.functions.units import number, plain
from ampmill.operators import imputation, units

PARTS = "part_id long, mfr string, mpn string, substrate string, housing string, Vds_max double, Qrr double, V_pl double, observed_at timestamp, extra string"
T0 = dt.datetime(2024, 1, 1)


def parts(spark, rows):
    return spark.createDataFrame([(i, "M", m, s, h, v, q, p, T0, "x") for i, (m, s, h, v, q, p) in enumerate(rows)], PARTS)


def test_found_and_filled(spark):
    rows = [("ABC12345N10K", "Si", "TO-220", 100.0, 5e-8, 4.0), ("ABC12345N10KQTR1", "Si", "TO-220", 100.0, 5e-8, 4.0), ("ABC12345N10KTRL3", "Si", None, 100.0, 0.0, 99.9), ("ABC12345N10KSBK9", "GaN", "n.a.", None, 0.0, None), (None, None, " ", None, -1.0, 0.5), ("Q", "Si", "?", 1.0, 1e30, 10.0)]
    got = {(r.part_id, r.field): r for r in imputation.fill_missing(parts(spark, rows)).collect()}
    assert len(got) == 18
    assert {k for k, r in got.items() if not r.found} == {(2, "Qrr"), (2, "V_pl"), (2, "housing"), (3, "V_pl"), (3, "housing"), (4, "Qrr"), (4, "V_pl"), (4, "housing"), (5, "Qrr"), (5, "housing")}
    assert got[2, "Qrr"].number == 5e-8 and got[2, "Qrr"].method == "dependency:series,substrate" and got[2, "housing"].text == "TO-220"
    assert got[3, "Qrr"].method == "given" and not got[3, "Qrr"].filled and got[4, "housing"].method.startswith(("group", "dependency"))


def test_base_number_is_a_dependency(spark):
    rows = [("ABC12345N10K", "Si", "TO-220", 100.0, 5e-8, 4.0), ("ABC12345N10KQTR1", "Si", "TO-220", 100.0, 5e-8, 4.0), ("ABC12345N10KTRL3", "Si", "x", 100.0, None, None)]
    got = {r.field: r for r in imputation.fill_missing(parts(spark, rows)).filter("part_id = 2").collect()}
    assert got["Qrr"].method == got["V_pl"].method == "dependency:base" and got["V_pl"].number == 4.0 and got["V_pl"].confidence == 1.0


def test_nothing_to_fill_from(spark):
    none = imputation.fill_missing(parts(spark, [("A", "Si", None, 1.0, None, None)])).collect()
    assert {r.method for r in none} == {"none"} and not any(r.filled for r in none)
    assert imputation.fill_missing(parts(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("text, want", [("1,234", 1234.0), ("1,23", 1.23), ("0,0012", 0.0012), ("12,345,678", 12345678.0), ("< 0.5", 0.5), ("±3", 3.0), ("+-4,5", 4.5), ("≤10 nC", 10.0), ("1.2E-9 C", 1.2e-9), ("２００", 200.0), ("---", None), ("", None), (None, None), ("n/a", None), ("-5", -5.0)])
def test_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(number(plain(F.col("t")))).collect()[0][0] == want


ROWS = "row_id long, text_row_id long, mfr string, mpn string, symbol string, row_values struct<min: string, typ: string, max: string>, unit string, cond string, page_num int"
CASES = [
    # symbol, value, unit column, line, (milli, converted)
    ("Qrr", "0.5", "μC", "Qrr 0.5", (500_000, True)),
    ("Qrr", "12 nC", "μC", "Qrr", (12_000, False)),
    ("Qrr", "12", None, "Qrr IF=50 A, di/dt=100 A/μs - 12 --- nC", (12_000, False)),
    ("Qrr", "0.012", None, "Charge in μC Qrr IF=50 A 0.012", (12_000, True)),
    ("Qrr", "12", None, "Qrr IF=50 A 12", (12_000, False)),
    ("Qrr", "12", None, None, (12_000, False)),
    ("Rg", "3.3", "W", "Rg", (3_300_000, True)),
    ("Rg", "3.3", "m(cid:2)", "Rg", (3_300, False)),
    ("Tj", "423.15", "K", "Tj", (150_000, True)),
    ("Tj", "302", "°F", "Tj", (150_000, True)),
    ("Vpl", "4500", "mⅤ", "Vpl", (4_500, True)),
    ("IDSS", "1.5", "mA", "x", (1_500_000, True)),
    ("RthJC", "500", "mK/W", "x", (500, True)),
    ("tFall", "0.05", "µs", "x", (50_000, True)),
]


def test_units(spark):
    symbols = [("Qrr", "charge", "nC", ""), ("Rg", "resistance", "mΩ", ""), ("Tj", "temperature", "°C", ""), ("Vpl", "voltage", "V", ""), ("IDSS", "current", "μA", ""), ("RthJC", "thermal resistance", "K/W", ""), ("tFall", "time", "ns", "")]
    su = spark.createDataFrame(symbols, "symbol string, quantity string, common_unit string, title string")
    rows = spark.createDataFrame([(i, i, "m", "p", s, (None, v, "-"), u, None, 0) for i, (s, v, u, _, _) in enumerate(CASES)] + [(99, 99, None, None, "Qrr", None, None, None, 0), (98, 98, "m", "p", "??", ("1", None, None), "V", None, 0)], ROWS)
    lines = spark.createDataFrame([(i, t) for i, (_, _, _, t, _) in enumerate(CASES)], "text_row_id long, text string")
    got = {r.row_id: (r.milli, r.converted) for r in units.to_common_units(rows, lines, su).collect()}
    assert got == {i: c[4] for i, c in enumerate(CASES)}
    assert units.to_common_units(rows.limit(0), lines, su).count() == 0


def test_unreadable_unit_is_decided_by_the_level(spark):
    su = spark.createDataFrame([("Qrr", "charge", "nC", "")], "symbol string, quantity string, common_unit string, title string")
    known = [(i, i, "m", "p", "Qrr", (None, "100", None), "nC", None, 0) for i in range(6)]
    rows = spark.createDataFrame([*known, (6, 6, "m", "p", "Qrr", (None, "0.1", None), "##", None, 0)], ROWS)
    got = {r.row_id: r.milli for r in units.to_common_units(rows, rows.select("text_row_id", F.lit("x").alias("text")), su).collect()}
    assert got[6] == 100_000


def _random_chain(spark, seed, unreadable):
    import random

    rnd = random.Random(seed)
    rows = []
    for i in range(240):
        device, n = rnd.choice("ab"), rnd.choice(["nC", "μC", "pC"])
        level = {"a": 120.0, "b": 30.0}[device] * rnd.choice([0.9, 1.0, 1.1])
        printed = level / {"nC": 1, "μC": 1000, "pC": 0.001}[n]
        rows.append((i, i, "m", device, "Qrr", (None, f"{printed:.6g}", None), "#?" if rnd.random() < unreadable else n, None, 0))
    return spark.createDataFrame(rows, ROWS), rows


def test_converted_numbers_with_unreadable_units(spark):
    su = spark.createDataFrame([("Qrr", "charge", "nC", "")], "symbol string, quantity string, common_unit string, title string")
    df, rows = _random_chain(spark, 4, 0.2)
    lines = df.select("text_row_id", F.lit("x").alias("text"))
    got = {r.row_id: r for r in units.to_common_units(df, lines, su).collect()}
    odd = [r for r in rows if r[6] == "#?" and not 20 <= float(r[5][1]) <= 140]
    right = [r for r in odd if 20 <= got[r[0]].value <= 140]
    assert len(odd) > 20 and len(right) >= 0.9 * len(odd)


def test_level_overrules_a_wrong_unit(spark):
    su = spark.createDataFrame([("Qrr", "charge", "nC", "")], "symbol string, quantity string, common_unit string, title string")
    known = [(i, i, "m", "p", "Qrr", (None, str(100 + i % 3), None), "nC", None, 0) for i in range(12)]
    rows = spark.createDataFrame([*known, (50, 5, "m", "p", "Qrr", (None, "100", None), "C", None, 0)], ROWS)
    got = {r.row_id: r for r in units.to_common_units(rows, rows.select("text_row_id", F.lit("x").alias("text")), su).collect()}
    assert got[50].milli == 100_000 and not got[50].converted and got[50].written == "C"


def test_cuts_change_nothing(spark, monkeypatch):
    su = spark.createDataFrame([("Qrr", "charge", "nC", "")], "symbol string, quantity string, common_unit string, title string")
    df, _ = _random_chain(spark, 9, 0.7)
    lines = df.select("text_row_id", F.lit("x").alias("text"))
    decode = lambda: {(r.row_id, r.stat): r.milli for r in units.to_common_units(df, lines, su).collect()}
    whole = decode()
    monkeypatch.setattr(units, "BLOCK", 3)
    assert decode() == whole


def test_hidden_cells_come_back(spark):
    """Hold-out: a verified dependency gives hidden cells back; p1's rows depend on the dictionaries."""
    rows = [(f"ABC{k:05d}N10{c}", "Si", h, 100.0, q * 1e-9, v) for k, (h, q, v) in enumerate([("TO-220", 10, 3.0), ("DPAK", 20, 4.0), ("TO-252", 30, 5.0)]) for c in ("K", "KQTR1", "KTRL3", "KSBK9")]
    hidden = [(m, s, None, x, None, None) if m.endswith("KTRL3") else (m, s, h, x, q, v) for m, s, h, x, q, v in rows]
    canon = spark.createDataFrame([("housing", "TO-252", ["DPAK"]), ("housing", "TO-220", None)], "kind string, name string, aliases array<string>")
    got = {(r.part_id, r.field): r for r in imputation.fill_missing(parts(spark, hidden), canon).filter("not found").collect()}
    assert len(got) == 9 and {r.method for r in got.values()} == {"dependency:base"}
    assert [got[i, "housing"].text for i in (2, 6, 10)] == ["TO-220", "TO-252", "TO-252"] and [round(got[i, "Qrr"].number * 1e9) for i in (2, 6, 10)] == [10, 20, 30]


def test_large_dictionaries_and_hot_keys(spark, monkeypatch):
    rows = [(f"ABC{k // 2:05d}N10K" + ("QTR1" if k % 2 else ""), "Si", "TO-220", 100.0, None if k % 7 == 0 else (1 + k // 2) * 1e-9, 4.0) for k in range(200)]
    small = {(r.part_id, r.field): r.number for r in imputation.fill_missing(parts(spark, rows)).collect()}
    monkeypatch.setattr(imputation, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(imputation, "HOT_SHARE", 20)
    assert {(r.part_id, r.field): r.number for r in imputation.fill_missing(parts(spark, rows)).collect()} == small


def test_found_cells_come_from_the_provenance(spark):
    """The rows of p1_found aren't a mere predicate: their plan holds the joins with the dictionaries."""
    rows = [("ABC12345N10K", "Si", "TO-220", 100.0, 5e-8, 4.0), ("ABC12345N10KQTR1", "Si", "TO-220", 100.0, 5e-8, 4.0), ("ABC12345N10KTRL3", "Si", "DPAK", 100.0, None, None)]
    found = imputation.fill_missing(parts(spark, rows)).filter("method <> 'given'").select("part_id", "field")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" in plan
    assert {tuple(r) for r in found.collect()} == {(2, "Qrr"), (2, "V_pl")}

"""Small fixtures of the core operators: golden rows, empty tables, nulls, ties."""

import math

import pytest
from pyspark.sql import functions as F

from ampmill.operators import catalogue, curves, loss, magnetics, quality, recovery, specs
from ampmill.operators import observations as ob
from ampmill.operators import text as tx

OBS = "part long, ord long, symbol string, vmin double, vtyp double, vmax double, unit string, cond_vgs double"


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(None, 7.0, None), (None, None, 9.0)], (None, 7.0, 9.0)),
        ([(None, 7.0, None), (None, None, 6.0)], (None, 7.0, None)),
        ([(5.0, 3.0, None)], (5.0, 3.0, None)),
        ([(None, 7.0, None), (8.0, None, None), (None, None, 7.5)], (8.0, 7.0, 7.5)),
    ],
)
def test_fold(spark, rows, want):
    obs = spark.createDataFrame([(1, i, "Vsd", *r, "V", 10.0) for i, r in enumerate(rows)], OBS)
    assert tuple(one(ob.fold(obs, ["part", "symbol"]))[2:]) == want


def test_fold_against_plain_loop(spark):
    import random

    rnd = random.Random(1)
    pick = lambda: None if rnd.random() < 0.5 else float(rnd.randint(1, 9))
    data = [(p, i, s, pick(), pick(), pick(), "nC", None) for p in range(60) for s in ("Qg", "Vpl") for i in range(rnd.randint(1, 6))]
    got = {(r.part, r.symbol): tuple(r)[2:] for r in ob.fold(spark.createDataFrame(data, OBS), ["part", "symbol"]).collect()}
    want = {}
    for p, i, s, *v, _, _ in data:
        state = want.get((p, s))
        if state is None:
            want[p, s] = v[:3]
            continue
        low = 0 if s == "Qg" else -math.inf
        for k in range(3):
            if state[k] is None and v[k] is not None and v[k] >= low:
                state[k] = v[k]
            if state[k] is not None:
                low = state[k]
    assert got == {k: tuple(v) for k, v in want.items()}


def test_fold_of_nothing(spark):
    assert ob.fold(spark.createDataFrame([], OBS), ["part", "symbol"]).count() == 0


@pytest.mark.parametrize("text, want", [("---", None), ("~", None), ("~~", None), ("1,234", 1234.0), ("+- 3", 3.0), ("N/A", None), ("", None), (None, None), ("7.2", 7.2), ("12L", 12.0)])
def test_field_value(spark, text, want):
    assert one(spark.createDataFrame([(text,)], "t string").select(ob.field_value(F.col("t"))))[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("VDS=75 V, VGS=0 V", {"Vds": 75.0, "Vgs": 0.0}),
        ("VR=40 V, IF=50 A, diF/dt=100 A/μs", {"Vds": 40.0, "I": 50.0, "di/dt": 100.0}),
        ("Qrr dIF/dt=100A/μs", {"di/dt": 100.0}),
        ("VV GS = 0 V", {"Vgs": 0.0}),
        ("unknown = 3", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_conditions(spark, text, want):
    assert one(spark.createDataFrame([(text,)], "t string").select(tx.condition_map(F.col("t"))))[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("01-Feb-16, 25-Feb-2019, 11-Dec-2023", ["2016-02-01", "2019-02-25", "2023-12-11"]),
        ("August 18, 2014, July 21,2022", ["2014-08-18", "2022-07-21"]),
        ("November 2021, OCTOBER 2015", ["2021-11-01", "2015-10-01"]),
        (" 2020.1.9 ", ["2020-01-09"]),
        ("no date", []),
    ],
)
def test_dates(spark, text, want):
    assert [str(d) for d in one(spark.createDataFrame([(text,)], "t string").select(tx.dates_in(F.col("t"))))[0]] == want


def test_row_values(spark):
    df = spark.createDataFrame([("RDS(on),Static,---,7.2,9.0,mΩ,VGS = 10V",), ("x",), (None,)], "t string").select(tx.row_values(F.col("t")).alias("v"))
    rows = [r.v for r in df.collect()]
    assert tuple(rows[0]) == (None, 7.2, 9.0, "mΩ") and rows[1] is None and rows[2] is None


def test_right_strip(spark):
    df = spark.createDataFrame([(["a", "", "", ""],), ([],)], "a array<string>").select(tx.right_strip(F.col("a"), 1).alias("r"))
    assert [r.r for r in df.collect()] == [["a", ""], []]


def test_base_lookup(spark):
    parts = spark.createDataFrame([("ao", "BSC040N08NS5ATMA1"), ("ao", "BSC040N08NS5"), ("ao", "BSC040N08NS5XX"), ("ao", "ISC010N04SC"), ("ao", "BSC010N04SC"), (None, "A"), ("ao", None)], "mfr string, mpn string")
    registry = spark.createDataFrame([("AO", "BSC040N08NS5", 1), ("ao", "ISC010N04", 2), ("ao", "BSC010N04", 3)], "mfr string, base string, value int")
    got = {r.mpn: r.value for r in ob.base_lookup(parts, registry).collect()}
    assert got == {"BSC040N08NS5ATMA1": 1, "BSC040N08NS5": 1, "ISC010N04SC": 2}


def test_predicates(spark):
    obs = spark.createDataFrame([(1, 1, "Qg", None, 5.0, None, "nC", 4.5), (1, 2, "Qg", None, 9.0, None, "nC", 10.0), (2, 1, "Vsd", None, None, 1.0, "V", None)], OBS)
    find = lambda *f: {r.part for r in ob.parts_where(obs, "part", list(f)).collect()}
    assert find("Qg.typ > 6") == {1} and find("!Qg") == {2} and find("Qg.n >= 2") == {1} and find("Vsd.typ != 3") == {2}
    assert find("Qg.cond.vgs == 4.5", "Qg.unit ~= /^n/") == {1} and find("Qg.typ == nan") == set()
    for bad in ("1x", "Qg.typ ~= 3", "Qg.unit.x == 3"):
        with pytest.raises(ValueError):
            ob.Predicate.parse(bad)


def test_recovery_round_trip(spark):
    rows = [(285e-9, 44e-9, 100.0, 500e6), (242e-9, 39e-9, 100.0, 500e6), (154e-9, 30e-9, 60.0, 500e6), (327e-9, 44e-9, 100.0, 500e6), (287e-9, 99e-9, 100.0, 100e6), (155.2e-9, 46.3e-9, 50.0, 300e6), (None, 60e-9, 50.0, 100e6), (110e-9, 1e-9, 50.0, 1e6)]
    f = recovery.fit(spark.createDataFrame(rows, "qrr double, trr double, i_f double, didt double"))
    back = recovery.predict(f, i_f="i_f", didt="didt").collect()
    fitted = [r for r in back if r.fault is None]
    assert len(fitted) == 6
    for r in fitted:
        assert r.op_qrr == pytest.approx(r.qrr, rel=1e-6) and r.op_trr == pytest.approx(r.trr, rel=1e-6)
    assert back[6].fault == "input" and back[6].tau is None and back[6].op_qrr is None and back[7].fault == "ramp"


def test_two_point_reproduces_both_rows(spark):
    df = spark.createDataFrame([(50.0, 300e6, 155.2e-9, 46.3e-9, 1000e6, 412.1e-9), (50.0, 300e6, 400e-9, 46.3e-9, 1000e6, 100e-9)], "i_f double, didt double, qrr double, trr double, hi_didt double, hi_qrr double")
    a, b = recovery.best_fit(df.withColumn("qoss", F.lit(None).cast("double"))).collect()
    assert a.method == "2pt" and 0 < a.q0 < 30e-9 and b.method != "2pt" and b.fallback == "no common fit"


def test_parallel_identity_and_null_pass(spark):
    p = loss.operating_point(loss.scenario(spark, vi=24.0, vo=12.0, pin=120.0))
    part = spark.createDataFrame([(1, "Si", 60.0, 2e-3, 80.0, 30e-9, 9e-9, 6e-9, 50e-9, 0.9, 4.5, 800e-12, 1.0), (2, None, None, 2e-3, None, 30e-9, 9e-9, 6e-9, None, None, None, 800e-12, None)], "pk int, substrate string, vds double, rds_on double, id double, qg double, qgs double, qgd double, qrr double, vsd double, vpl double, coss double, rg double")
    rec = specs.with_foms(specs.complete_gate_charge(part))
    assert {r.pk for r in loss.preselect(rec, p).collect()} == {1, 2}
    hs = loss.high_side(rec.crossJoin(p))
    a, b = one(hs.orderBy("pk")), one(loss.in_parallel(hs, F.lit(1)).orderBy("pk"))
    assert (a.p_cl, a.p_sw, a.p_coss) == (b.p_cl, b.p_sw, b.p_coss)
    assert a.p_cl == pytest.approx(0.5 * a.i2_mean * 2e-3 * 1.22)


def test_staged_pairs_scan_order_is_no_larger(spark):
    p = loss.operating_point(loss.scenario(spark))
    rows = [(i, "Si", 100.0, 1e-3 * (1 + i % 7), 200.0, 1e-9 * (20 + 7 * i % 50), 9e-9, 6e-9, 50e-9, 0.9, 4.5, 800e-12, 1.0) for i in range(30)]
    rec = specs.with_foms(specs.complete_gate_charge(spark.createDataFrame(rows, "pk int, substrate string, vds double, rds_on double, id double, qg double, qgs double, qgd double, qrr double, vsd double, vpl double, coss double, rg double")))
    final = {tuple(r)[:3] for r in loss.staged_pairs(rec, p, 30).collect()}
    scan = {tuple(r)[:3] for r in loss.staged_pairs(rec, p, 30, strict=True).collect()}
    assert final and final <= scan


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i), -float(i)) for i in range(100)] + [(None, None)], "a double, b double")
    r = {x.column: x for x in catalogue.nearest_rank(df, ["a", "b"], 0.99).collect()}
    assert (r["a"].at_share, r["a"].n, r["b"].at_share) == (99.0, 100, 0.0)
    assert catalogue.nearest_rank(df.limit(0), ["a"], 0.5).count() == 0


def test_query_spec_round_trip():
    q = catalogue.QuerySpec("ir* 100", ["ti"], ["SO-8"], {"vds": (60.0, None)}, "qg", True)
    back = catalogue.QuerySpec.decode(q.encode(), {"vds": (0, 50)})
    assert (back.text, back.mfrs, back.housings, back.ranges, back.sort, back.descending) == ("ir* 100", ["ti"], ["SO-8"], {"vds": (50, None)}, "qg", True)
    assert catalogue.QuerySpec().encode() == ""


def test_similarity_to_itself_is_zero(spark):
    df = spark.createDataFrame([(1, 60.0, 1e-3, 5.0), (2, 60.0, 1e-3, 5.0), (3, 30.0, 2e-3, None), (4, None, 1e-3, 1.0)], "pk int, vds double, rds_on double, qg double")
    f = {k: catalogue.WEIGHTS[k] for k in ("vds", "rds_on", "qg")}
    got = [tuple(r) for r in catalogue.most_similar(df, "pk", 1, 0, f).collect()]
    assert got == [(2, 0.0)] and catalogue.most_similar(df, "pk", 99, 5, f).count() == 0


def test_interpolation_does_not_extrapolate(spark):
    c = curves.as_curve(spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 100.0)], "k int, x double, y double"), ["k"], "x", "y")
    r = one(c.select(*[curves.interpolate(F.col("curve"), F.lit(x)).alias(f"v{i}") for i, x in enumerate((-1.0, 0.0, 2.5, 10.0, 11.0))], curves.integral(F.col("curve"), F.lit(0.0), F.lit(10.0)).alias("area")))
    assert tuple(r)[:5] == (None, 0.0, 25.0, 100.0, None) and r.area == pytest.approx(500)


def test_tick_runs_and_plateau(spark):
    t = spark.createDataFrame([(1, float(x)) for x in (0, 10, 20, 31, 50, 57)], "k int, p double")
    assert one(curves.tick_runs(t, ["k"], "p")).n >= 4
    y = [1.0, 2, 3, 4, 5, 5, 5.1, 5, 7, 9]
    p = one(curves.plateaus(spark.createDataFrame([(1, float(i), v) for i, v in enumerate(map(float, y))], "k int, x double, y double"), ["k"], "x", "y", 0.2))
    assert (p.x_from, p.x_to) == (4.0, 7.0)


def test_wire(spark):
    df = spark.createDataFrame([(float(a),) for a in range(5, 40)], "awg double").select("awg", magnetics.m_to_awg(magnetics.awg_to_m(F.col("awg"))).alias("b"), (magnetics.skin_depth(F.lit(50.0), 1.72e-8) * 1e3).alias("s"))
    for r in df.collect():
        assert r.b == pytest.approx(r.awg) and r.s == pytest.approx(9.335, rel=1e-4)


def test_upsert_last_wins(spark):
    a = spark.createDataFrame([("x", 9, 1.0), ("y", 1, 2.0)], "k string, t int, v double")
    b = spark.createDataFrame([("x", 2, 5.0), ("x", 3, None)], "k string, t int, v double")
    assert {(r.k, r.v) for r in ob.upsert(a, b, ["k"], "t").collect()} == {("x", None), ("y", 2.0)}


def test_pages(spark):
    s = "page int, line int, x1 double, y1 double, x2 double, y2 double, c string"
    chars = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 10.0, "V"), (1, 1, 5.5, 0.0, 10.0, 10.0, "G"), (1, 1, 20.0, 0.0, 25.0, 10.0, "5")], s)
    assert {r.text for r in curves.words_from_chars(chars, ["page"]).collect()} == {"VG", "5"}
    box = "page int, id int, bbox struct<x1: double, y1: double, x2: double, y2: double>"
    boxes = spark.createDataFrame([(1, i, tuple(map(float, b))) for i, b in ((1, (0, 0, 10, 10)), (2, (20, 1, 30, 11)), (3, (40, 0, 50, 10)), (4, (20, 100, 30, 110)))], box)
    assert {(r.id, r.other) for r in curves.nearest_in_direction(boxes, ["page"]).collect()} == {(1, 2), (2, 3)}


def test_recovery_rows_read_all_cells_and_units(spark):
    lines = {
        "Reverse recovery charge Q rr IF=5 A, di/dt=100 A/μs, VR=40 V - 50 71 nC": (None, 50.0, 71.0, "nC", 5.0),
        "Sperrverzögerungsladung QRR - 0,0177 --- μC": (None, 17.7, None, "μC", None),
        "Reverse recovery charge (nC) Qrr 1,400 22,2 - VR= 48 V": (1400.0, 22.2, None, "nC", None),
        "Reverse recovery charge Qrr 0.05μC 0.06 μC 70 nC": (50.0, 60.0, 70.0, "nC", None),
        "Reverse recovery charge Qrr IF = 5 A": None,
        "Gate charge Qg 5 nC": None,
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, text string").select("id", quality.recovery_rows(F.col("text")).alias("r")).orderBy("id").collect()
    assert [tuple(r.r)[:5] if r.r else None for r in rows] == list(lines.values())


def test_recovery_by_maker(spark):
    page = ["Qrr", "Reverse Recovery Charge", "VDS= 30 V, IF = 20 A,", "di/dt = 300 A/μs", "44", "nC", "IF = 5 A, di/dt = 100 A/µs VR = 10 V", "Qrr Reverse Recovery Charge - 7 8 nC"]
    rows = spark.createDataFrame([(i, t, "p", tag) for k, tag in enumerate(("ti", "onsemi", "other")) for i, t in enumerate(page, 10 * k)], "id int, text string, page string, tag string")
    got = sorted(tuple(r) for r in quality.vendor_recovery(rows, ["page", "tag"], "id", "tag").collect())
    assert got == [(0, None, 44.0, None, "nC", 20.0, 300.0, 30.0), (16, None, 7.0, 8.0, "nC", 5.0, 100.0, None)]


@pytest.mark.parametrize(
    ("symbol", "lines", "want"),
    [
        ("Qgs", ["Gate-source charge Qgs VDS= 48 V, ID= 20 A --- 3.13nC 4.14 nC"], (0, None, 3.13, 4.14, "nC", "VDS= 48 V, ID= 20 A")),
        ("RthJC", ["Thermal resistance, junction to case Rthjc --- 0.26 - deg C/W"], (0, None, 0.26, None, "deg C/W", None)),
        ("Ciss", ["Input capacitance CISS --- 0.0012 μF 1500pF", "Soldering profile: reflow at 2 °C"], (0, None, 1200.0, 1500.0, "pF", None)),
        ("Coss", ["Output capacitance", "Coss", "-", "236", "-"], (3, None, 236.0, None, None, None)),
    ],
)
def test_text_values_by_family(symbol, lines, want):
    assert quality.parse_values(symbol, lines, True)[:6] == want


def test_directions_of_boxes(spark):
    boxes = [(1, (0.0, 0.0, 10.0, 10.0)), (2, (20.0, 1.0, 30.0, 9.0)), (3, (2.0, 15.0, 9.0, 25.0)), (4, (40.0, 0.0, 50.0, 10.0)), (5, None)]
    df = spark.createDataFrame([("p", i, b) for i, b in boxes], "page string, id long, bbox struct<x1: double, y1: double, x2: double, y2: double>")
    near = lambda d: {(r.id, r.other): r.gap for r in curves.nearest_in_direction(df, ["page"], 1, 0.4, d).collect()}
    assert near("right") == {(1, 2): 10.0, (2, 4): 10.0} and near("left") == {(2, 1): 10.0, (4, 2): 10.0}
    assert near("above") == {(1, 3): 5.0} and near("below") == {(3, 1): 5.0}


def test_structured_conditions(spark):
    maps = [({"0": "VDS = 50 V", "1": "ID = 3 A"},), ({"VGS": "10 V", "x": "1"},), (None,), ({},)]
    m = spark.createDataFrame(maps, "m map<string,string>").select(tx.condition_map(tx.condition_text(F.col("m"))).alias("c")).collect()
    assert [r.c for r in m] == [{"Vds": 50.0, "Id": 3.0}, {"Vgs": 10.0}, {}, {}]


def test_export_lines(spark, tmp_path):
    df = spark.createDataFrame([('a "b"', 1234567.0, None), ("c,d", 0.00012345678, 2.0)], "t string, x double, y double")
    catalogue.write_export(df, str(tmp_path / "e"), ["t", "x"], "y")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "e/rows").glob("part-*")))
    assert set(raw.decode().split("\r\n")) == {'"a ""b""",1234600,', '"c,d",1.2346E-4,2', ""}
    assert b"".join(p.read_bytes() for p in (tmp_path / "e/header").glob("part-*")).decode() == "﻿t,x,y\r\n"


def test_header_columns_and_cells(spark):
    word = "page string, text string, x1 double, y1 double, x2 double, y2 double"
    rows = [("p", "Symbol", 0.0, 0.0, 30.0, 8.0), ("p", "Min.", 50.0, 0.0, 60.0, 8.0), ("p", "min", 48.0, 9.0, 58.0, 17.0), ("p", "Max", 70.0, 0.0, 82.0, 8.0), ("p", "Max", 70.0, 100.0, 78.0, 108.0), ("p", "Parameter", 0.0, 100.0, 45.0, 108.0), ("p", "VDS", 0.0, 20.0, 9.0, 28.0), (None, "Typ", 1.0, 0.0, 2.0, 8.0)]
    got = {(r.page, r.kind): (r.x1, r.x2) for r in quality.header_columns(spark.createDataFrame(rows, word), ["page"]).collect()}
    assert got == {("p", "symbol"): (0.0, 45.0), ("p", "min"): (48.0, 60.0), ("p", "max"): (70.0, 78.0), (None, "typ"): (1.0, 2.0)}
    box = "page string, id long, bbox struct<x1: double, y1: double, x2: double, y2: double>"
    headers = spark.createDataFrame([("p", 1, (50.0, 100.0, 60.0, 108.0)), ("p", 2, (70.0, 100.0, 80.0, 108.0))], box)
    symbols = spark.createDataFrame([("p", 7, (0.0, 80.0, 20.0, 88.0)), ("p", 8, (0.0, 60.0, 20.0, 68.0))], box)
    words = spark.createDataFrame([("p", 21, (51.0, 80.0, 59.0, 88.0)), ("p", 22, (71.0, 60.5, 79.0, 68.5)), ("p", 23, (5.0, 60.0, 9.0, 68.0)), ("p", 24, (64.0, 80.0, 68.0, 88.0))], box)
    assert {(r.word, r.header) for r in curves.cells_in_columns(words, headers, ["page"]).collect()} == {(21, 1), (22, 2)}
    assert {(r.word, r.header, r.row) for r in curves.cells_in_columns(words, headers, ["page"], 0.8, symbols).collect()} == {(21, 1, 7), (22, 2, 8)}

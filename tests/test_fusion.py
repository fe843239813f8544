"""The fold with zeros, registries, exponents and helpers on small fixtures."""

from pyspark.sql import functions as F

from ampmill.operators import observations as ob
from ampmill.operators import quality, registries
from ampmill.operators import text as tx


def _reference_fold(rows):
    """The ordered fold in plain Python, row by row."""
    out = list(rows[0])
    for row in rows[1:]:
        lower = 0.0
        for k in range(3):
            if (out[k] is None and row[k] is not None and row[k] >= lower) or out[k] == 0:
                out[k] = row[k]
            if out[k] is not None:
                lower = out[k]
    return tuple(out)


def test_fold_equals_the_row_by_row_one(spark):
    import random

    rnd = random.Random(11)
    pick = lambda: rnd.choice([None, 0.0, 0.0, 1.0, 2.0, 5.0])
    groups = {k: [(pick(), pick(), pick()) for _ in range(rnd.randint(1, 7))] for k in range(400)}
    groups[400], groups[401] = [(5.0, 0.0, None), (None, 3.0, None)], [(None, 0.0, 4.0), (5.0, 0.0, None), (None, 3.0, None)]
    rows = [(k, i, "Qg", *v) for k, g in groups.items() for i, v in enumerate(g)]
    df = spark.createDataFrame(rows, "part long, ord long, symbol string, vmin double, vtyp double, vmax double")
    got = {r.part: (r.vmin, r.vtyp, r.vmax) for r in ob.fold(df, ["part", "symbol"]).collect()}
    assert got == {k: _reference_fold(g) for k, g in groups.items()}


def test_predicates_on_missing_values(spark):
    rows = [(1, "Qg", None, 5.0, None, "nC", "a", 10.0), (2, "Qg", None, None, None, None, None, 10.0)]
    df = spark.createDataFrame(rows, "part long, symbol string, vmin double, vtyp double, vmax double, unit string, source string, cond_vgs double")
    keep = lambda f: sorted(r.part for r in ob.parts_where(df, "part", [f]).collect())
    assert keep("Qg.typ != nan") == [1, 2] and keep("Qg.typ == nan") == [] and keep("Qg.typ") == [1]
    assert keep("Qg.unit != None") == [1, 2] and keep("Qg.unit ~= /C$/") == [1] and keep("Qg.source == a") == [1] and keep("Qg.typ != 5") == [2]


def test_registries(spark):
    parts = spark.createDataFrame([("m", "ISC1NATMA1", 1.0, None), ("m", "OTHER", 2.0, None), ("m", "ISC2N", None, 3.0), (None, "ISC1N", None, None)], "mfr string, mpn string, a double, b double")
    one = spark.createDataFrame([("M", "ISC1N", 1.5, 7.0), ("m", "ISC2N", None, 9.0)], "mfr string, base string, a double, b double")
    two = spark.createDataFrame([("m", "ISC2N", 4.0)], "mfr string, base string, a double")
    got = {(r.mfr, r.mpn): (r.a, r.b, r.disagree) for r in registries.enriched(parts, {"one": one, "two": two}, ["a", "b"]).collect()}
    assert got == {("m", "ISC1NATMA1"): (1.0, 7.0, ["one.a"]), ("m", "OTHER"): (2.0, None, []), ("m", "ISC2N"): (4.0, 3.0, ["one.b"]), (None, "ISC1N"): (None, None, [])}
    s = {r.mpn: (r.curated, r.a, r.b) for r in registries.served(parts.filter("mfr is not null"), one, ["a", "b"]).collect()}
    assert s == {"ISC1NATMA1": (True, 1.5, 7.0), "OTHER": (False, None, None), "ISC2N": (True, None, 9.0)}


def test_exponents(spark):
    rows = [(p, t, ((t + 273.15) / 298.15) ** n) for p, n in ((1, 2.0), (2, 9.0), (3, -1.0)) for t in (50.0, 100.0, 150.0)] + [(4, 25.0, 1.0), (5, None, 2.0), (5, 100.0, -1.0)]
    fits = quality.tau_exponent(spark.createDataFrame(rows, "part long, tj double, qrr_ratio double"), "part")
    got = {r.part: (None if r.n_tau is None else round(r.n_tau, 9), r.points) for r in fits.collect()}
    assert got == {1: (2.0, 3), 2: (5.0, 3), 3: (0.0, 3), 4: (None, 1), 5: (None, 0)}
    parts = spark.createDataFrame([(1, "f"), (4, "f"), (5, "g"), (9, None)], "part long, family string")
    states = {r.part: (round(r.n_tau, 9), r.state) for r in quality.resolved_exponent(parts, fits, "part", "family").collect()}
    assert states == {1: (2.0, "measured"), 4: (2.0, "family"), 5: (1.2, "conservative"), 9: (1.2, "conservative")}


def test_ensured_and_paths(spark):
    df = spark.createDataFrame([("12 nC", "4.9 mOhm", "a/b c"), ("0.5 uC", "0.0049", "x"), ("-3", "4mW", "y"), ("n/a", None, None), ("9999", "9", "z")], "q string, r string, m string")
    got = df.select(tx.ensured_charge(F.col("q"), 0.1, 1000, True).alias("q"), tx.ensured_resistance(F.col("r"), 1e-4, 5).alias("r"), tx.sheet_path(F.lit("m"), F.col("m")).alias("p")).collect()
    assert [r.q for r in got] == [12.0, 500.0, 3.0, None, None] and [r.r and round(r.r, 6) for r in got] == [0.0049, 0.0049, 0.004, None, None]
    assert [r.p for r in got] == ["datasheets/m/a_b_c.pdf", "datasheets/m/x.pdf", "datasheets/m/y.pdf", None, "datasheets/m/z.pdf"]


def test_helpers_without_a_query(spark):
    """Functions that no registered query calls."""
    d = spark.createDataFrame([(1, 100.0, 0.01, 20.0, 5e-9, 3.0, 1e-9), (2, None, 0.01, 20.0, 5e-9, 3.0, 1e-9)], "pk long, vds double, rds_on double, id double, qg double, vpl double, qrr double")
    new = d.withColumn("vds", F.when(F.col("pk") == 2, 60.0))
    got = {r.pk: (r.vds, r.refreshed) for r in quality.refreshed(d, new, "pk").collect()}
    assert got == {1: (100.0, False), 2: (60.0, True)}
    rows = spark.createDataFrame([(2, "b"), (None, "a"), (1, "c"), (2, None)], "x int, y string")
    assert [(r.x, r.y) for r in ob.ordered(rows, ["-x", "y"]).collect()] == [(2, None), (2, "b"), (1, "c"), (None, "a")]
    assert spark.createDataFrame([("a{b},c→“d”",)], "t string").select(tx.ocr_plain(F.col("t"))).first()[0] == 'a|b|,c-"d"'
    assert str(spark.createDataFrame([("D:20160201093000Z",)], "t string").select(tx.metadata_date(F.col("t"))).first()[0]) == "2016-02-01"

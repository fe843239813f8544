"""Problem 1: filling missing values from similar records, with provenance.

Method: functional dependencies (a set of attributes that determines a field) are mined and verified on
the complete records; the dictionaries of the verified ones are left-joined to the gaps; gaps that no
verified dictionary knows get the middle value of the closest group of comparable records, the groups
being ranked by how little their members differ. Every value says how it came.

Plan: one row per record holds the keys of all determinants, as hashes. Mining explodes the keys once
and combines on the map side; which determinants are verified is one row each. For filling, dictionaries
of a checked size and the hot keys (whose number is bounded) are broadcast, so that most gaps are filled
without a shuffle of their keys; only the cold keys of the large dictionaries are joined by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampmill.functions.mpn import base_mpn, series, voltage_code
from ampmill.functions.values import is_stand_in
from ampmill.session import materialize

#: Share of the records (of groups with two order numbers or more) that must agree for a verified dependency.
CONFIDENCE = 0.9
#: Numbers within this ratio of each other agree.
TOLERANCE = 1.05
#: Numbers count as this at least where logarithms are summed; a middle that small is 0.
LEAST = 1e-12
#: One more than the largest unsigned long.
WORD = Decimal(2**64)
#: Dictionaries of up to this many rows (60 bytes each) are broadcast.
BROADCAST_ROWS = 50_000
#: A key of more than one in this many records is hot: there are at most so many hot keys, and they are broadcast.
HOT_SHARE = 2_000

#: Candidate determinants; each is tried for every field that isn't among its attributes.
DETERMINANTS: dict[str, list[str]] = {
    "base": ["base"],
    "series,voltage": ["series", "voltage"],
    "series,substrate": ["series", "substrate"],
    "maker,substrate,voltage,housing": ["maker", "substrate", "voltage", "package"],
    "maker,substrate,voltage": ["maker", "substrate", "voltage"],
    "substrate,threshold": ["substrate", "threshold"],
    "substrate,voltage,resistance": ["substrate", "voltage", "resistance"],
    "substrate,voltage,resistance,charge": ["substrate", "voltage", "resistance", "charge"],
    "substrate,voltage,housing": ["substrate", "voltage", "package"],
    "substrate,voltage,month": ["substrate", "voltage", "month"],
    "substrate,voltage": ["substrate", "voltage"],
    "substrate": ["substrate"],
    "all": [],
}
FIELDS = ("Qrr", "V_pl", "housing")

# Words around a housing's name that say nothing about it.
HOUSING_WORDS = r"\b(tape (and )?reel|reel|tray|package|pkg|case|gehäuse|gehause|gehaeuse|boîtier|boitier|encapsulado|mm)\b"


def usable(field: str) -> Column:
    """Whether a cell holds a usable value; never null.

    Qrr lies in 0..200 µC (0 itself only on GaN), V_pl in 1..10 V; a housing isn't blank and doesn't
    merely say that nothing is known.
    """
    if field == "housing":
        return ~is_stand_in(F.col("housing"))
    if field == "V_pl":
        return F.coalesce(F.col("V_pl").between(1, 10) & ~F.isnan("V_pl"), F.lit(False))
    q = F.col("Qrr")
    return F.coalesce(~F.isnan(q) & (q >= 0) & (q <= 200e-6) & ((q > 0) | (F.lower(F.trim("substrate")) == "gan")), F.lit(False))


def housing_form(col: Column) -> Column:
    """A housing's spelling without case, entities, separators and filler words, so that typed spellings of one name meet."""
    text = F.regexp_replace(F.regexp_replace(F.lower(col), r"&times;|&#215;|×", "x"), r"&(#82\d\d|[nm]dash|minus|nbsp|#160|amp);", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}.]+|\.(?!\d)", " "), HOUSING_WORDS, " ")
    return F.regexp_replace(F.regexp_replace(text, r"\bt0(?=[ \d])", "to"), " ", "")


def _attributes(parts: DataFrame, canon: DataFrame | None) -> DataFrame:
    """One row per record with its usable values, its canonical housing, and its keys; narrow but for the broadcast list."""
    base = base_mpn(F.col("mpn"))
    ranked = lambda name: F.col(name) if name in parts.columns else F.lit(None).cast("double")
    step = lambda name, per: F.round(F.log(F.when(ranked(name) > 0, ranked(name))) * per).cast("string")
    rows = parts.select(
        "part_id",
        *[F.when(usable(f), F.col(f)).alias(f) for f in FIELDS],
        F.xxhash64(F.upper(F.trim("mpn"))).alias("order_number"),
        base.alias("base"),
        F.nullif(series(base), F.lit("")).alias("series"),
        F.coalesce(F.nullif(voltage_code(base), F.lit("")), F.abs(F.round("Vds_max", -1)).cast("string")).alias("voltage"),
        F.lower(F.trim("substrate")).alias("substrate"),
        F.substring(base, 1, 2).alias("maker"),
        F.date_format("observed_at", "yyyy-MM").alias("month"),
        F.round(ranked("Vgs_th"), 1).cast("string").alias("threshold"),
        step("Rds_on_max", 5).alias("resistance"),
        step("Qg", 5).alias("charge"),
    )
    rows = rows.withColumn("form", F.nullif(housing_form(F.col("housing")), F.lit("")))
    if canon is not None:
        # the planner broadcasts the list by its measured size, or shuffles by form
        names = canon.filter("kind = 'housing'").select("name", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias"))
        names = names.groupBy(housing_form(F.col("alias")).alias("form")).agg(F.min("name").alias("name"))
        rows = rows.join(names, "form", "left")
        rows = rows.withColumn("package", F.coalesce("name", "form")).withColumn("spelled", F.coalesce("name", "housing"))
    else:
        rows = rows.withColumn("package", F.col("form")).withColumn("spelled", F.col("housing"))
    keys = []
    for cols in DETERMINANTS.values():
        there = F.lit(True)
        for c in cols:
            there = there & F.col(c).isNotNull()
        keys.append(F.when(there, F.xxhash64(*cols) if cols else F.lit(0).cast("long")))
    return rows.select("part_id", *FIELDS, "package", "spelled", "order_number", F.array(*keys).alias("keys"))


@dataclass
class Dependency:
    """A determinant (its place in DETERMINANTS) as a way to a field, with what mining found."""

    name: str
    det: int
    confidence: float
    verified: bool


def _summed(rows: DataFrame) -> DataFrame:
    """(det, key) with the records' counts, extremes and logarithmic sums of the numbers and the counts of the housings.

    Two combining steps: by housing within the key first, so that a hot key meets in one place only as
    its distinct housings.
    """
    exploded = rows.select("order_number", "Qrr", "V_pl", F.xxhash64("package").alias("package"), F.col("package").isNotNull().alias("named"), F.posexplode("keys").alias("det", "key")).filter("key is not null")

    def numbers(f: str) -> list[Column]:
        log = F.log(F.greatest(F.col(f), F.lit(LEAST)))
        return [F.count(f).alias(f"{f}_n"), F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max"), F.sum(log).alias(f"{f}_s"), F.sum(log * log).alias(f"{f}_ss")]

    # numbers of fixed width alone, so that both steps stay hash aggregations
    fine = exploded.groupBy("det", "key", "named", "package").agg(*numbers("Qrr"), *numbers("V_pl"), F.count(F.lit(1)).alias("records"), F.min("order_number").alias("lo"), F.max("order_number").alias("hi"))
    again = lambda f: [*[F.sum(f"{f}_{x}").alias(f"{f}_{x}") for x in ("n", "s", "ss")], F.min(f"{f}_min").alias(f"{f}_min"), F.max(f"{f}_max").alias(f"{f}_max")]
    # the most frequent housing: its count before its hash, in one decimal
    top = (F.col("records").cast("decimal(18,0)") * F.lit(WORD).cast("decimal(20,0)")).cast("decimal(38,0)") + F.col("package").cast("decimal(20,0)") + F.lit(WORD / 2).cast("decimal(20,0)")
    return fine.groupBy("det", "key").agg(
        *again("Qrr"), *again("V_pl"), F.sum("records").alias("records"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum(F.when(F.col("named"), F.col("records")).otherwise(0)).alias("housing_n"), F.max(F.when(F.col("named"), top.cast("decimal(38,0)"))).alias("top"),
    )


def mine(rows: DataFrame) -> tuple[DataFrame, dict[str, list[Dependency]], dict[int, tuple[int, int]]]:
    """(dictionaries, ways, sizes) from the usable values.

    dictionaries: (det, key, records, Qrr, Qrr_n, V_pl, V_pl_n, housing, housing_n), the numbers being the one
    value on which the records agree, or their middle (geometric mean), the housing
    the most frequent; ways: for each field the determinants in the order in which they are to be asked,
    verified ones by confidence, then groups by the deviation within them; sizes: by determinant,
    the keys and the records that have one.
    """

    def number(f: str) -> Column:
        middle = F.exp(F.try_divide(F.col(f"{f}_s"), F.col(f"{f}_n")))
        return F.when(F.col(f"{f}_min") == F.col(f"{f}_max"), F.col(f"{f}_min")).otherwise(F.when(middle >= 2 * LEAST, middle).otherwise(F.when(F.col(f"{f}_n") > 0, 0.0)))

    unit = F.lit(WORD).cast("decimal(20,0)")
    s = _summed(rows).withColumn("top_n", F.coalesce(F.floor(F.col("top") / unit).cast("long"), F.lit(0)))
    s = s.withColumn("package", (F.col("top") - F.col("top_n").cast("decimal(18,0)") * unit - F.lit(WORD / 2).cast("decimal(20,0)")).cast("long"))
    names = rows.filter("package is not null").groupBy(F.xxhash64("package").alias("package")).agg(F.min("spelled").alias("spelled"))
    s = s.join(names, "package", "left")
    agreeing = {f: F.when(F.col(f"{f}_max") <= F.col(f"{f}_min") * TOLERANCE, F.col(f"{f}_n")).otherwise(0) for f in FIELDS[:2]} | {"housing": F.col("top_n")}
    deviation = {f: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(f"{f}_ss") - F.try_divide(F.col(f"{f}_s") * F.col(f"{f}_s"), F.col(f"{f}_n")), F.col(f"{f}_n") - 1))) for f in FIELDS[:2]} | {"housing": 1 - F.try_divide(F.col("top_n") - 1, F.col("housing_n") - 1)}
    wide = s.select(
        "det", "key", "records",
        *[c for f in FIELDS[:2] for c in (number(f).alias(f), F.col(f"{f}_n"))], F.col("spelled").alias("housing"), "housing_n",
        *[F.struct((F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)) & (F.col(f"{f}_n") > 1)).alias("plural"), agreeing[f].alias("agree"), deviation[f].alias("deviation")).alias(f"{f}_of") for f in FIELDS],
    )
    wide = materialize(wide, "dictionaries")
    stats = []
    for f in FIELDS:
        n, o = F.col(f"{f}_n"), F.col(f"{f}_of")
        many = o["plural"]
        stats += [F.sum(F.when(many, o["agree"])).alias(f"{f}_agree"), F.sum(F.when(many, n)).alias(f"{f}_many"), F.try_divide(F.sum(F.when(many, n * o["deviation"])), F.sum(F.when(many & o["deviation"].isNotNull(), n))).alias(f"{f}_dev"), F.sum(n).alias(f"{f}_all")]
    # one row per determinant: a constant number
    found = wide.groupBy("det").agg(F.count(F.lit(1)).alias("rows"), F.sum("records").alias("records"), *stats).collect()
    names = list(DETERMINANTS)
    ways: dict[str, list[Dependency]] = {}
    for f in FIELDS:
        order = []
        for r in found:
            if not r[f"{f}_all"] or f == "housing" and "package" in DETERMINANTS[names[r.det]]:
                continue
            many = r[f"{f}_many"] or 0
            sure = (r[f"{f}_agree"] or 0) / many if many else 0.0
            verified = sure >= CONFIDENCE and many >= 2
            far = r[f"{f}_dev"] if r[f"{f}_dev"] is not None else float("inf")
            # equal ways: the one with fewer rows first in the list of determinants
            order.append(((not verified, -sure if verified else far, r.det), Dependency(names[r.det], r.det, sure, verified)))
        ways[f] = [d for _, d in sorted(order, key=lambda x: x[0])]
        whole = next((i for i, d in enumerate(ways[f]) if d.name == "all"), len(ways[f]))
        ways[f] = ways[f][: whole + 1]  # that group is there for every record
    return wide.select("det", "key", "records", *[c for f in FIELDS for c in (f, f"{f}_n")]), ways, {r.det: (r.rows, r.records) for r in found}


def _hits(gaps: DataFrame, dictionaries: DataFrame, used: list[int], sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """One row per gap row and determinant that knows it, and one without entry (det -1) for every gap row.

    Dictionaries up to the checked size, and the hot keys of the others (more than one in HOT_SHARE
    records, hence a bounded number), are broadcast; what is left meets the others' cold keys by shuffle.
    """
    entry = F.struct("det", *[c for f in FIELDS for c in (f, f"{f}_n")])
    small = [d for d in used if sizes[d][0] <= BROADCAST_ROWS]
    large = [d for d in used if d not in small]
    keys = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("k")), *[F.struct(F.lit(d).alias("at"), F.col("keys")[d].alias("k")) for d in used])
    asked = gaps.select("row", "part_id", *FIELDS, F.inline(keys)).filter("k is not null")
    few, cold = F.col("det").isin(small), None
    if large:
        hot = F.col("records") > max(n for _, n in sizes.values()) // HOT_SHARE
        cold = dictionaries.filter(F.col("det").isin(large) & ~hot).select(F.col("det").alias("cd"), F.col("key").alias("ck"), entry.alias("entry"))
        few = few | (F.col("det").isin(large) & hot)
    near = dictionaries.filter(few).select(F.col("det").alias("nd"), F.col("key").alias("nk"), entry.alias("entry"))
    met = asked.join(F.broadcast(near), (F.col("at") == F.col("nd")) & (F.col("k") == F.col("nk")), "left").drop("nd", "nk")
    hits = met.filter("entry is not null or at = -1").select("row", "part_id", *FIELDS, "entry")
    if cold is not None:
        rest = met.filter(F.col("entry").isNull() & F.col("at").isin(large)).select("row", "at", "k")
        far = rest.join(cold, (F.col("at") == F.col("cd")) & (F.col("k") == F.col("ck"))).select("row", "entry")
        hits = hits.unionByName(far, allowMissingColumns=True)
    return hits


def fill_missing(parts: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """(part_id, field, found, filled, number, text, method, confidence, support): one row per record and field.

    found is false where the cell held no usable value. filled marks the values that come from other
    records; method is 'given', 'dependency:<attributes>' (verified), 'group:<attributes>' or 'none'
    (no record has the field, as in an empty or quite incomplete table; the value stays null). canon is
    the reference list by whose names and aliases housings are compared (and then written by their name
    there); without it they are compared by spelling. Verified dependencies go first, by confidence,
    then groups by their deviation. Nulls in any attribute exclude the determinants that need it.
    Repeated rows are filled each and count as records, but don't verify a dependency: that takes two
    order numbers. Vgs_th, Rds_on_max and Qg serve where the table has them.
    """
    # the row's number holds once the table is written
    rows = materialize(_attributes(parts, canon).withColumn("row", F.monotonically_increasing_id()), "records")
    dictionaries, ways, sizes = mine(rows)
    nulls = lambda t: F.lit(None).cast(t)
    kinds = {"Qrr": "double", "V_pl": "double", "housing": "string"}

    def cell(f: str, method: Column, confidence: Column, support: Column, filled: Column | None) -> Column:
        there = F.col(f).isNotNull()
        value = F.col(f) if filled is None else F.coalesce(F.col(f), filled)
        return F.struct(
            F.lit(f).alias("field"), there.alias("found"), (F.lit(False) if filled is None else ~there & filled.isNotNull()).alias("filled"),
            (nulls("double") if f == "housing" else value).alias("number"), (value if f == "housing" else nulls("string")).alias("text"),
            F.when(there, "given").otherwise(method).alias("method"), F.when(there, 1.0).otherwise(confidence).alias("confidence"), F.when(there, 1).otherwise(support).cast("long").alias("support"),
        )

    complete = rows.filter(" and ".join(f"{f} is not null" for f in FIELDS))
    given = complete.select("part_id", F.inline(F.array(*[cell(f, F.lit("given"), F.lit(1.0), F.lit(1), None) for f in FIELDS])))
    gaps = rows.filter(" or ".join(f"{f} is null" for f in FIELDS))
    hits = _hits(gaps, dictionaries, sorted({d.det for w in ways.values() for d in w}), sizes)

    def table_of(f: str, what) -> Column:
        return F.create_map(*[F.lit(x) for i, d in enumerate(ways[f]) for x in (d.det, what(i, d))]) if ways[f] else F.create_map(F.lit(-1), F.lit(what(0, None)))

    best = []
    for f in FIELDS:
        place = F.when(F.col(f"entry.{f}").isNotNull(), table_of(f, lambda i, d: i)[F.col("entry.det")])
        best.append(F.min(F.when(place.isNotNull(), F.struct(place.alias("place"), F.col("entry.det").alias("det"), F.col(f"entry.{f}").alias("value"), F.col(f"entry.{f}_n").alias("n")))).alias(f"{f}_best"))
    # a row's hits stand together: they are combined before the shuffle
    chosen = hits.groupBy("row").agg(F.max("part_id").alias("part_id"), *[F.max(f).alias(f) for f in FIELDS], *best)
    cells = []
    for f in FIELDS:
        hit = F.col(f"{f}_best")
        method = F.coalesce(table_of(f, lambda i, d: "none" if d is None else ("dependency:" if d.verified else "group:") + d.name)[hit["det"]], F.lit("none"))
        sure = F.coalesce(table_of(f, lambda i, d: 0.0 if d is None else d.confidence)[hit["det"]], F.lit(0.0))
        cells.append(cell(f, method, sure, F.coalesce(hit["n"], F.lit(0)), hit["value"].cast(kinds[f])))
    return given.unionByName(chosen.select("part_id", F.inline(F.array(*cells))))

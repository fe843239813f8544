"""Problem 3: matching records of two sources that share no key, each match with a confidence.

Method: the rows of each source are grouped to entities (maker and base number; maker and number as
printed). Candidate pairs are found through the numbers' one-letter deletions, so that every pair within
one edit meets. Each pair is a binary variable with prior log-odds from number, maker, electrical and
package agreement. One-to-one factors tie the pairs of one offer (at most one part) and those of one part
(a further offer costs, as some offers are misprints of others); loopy belief propagation exchanges their
messages through joins until they converge, and the marginal match probabilities are reported.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampmill.functions.bind import let
from ampmill.functions.mpn import PACKING
from ampmill.llm.canonical import match_values
from ampmill.session import materialize

# Log-odds of the attributes' agreement. Each is (agrees closely, agrees roughly, differs).
PRIOR = -4.0
#: A sibling differs in voltage class or version alone, which are as often another part as a misprint.
NUMBER = {"same": 8.0, "cut": 3.5, "edit": 2.0, "sibling": -4.0}
#: Of makers the third holds where both are entries of the reference list: then they are surely two.
MAKER = (4.0, -9.0, -25.0)
VOLTAGE = (1.5, -5.0)
RESISTANCE, CURRENT, CHARGE = (2.5, 0.5, -3.5), (1.5, 0.3, -2.5), (1.5, 0.3, -1.5)
PACKAGE = (1.5, -1.5)
#: Log cost of a part's further offer.
FURTHER_OFFER = 1.0
#: From the round after UNDAMPED on, messages keep this share of their former value (sooner they settle faster without). Iteration ends when none moves further than the tolerance; if that isn't reached in the last round, a warning says so.
DAMPING, UNDAMPED, TOLERANCE, ROUNDS = 0.4, 8, 0.02, 60
#: Least probability of a match.
LEAST = 0.5


def _confused(col: Column) -> Column:
    """Letters and digits that are read for each other, as one."""
    return F.translate(col, "OIQ", "010")


def printed_number(col: Column) -> Column:
    """The base number in a part number as a seller prints it: without remarks, maker's name, separators and packing code."""
    text = F.upper(F.trim(F.regexp_replace(col, r"\(.*?\)|\*", " ")))
    text = F.trim(F.regexp_replace(text, r"\s+(ROHS|NEW|PB-FREE|LEAD-FREE|OBSOLETE)\b|-(CT|ND|TR|DKR)$", " "))
    text = F.regexp_replace(text, r"^(\p{L}+\.?\s+)+(?=\S*\d\S*)", "")
    text = F.regexp_replace(text, r"[-/ ._][A-Z]{2,5}[0-9]$", "")
    text = F.regexp_replace(text, r"[^A-Z0-9]", "")
    return F.regexp_replace(text, PACKING.replace("(?<=[0-9][A-Z])", "(?<=[0-9OI][A-Z])"), "")


def _amount(col: Column, scales: dict[str, float]) -> Column:
    """The number at the end of the first part of a printed value, in the base unit of the scales; null where unreadable. Each pattern is matched once a row."""
    head = F.regexp_replace(F.regexp_extract(col, r"^([^@]*)", 1), ",(?=\\d{1,2}\\D)", ".")
    factors = F.create_map(*[F.lit(x) for kv in scales.items() for x in kv])

    def read(s: Column) -> Column:
        value = F.regexp_extract(s["head"], r"([\d.]+)\s*[a-zA-ZμµΩΩ]+[^\d]*$", 1)
        unit = F.regexp_extract(s["head"], r"[\d.]+\s*([a-zA-ZμµΩΩ]+)[^\d]*$", 1)
        return value.try_cast("double") * F.try_element_at(factors, F.lower(F.translate(unit, "µΩ", "μΩ")))

    return let(read, head=head)


def _makers(parts: DataFrame, listings: DataFrame, canon: DataFrame) -> DataFrame:
    """(field, value, key): makers and packages by their entry, those without entry by their plain form; null keys never."""
    typed = [df.select(F.lit(f).alias("field"), F.col(c).alias("value")) for df, f, c in ((parts, "mfr", "mfr"), (listings, "mfr", "mfr"), (parts, "housing", "housing"), (listings, "housing", "package_case"))]
    values = typed[0].unionByName(typed[1]).unionByName(typed[2]).unionByName(typed[3]).filter("value is not null").distinct()
    return match_values(values, canon).select("field", "value", F.when(F.col("canon_id") > 0, F.concat(F.lit("#"), F.col("canon_id"))).otherwise(F.replace("plain", F.lit(" "), F.lit(""))).alias("key")).filter("key <> ''")


def _with_keys(df: DataFrame, keys: DataFrame, maker: str, package: str) -> DataFrame:
    for field, col, out in (("mfr", maker, "maker"), ("housing", package, "package")):
        df = df.join(keys.filter(F.col("field") == field).select(F.col("value").alias(col), F.col("key").alias(out)), col, "left")
    return df


def _deletions(number: Column) -> Column:
    """The number and all strings with one character less: numbers within one edit or swap share one of them."""
    return F.array_distinct(F.concat(F.array(number), F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.concat(F.substr(number, F.lit(1), i - 1), F.substr(number, i + 1)))))


def _ratio(a: str, b: str, close: float, rough: float, score: tuple[float, float, float]) -> Column:
    r = F.greatest(F.col(a), F.col(b)) / F.least(F.col(a), F.col(b))
    return F.when(r.isNull(), 0.0).when(r <= close, score[0]).when(r <= rough, score[1]).otherwise(score[2])


def _median(col: str, low: float, high: float) -> Column:
    v = F.abs(F.col(col))
    return F.percentile_approx(F.when((v >= low) & (v <= high), v), 0.5, F.lit(1000))


def candidate_pairs(parts: DataFrame, listings: DataFrame, canon: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, part rows, listing rows): pairs (l, p, prior) of entities with their prior log-odds, and the rows' entities."""
    keys = materialize(_makers(parts, listings, canon), "maker-keys")
    p_rows = _with_keys(parts.filter("mpn is not null"), keys, "mfr", "housing").withColumn("number", printed_number(F.col("mpn")))
    l_rows = _with_keys(listings.filter("mfr_part is not null"), keys, "mfr", "package_case").withColumn("number", printed_number(F.col("mfr_part")))
    volt = {"v": 1.0, "volts": 1.0, "volt": 1.0, "vdc": 1.0, "kv": 1e3, "mv": 1e-3}
    ohm = {"mω": 1e-3, "mohm": 1e-3, "mohms": 1e-3, "mr": 1e-3, "ohm": 1.0, "ohms": 1.0, "ω": 1.0, "r": 1.0, "uohm": 1e-6}
    coulomb = {"nc": 1e-9, "uc": 1e-6, "μc": 1e-6, "pc": 1e-12}
    l_rows = l_rows.select(
        "listing_id", "number", "maker", "package",
        _amount(F.col("vdss"), volt).alias("v"), _amount(F.col("rds_on"), ohm).alias("r"), _amount(F.col("gate_charge"), coulomb).alias("q"),
        _amount(F.regexp_replace("id_25c", r"\(T[ac]\)\s*$", ""), {"a": 1.0, "ma": 1e-3, "amps": 1.0}).alias("i"),
    ).filter("number <> ''")
    # offers of unnamed makers stay apart by their ratings: one number may be sold by two makers
    sign = F.when(F.col("maker").isNull(), F.concat_ws("|", F.round(F.log("r") * 4), F.round(F.log("q") * 2), F.round("v"), "package")).otherwise("")
    l_rows = l_rows.withColumn("l", F.xxhash64("number", F.coalesce("maker", F.lit("?")), sign))
    p_rows = p_rows.filter("number <> ''").withColumn("p", F.xxhash64("number", F.coalesce("maker", F.lit("?"))))
    l_rows, p_rows = materialize(l_rows, "offers"), materialize(p_rows.select("part_id", "p", "number", "maker", "package", "Vds_max", "Rds_on_max", "Id", "Qg"), "parts")
    offers = l_rows.groupBy("l").agg(*[F.first(c, True).alias(f"l_{c}") for c in ("number", "maker")], F.min("package").alias("l_package"), *[F.percentile_approx(c, 0.5, F.lit(1000)).alias(f"l_{c}") for c in "vrqi"])
    entities = p_rows.groupBy("p").agg(
        *[F.first(c, True).alias(f"p_{c}") for c in ("number", "maker")],
        F.collect_set("package").alias("p_packages"),
        _median("Vds_max", 5, 5000).alias("p_v"), _median("Rds_on_max", 1e-6, 100).alias("p_r"), _median("Qg", 1e-12, 1e-3).alias("p_q"), _median("Id", 0.01, 5000).alias("p_i"),
    )
    met = offers.select("l", F.explode(_deletions(_confused(F.col("l_number")))).alias("d")).join(entities.select("p", F.explode(_deletions(_confused(F.col("p_number")))).alias("d")), "d").select("l", "p").distinct()
    pairs = met.join(offers, "l").join(entities, "p")
    a, b = _confused(F.col("l_number")), _confused(F.col("p_number"))
    number = F.when(a == b, NUMBER["same"]).when(b.startswith(a) | a.startswith(b), NUMBER["cut"]).when((F.length(a) == F.length(b)) & (F.left(a, F.length(a) - 3) == F.left(b, F.length(b) - 3)), NUMBER["sibling"]).otherwise(NUMBER["edit"])
    near = (F.levenshtein("l_maker", "p_maker") <= F.length("p_maker") * 0.3) & ~F.col("l_maker").startswith("#") & ~F.col("p_maker").startswith("#")
    maker = F.when(F.col("l_maker").isNull() | F.col("p_maker").isNull(), 0.0).when((F.col("l_maker") == F.col("p_maker")) | near, MAKER[0]).when(F.col("l_maker").startswith("#") & F.col("p_maker").startswith("#"), MAKER[2]).otherwise(MAKER[1])
    volt_score = F.when(F.col("l_v").isNull() | F.col("p_v").isNull(), 0.0).when(F.abs(F.col("l_v") / F.col("p_v") - 1) < 0.02, VOLTAGE[0]).otherwise(VOLTAGE[1])
    package = F.when(F.col("l_package").isNull() | (F.size("p_packages") == 0), 0.0).when(F.array_contains("p_packages", F.col("l_package")), PACKAGE[0]).otherwise(PACKAGE[1])
    prior = PRIOR + number + maker + volt_score + package + _ratio("l_r", "p_r", 1.04, 1.2, RESISTANCE) + _ratio("l_i", "p_i", 1.04, 1.2, CURRENT) + _ratio("l_q", "p_q", 1.04, 1.3, CHARGE)
    return pairs.select("l", "p", prior.alias("prior")), p_rows, l_rows


def match_probabilities(pairs: DataFrame) -> DataFrame:
    """(l, p, probability) from pairs (l, p, prior) by loopy belief propagation.

    Pairs without a rival need no messages; all others take part, however small their odds. A factor's message to a pair depends on the other pairs only
    through the sum of their odds, so one round is two aggregations and two joins over the contested pairs.
    """
    pairs = materialize(pairs, "pairs")
    rivals = pairs.join(pairs.groupBy("l").agg(F.count(F.lit(1)).alias("nl")), "l").join(pairs.groupBy("p").agg(F.count(F.lit(1)).alias("np")), "p")
    settled = rivals.filter("nl = 1 and np = 1").select("l", "p", F.col("prior").alias("belief"))
    # to_l, to_p: messages of the offer's and of the part's factor to the pair
    state = materialize(rivals.filter("nl > 1 or np > 1").select("l", "p", "prior", F.lit(0.0).alias("to_l"), F.lit(0.0).alias("to_p")), "messages-0")
    odds = lambda x: F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x)))
    for i in range(1, ROUNDS + 1):
        s = state.withColumn("ol", odds(F.col("prior") + F.col("to_p"))).withColumn("op", odds(F.col("prior") + F.col("to_l")))
        s = s.join(s.groupBy("l").agg(F.sum("ol").alias("sl")), "l").join(s.groupBy("p").agg(F.sum("op").alias("sp")), "p")
        rest_l, rest_p = (F.greatest(F.lit(0.0), F.col("sl") - F.col("ol")), F.greatest(F.lit(0.0), F.col("sp") - F.col("op")))
        new_l = -F.log1p(rest_l)
        new_p = F.log1p(rest_p * F.exp(F.lit(-FURTHER_OFFER))) - F.log1p(rest_p)
        kept = DAMPING if i > UNDAMPED else 0.0
        mix = lambda old, new: kept * F.col(old) + (1 - kept) * new
        nxt = s.select("l", "p", "prior", mix("to_l", new_l).alias("to_l"), mix("to_p", new_p).alias("to_p"), F.greatest(F.abs(new_l - F.col("to_l")), F.abs(new_p - F.col("to_p"))).alias("moved"))
        state = materialize(nxt, f"messages-{i}")
        moved = state.agg(F.max("moved")).first()[0] or 0.0
        if moved < TOLERANCE:
            break
    else:
        warnings.warn(f"messages still move by {moved:.3g} after {ROUNDS} rounds", stacklevel=2)
    contested = state.select("l", "p", (F.col("prior") + F.col("to_l") + F.col("to_p")).alias("belief"))
    return settled.unionByName(contested).select("l", "p", (1 / (1 + F.exp(-F.col("belief")))).alias("probability"))


def match_listings(parts: DataFrame, listings: DataFrame, canon: DataFrame) -> DataFrame:
    """(part_id, listing_id, probability) of all rows whose entities match with at least LEAST.

    Rows without a part number match nothing; a null maker, rating or package neither helps nor hurts;
    repeated rows count each; an empty table on either side gives an empty result. Entities, not rows, are
    paired and weighed; rows come in with the last two joins.
    """
    pairs, p_rows, l_rows = candidate_pairs(parts, listings, canon)
    matched = match_probabilities(pairs).filter(F.col("probability") >= LEAST)
    return matched.join(p_rows.select("p", "part_id"), "p").join(l_rows.select("l", "listing_id"), "l").select("part_id", "listing_id", "probability")

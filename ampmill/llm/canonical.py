"""Problem 2: values as people typed them, mapped to the entries of a reference list.

Method (prefix-filter set-similarity join): the tokens of a value are the two-letter pieces of its
plain form; they are ordered by global rarity, only the rare prefix of each set is joined (a pair as
similar as the threshold must share a token there), pairs are dropped by length and position, the
Jaccard similarity of the rest is computed exactly, and the best entry is kept.

Only distinct values take part; cells get their entry back by value. Values are paired with the
reference list alone, never with each other.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampmill.functions.values import is_stand_in
from ampmill.llm.lookalike import composed, with_key
from ampmill.session import materialize

#: Least Jaccard similarity of a match.
THRESHOLD = 0.25
#: Most edits of a match, by letter of the entry's form, for values that aren't just shortened or extended.
EDITS = 0.4

# Words that say nothing about the entry meant.
LEGAL_FORMS = r"\b(gmbh|inc|incorporated|ltd|limited|llc|corp|corporation|co|company|ag|kg|bv|nv|sa|srl|spa|kk|plc|pte|intl|international|shenzhen|hk|group|holding)\b"
HOUSING_WORDS = r"\b(tape( and)? reel|reel|tray|package|pkg|case|gehäuse|gehause|gehaeuse|boîtier|boitier|encapsulado|housing|mm)\b"


def _accents() -> dict[str, str]:
    """Accented letters of Latin alphabets -> their base letter."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            out[chr(code)] = base[0]
    return out


def plain_form(df: DataFrame, value: str, field: str, name: str) -> DataFrame:
    """df with the plain form of a value: look-alikes folded, entities resolved, lower case without accents, filler words and separators.

    In housings, digits count: a zero for the letter o is put right where no digit stands before it.
    """
    entities = F.regexp_replace(F.regexp_replace(F.col(value), r"&times;|&#215;|×", "x"), r"&#82(08|09|11|12);|&ndash;|&mdash;|&minus;|[–—]", "-")
    entities = F.regexp_replace(F.regexp_replace(entities, r"&nbsp;|&#160;", " "), r"&amp;", "&")
    df = composed(with_key(df.withColumn(name, entities), name, F.lit(True), name), name, 1)
    accents = _accents()
    col = F.lower(F.translate(F.col(name), "".join(accents), "".join(accents.values())))
    col = F.regexp_replace(col, r"(?<![a-z])[uμ](?=electr)", "micro")
    col = F.regexp_replace(F.regexp_replace(F.translate(col, "_", " "), r"(?<=\b[a-z])\.(?=[a-z]\b)", ""), r"[^\p{L}\p{N}.]+|\.(?!\d)", " ")
    df = df.withColumn(name, F.trim(col))
    col = F.col(name)
    housing = F.regexp_replace(F.regexp_replace(col, HOUSING_WORDS, " "), r"\b(to|so|sot|t|s)\s*0(?=\D|$)|^t0(?=\d)", "$1o")
    housing = F.regexp_replace(F.regexp_replace(housing, r"\btoo\b", "to"), r"\bso?ot\b", "sot")
    housing = F.regexp_replace(F.regexp_replace(housing, r"(?<=[a-z])0(?=[a-z])", "o"), r"(?<=\d)o", "0")
    firm = F.regexp_replace(col, LEGAL_FORMS, " ")
    firm = F.when(F.trim(firm) == "", col).otherwise(firm)
    return df.withColumn(name, F.trim(F.regexp_replace(F.when(F.col(field) == "housing", housing).otherwise(firm), r"\s+", " ")))


def _numbers(col: Column) -> Column:
    """The digits, with decimal points, in their order; people leave out what stands between numbers."""
    return F.regexp_replace(col, r"[^\d.]", "")


def _tokens(col: Column) -> Column:
    """The set of two-letter pieces of the form without blanks, with marks for its ends."""
    text = F.concat(F.lit("^"), F.replace(col, F.lit(" "), F.lit("")), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2))))


def _by_rarity(sets: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """sets (keys, tokens) with the tokens as an array of (n, token) from the rarest on."""
    exploded = sets.select(*keys, F.explode("tokens").alias("token")).join(counts, "token")
    return exploded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("sorted"))


def _prefixes(sets: DataFrame, threshold: float, prefix: str) -> DataFrame:
    size = F.size("sorted")
    length = size - F.ceil(F.lit(threshold) * size) + 1
    shown = sets.withColumn("size", size).select("*", F.posexplode(F.slice("sorted", F.lit(1), length.cast("int"))).alias("at", "entry"))
    return shown.select(*[F.col(c).alias(f"{prefix}{c}") for c in sets.columns if c != "sorted"], F.col("size").alias(f"{prefix}size"), F.col("at").alias(f"{prefix}at"), F.col("entry.token").alias("token"))


def match_values(values: DataFrame, canon: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(field, value, plain, canon_id, name, similarity) for each distinct value of values (field, value); plain is its plain form.

    canon has canon_id, kind (the field), name and aliases. A value without entry gets canon_id 0, null
    name and similarity 0. Null values are dropped; ties go to fewer edits, then to the smaller id. An
    empty reference list leaves every value without entry.
    """
    forms = canon.select("canon_id", F.col("kind").alias("field"), "name", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("form_text"))
    forms = plain_form(forms, "form_text", "field", "form").filter("form <> ''").select("canon_id", "field", "name", "form").distinct()
    # written, so that the long expressions of the plain form stand in one small plan each
    forms = materialize(forms.withColumn("tokens", _tokens(F.col("form"))), "canon-forms")
    distinct = plain_form(values.filter("value is not null").select("field", "value").distinct(), "value", "field", "plain")
    distinct = materialize(distinct.withColumn("tokens", _tokens(F.col("plain"))), "typed-values")
    # several spellings have one plain form: pair each form once
    queries = distinct.select("field", "plain", "tokens").distinct()
    counts = queries.select(F.explode("tokens").alias("token")).unionByName(forms.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    left = _prefixes(_by_rarity(queries, counts, ["field", "plain"]), threshold, "q_")
    right = _prefixes(_by_rarity(forms, counts, ["field", "canon_id", "name", "form"]), threshold, "f_")
    # the planner broadcasts the list's prefixes by their measured bytes; beyond its bound the join shuffles by token
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("q_size") + F.col("f_size")))
    pairs = left.join(right, (left.token == right.token) & (left.q_field == right.f_field)).filter(
        (F.col("f_size") >= F.col("q_size") * threshold)
        & (F.col("f_size") <= F.col("q_size") / threshold)
        & (1 + F.least(F.col("q_size") - F.col("q_at") - 1, F.col("f_size") - F.col("f_at") - 1) >= need)
    )
    pairs = pairs.select(F.col("q_field").alias("field"), F.col("q_plain").alias("plain"), F.col("f_canon_id").alias("canon_id"), F.col("f_name").alias("name"), F.col("f_form").alias("form")).distinct()
    a, b = _tokens(F.col("plain")), _tokens(F.col("form"))
    common = F.size(F.array_intersect(a, b))
    pairs = pairs.withColumn("similarity", common / (F.size(a) + F.size(b) - common)).filter(F.col("similarity") >= threshold)
    squeezed = [F.replace(F.col(c), F.lit(" "), F.lit("")) for c in ("plain", "form")]
    pairs = pairs.withColumn("edits", F.levenshtein(*squeezed) / F.length(squeezed[1]))
    # words in another order, or cut short, count by the words they share
    words = [F.split(c, " ") for c in ("plain", "form")]
    shared = F.size(F.array_intersect(*words)) > 0
    first = F.element_at(words[0], 1), F.element_at(words[1], 1)
    alike = F.levenshtein(*first) <= F.greatest(F.lit(1), F.floor(F.length(first[1]) * EDITS))
    cut = F.regexp_extract("plain", r"^(\w{3,})\b", 1)
    good = F.when(F.col("field") == "housing", (_numbers(F.col("plain")) == _numbers(F.col("form"))) & (F.col("edits") <= 0.34)).otherwise(
        (F.col("edits") <= EDITS / 2) | ((F.col("edits") <= EDITS) & (alike | shared)) | (shared & (F.col("similarity") > 0.5)) | (alike & (F.col("similarity") > 0.4)) | (first[1].startswith(cut) & (F.length(cut) >= 3) & (F.col("similarity") > 0.5))
    )
    best = Window.partitionBy("field", "plain").orderBy(F.desc("similarity"), "edits", "canon_id")
    best_pairs = pairs.filter(good).withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank", "edits", "form")
    out = distinct.select("field", "value", "plain").join(best_pairs, ["field", "plain"], "left")
    return out.select("field", "value", "plain", F.coalesce("canon_id", F.lit(0)).cast("long").alias("canon_id"), "name", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def canonical_fields(rows: DataFrame, canon: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, value, canon_id, name) for every cell of the given string columns that holds a usable value.

    canon_id 0 and a null name report a value without entry. Repeated rows are kept.
    """
    cells = rows.select(id_col, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("c")).select(id_col, "c.field", "c.value")
    usable = cells.filter(~is_stand_in(F.col("value")))
    matched = match_values(usable, canon)
    return usable.join(matched, ["field", "value"]).select(id_col, "field", "value", "canon_id", "name", "similarity")

"""Queries of the problems tagged llm, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampmill.llm import bpe, canonical, entities, lookalike, packing, personal
from ampmill.session import table


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_fields(table(spark, sf_dir, "parts"), table(spark, sf_dir, "canon_values"), "part_id", ["mfr", "housing"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose value isn't exactly a name of the list, with the entry meant or 0."""
    canon = table(spark, sf_dir, "canon_values").select(F.col("kind").alias("field"), F.col("name").alias("value")).distinct()
    return _canonical(spark, sf_dir).join(canon, ["field", "value"], "left_anti").select("part_id", "field", "canon_id")


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable cell with its entry and the similarity to it."""
    return _canonical(spark, sf_dir)


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of parts and listings that are the same transistor, with the marginal probability of the match."""
    return entities.match_listings(table(spark, sf_dir, "parts"), table(spark, sf_dir, "listings"), table(spark, sf_dir, "canon_values"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched rows alone."""
    return p3_matches(spark, sf_dir).select("part_id", "listing_id")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical_cells(lookalike.datasheet_cells(table(spark, sf_dir, "text_rows"), table(spark, sf_dir, "extracted_rows")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a character that only looks like, or adds nothing visible to, the plain form."""
    return _cells(spark, sf_dir).filter("changed").select("field", "row_id")


def p5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell with its canonical form."""
    return _cells(spark, sf_dir)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids of byte_bpe_50k."""
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of a document above the capacity, with its container of 2048 tokens."""
    return packing.packed_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lie in more than one container, as packed: those that alone exceed one and were cut."""
    packed = p7_containers(spark, sf_dir).groupBy("doc_id").agg(F.min("container_id").alias("a"), F.max("container_id").alias("b"), F.max("n_pieces").alias("n_pieces"))
    # several rows of one document lie apart without being cut
    return packed.filter("a <> b and n_pieces > 1").select("doc_id")


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal.find_personal(docs, personal.fit_model(docs, table(spark, sf_dir, "first_names"), table(spark, sf_dir, "canon_values")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of personal information with its place."""
    return _personal(spark, sf_dir).select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.kind", "m.start_pos", "m.end_pos")


def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders for what was found."""
    return personal.redact(_personal(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p2_found, p2_values, p3_found, p3_matches, p5_found, p5_cells, p6_ids, p7_found, p7_containers, p8_found, p8_texts)}
SQL: dict[str, str] = {}

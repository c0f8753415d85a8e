"""Queries of the operators for corpora of language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import history, leak, linkage, mix, names, pages, residue, unify
from scholion.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of scanned pages that need repair, with the kind of repair."""
    return pages.repairs(table(spark, sf, "raw_pages")).select("page_id", "line_no", "kind").distinct()


def p1_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """The continuous paragraphs of every scanned document."""
    return pages.paragraphs(table(spark, sf, "raw_pages"))


def p3_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes and titles in their one consistent form."""
    quotes = unify.unified(table(spark, sf, "findings"), "record_id", "quote", "quote")
    titles = unify.unified(table(spark, sf, "entries"), "entry_id", "title", "title")
    return quotes.unionByName(titles).select("field_name", "row", "form")


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mixture, each with its source and repeats."""
    return mix.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share that each source wants and reaches."""
    return mix.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose quotes or titles read the same but aren't made of the same characters."""
    quotes = unify.unified(table(spark, sf, "findings"), "record_id", "quote", "quote")
    titles = unify.unified(table(spark, sf, "entries"), "entry_id", "title", "title")
    return unify.same_reading(quotes.unionByName(titles))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a passage or question of an evaluation item."""
    return leak.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to exclude: open templates, filler and error pages."""
    return residue.residue(table(spark, sf, "documents")).select("doc_id").distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every later entry of a work with the work's first entry."""
    return history.duplicates(table(spark, sf, "entries")).select("entry_a", "entry_b")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings of names that stand for the same person or organisation."""
    every = table(spark, sf, "entries").select(F.col("surname").alias("name")).unionByName(table(spark, sf, "refs").select(F.col("author").alias("name")))
    return names.same_names(every).select("name_a", "name_b")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The entry that each reference line without DOI describes."""
    return linkage.match(table(spark, sf, "entries"), table(spark, sf, "refs")).select("entry_id", "ref_id")


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p3_forms": p3_forms, "p7_mix": p7_mix, "p7_shares": p7_shares, "p3_found": p3_found, "p6_found": p6_found, "p8_found": p8_found}
ORACLE: dict[str, str] = {}

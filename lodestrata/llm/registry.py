"""Queries of the training-data operators over their whole tables; SQL only where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import main_content, packing, scanned, spam, tokens
from lodestrata.session import cut, table


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k; null and empty texts have none."""
    return tokens.encode(table(spark, d, "documents", by_parts=True))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(tokens.count_tokens(table(spark, d, "documents", by_parts=True)))
    caps = [(r["pack_name"], r["capacity_tokens"]) for r in table(spark, d, "pack_capacity").distinct().orderBy("pack_name").limit(packing.MAX_PACKS + 1).collect()]
    return packing.pack(sizes, caps)


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text (or piece of a text longer than a container), for each container size."""
    return _packed(spark, d)


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each size are."""
    return packing.packed_summary(_packed(spark, d), table(spark, d, "pack_capacity"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are mostly repeated keywords, links or tags."""
    return spam.spam_documents(table(spark, d, "documents"), table(spark, d, "doc_labels")).select("doc_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of captured pages that are not main content."""
    return main_content.label_paragraphs(table(spark, d, "article_chrome_cases"), with_text=False).where("NOT is_main").select("id", "para_no").distinct()


def p2_content(spark: SparkSession, d: str) -> DataFrame:
    """The main content of every captured page."""
    return main_content.main_text(main_content.label_paragraphs(table(spark, d, "article_chrome_cases")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned reports that are running lines, end in a cut word or hold a misread character."""
    return scanned.defects(scanned.judge(table(spark, d, "dora_regression_cases"), repair=False))


def p4_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page's repaired text."""
    return scanned.repaired(scanned.judge(table(spark, d, "dora_regression_cases")))


QUERIES = {"p2_found": p2_found, "p2_content": p2_content, "p4_found": p4_found, "p4_pages": p4_pages, "p5_ids": p5_ids, "p6_packed": p6_packed, "p6_summary": p6_summary, "p7_found": p7_found}
SQL: dict[str, str] = {}

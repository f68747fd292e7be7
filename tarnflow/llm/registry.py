"""Queries of this subpackage over their whole tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, debruijn, html, isomedia, jaccard, langid, linededup, packing, templates, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table, written as segmented WARC records, out of order, and put together again."""
    found = warc.reassemble(warc.from_pages(common.table(spark, sf_dir, "pages")))
    page = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1).cast("bigint")
    return found.select(page.alias("page_id"), "url", "status", "n_segments", "total_length", "http_status", F.decode("payload", "UTF-8").alias("html"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without later copies of runs, and the maximal runs that were cut."""
    found = linededup.dedup(common.table(spark, sf_dir, "documents"), with_runs=True)
    return found.select("doc_id", "text", "n_removed", "run_starts", "run_lengths", "run_sources")


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(common.table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is similar to another one, its group, and to how many."""
    return jaccard.links(common.table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def op10_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.repeated_spans(common.table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table, each page as the payload of an ISO container."""
    return isomedia.media_columns(isomedia.from_pages(common.table(spark, sf_dir, "pages")))


def queries() -> dict[str, Query]:
    return {
        "op1_warc_reassembly": op1_warc_reassembly,
        "op2_line_dedup": op2_line_dedup,
        "op3_template_decontamination": op3_template_decontamination,
        "op4_packing": op4_packing,
        "op5_html_extraction": op5_html_extraction,
        "op6_language_id": op6_language_id,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_toxicity": op8_toxicity,
        "op9_media_columns": op9_media_columns,
        "op10_debruijn_repeats": op10_debruijn_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_reassembly": warc.ORACLE_SQL,
        "op2_line_dedup": linededup.ORACLE_SQL,
        "op7_ngram_jaccard": jaccard.ORACLE_SQL,
        "op9_media_columns": isomedia.ORACLE_SQL,
        "op10_debruijn_repeats": debruijn.ORACLE_SQL,
    }

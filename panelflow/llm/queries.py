"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_text, lines, mixing, neighbours, private_data, quality, simhash, token_files, topk
from .common import table
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


@query("op1_fuzzy_lines")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op2_source_mixing", mixing.oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op4_simhash_vp_tree")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op5_private_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op6_nn_descent")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


@query("op7_exact_top_k", topk.oracle())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op8_bpe_backtracking")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_html_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op10_quality_subwords")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

"""The query of each corpus operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import read


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import html

    return html.extract(read(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import secrets

    return secrets.digests(secrets.scan(read(spark, sf_dir, "documents")))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import media

    return media.digests(media.media_columns(read(spark, sf_dir, "documents")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import packing

    return packing.digests(packing.pack_sequences(read(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import toxicity

    docs = read(spark, sf_dir, "documents")
    index = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, index).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import search

    return search.search(read(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import mixing

    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import scoring

    return scoring.score(read(spark, sf_dir, "documents"), ~scoring.held_out(F.col("doc_id")))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import substrings

    return substrings.digests(substrings.remove_repeats(read(spark, sf_dir, "documents")))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm import neardup

    found = neardup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_secrets, op3_media, op4_toxicity, op5_packing, op6_search, op7_mixing, op8_scoring, op9_substrings, op10_neardup)}


def oracle_sql() -> dict[str, str]:
    from tallyloom.llm import neardup, search, substrings

    return {"op6_search": search.ORACLE, "op9_substrings": substrings.ORACLE, "op10_neardup": neardup.ORACLE}

"""A training corpus from raw documents: toxic documents go, one document of each group of
near duplicates stays, live-looking secrets are blanked, sources are mixed to their target
weights, and what is left is packed into sequences of tokens.

All stages but the last return the columns of documents, whatever further ones there are and
however they are named; the decisions rest on doc_id, text and source alone. An empty table
gives an empty one at every stage. The cases that a stage defines stand with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import mixing, neardup, packing, secrets, toxicity
from tallyloom.llm.common import cut, free_shuffles, read


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches the threshold. A null or empty text has
    the score of labelled texts without any term; long texts are scored whole; repeated rows
    and rows without a doc_id are each judged by their text; without usable labels all stay."""
    index = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, index)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near duplicates: that of the smallest doc_id, null
    last, then of the smallest hash of its text. Rows without words stay all; of rows with
    equal doc_id and text one stays, of different texts under one doc_id each its own."""
    return neardup.kept_documents(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blanks the live-looking credentials; copied examples stay, and every document does.
    Null texts stay null; a null source is an owner; overlapping spans are blanked together."""
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that the mix takes over a document, the last one cut to length.
    Null, empty and blank texts have no words and are not taken; a null source is a source,
    the last; identical rows share what they get to the word, in a fixed order."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence, with its token ids. A null or empty
    text is the end id alone; repeated rows and rows without a doc_id are packed each."""
    return packing.pack_sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages from the first on can't be put in SQL; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            free_shuffles(spark)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

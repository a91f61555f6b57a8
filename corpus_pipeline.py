"""Cleaning of a document table into packed training sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs;
all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, packing, secrets, similar, substring_dedup
from tidemark.llm.common import drop_stage, stage_paths, staged, table
from tidemark.llm.queries import END_ID, vocabulary_path
from tidemark.session import ship_package


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, n_chars made to fit text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return docs.select(*columns)


def _free(names: tuple[str, ...], taken: list[str]) -> tuple[str, ...]:
    """The names, each lengthened until it is none of those taken (which Spark compares without case)."""
    low, out = {t.lower() for t in taken}, []
    for n in names:
        while n in low:
            n += "_"
        out.append(n)
    return tuple(out)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: null, or without a letter."""
    ship_package(spark)
    model = langid.train(langid.training_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), ~langid.held_out(F.col("doc_id"))))
    new = _free(("pred", "score", "ambiguous"), docs.columns)
    return langid.predict(docs, model, new).where(F.col(new[0]) != langid.UNDETERMINED).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id (null first) of each group of copies and near copies (five words, similarity 0.8).

    Rows are told apart by doc_id and text: unlike texts under one doc_id, or under none, are documents of their own. SimHash
    proposes links, the shingle sets decide them.
    """
    ship_package(spark)
    before = stage_paths()
    least = similar.similar_groups(docs).groupBy("group").agg(F.min(F.struct(*similar.ROW)).alias("row"))
    stay, path = staged(least.select("row.*"))
    for old in stage_paths() - before - {path}:
        drop_stage(spark, old)
    row = list(similar.ROW)
    return similar.with_row(docs).join(stay, row, "left_semi").dropDuplicates(row).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that stand earlier too out of text; a text that loses nothing stays as it was."""
    ship_package(spark)
    out = substring_dedup.remove_repeats(docs, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_text(out.select(*[text.alias(c) if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns]), docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in text by a mark."""
    ship_package(spark)
    return _with_text(secrets.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens."""
    ship_package(spark)
    return packing.pack(docs, vocabulary_path(), END_ID)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]

#: A trained classifier and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

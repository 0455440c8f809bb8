"""A training corpus from raw documents, in stages: each works on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.decontamination import decontaminate
from spendlens.llm.jaccard_join import jaccard_groups
from spendlens.llm.language_id import predict, train
from spendlens.llm.packing import packed_sequences
from spendlens.llm.secret_scan import redact
from spendlens.llm.storage import saved, small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; what the operator calls undetermined, ambiguous or far from every language goes.
    Without any label there is nothing to tell languages by, and every document with a letter stays. Labels stay as they came."""
    model = train(docs.select("text", "lang"))
    if not model.languages:
        return _documents(docs).where(F.col("text").rlike(r"\p{L}"))
    return predict(_documents(docs), model).where("lang_pred != 'und' and not ambiguous and not far").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    copies = saved(jaccard_groups(docs.select("doc_id", "text")).where("doc_id != component_id").select("doc_id"), "copies")
    return _documents(docs).join(small(copies), "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(_documents(docs), items).where(~F.col("contaminated")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; in their texts a mark stands for every secret."""
    return redact(_documents(docs)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 1024 tokens."""
    return packed_sequences(docs.select("doc_id", "text"))


STAGES = [
    ("language", language), ("near_copies", near_copies), ("decontamination", decontamination), ("secrets", secrets),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

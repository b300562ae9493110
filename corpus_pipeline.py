"""Filter, deduplicate, redact and pack a corpus: five stages, each over all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidymesh.llm.common import settle
from tidymesh.llm.exact_dedup import exact_dedup
from tidymesh.llm.jaccard_join import jaccard_components
from tidymesh.llm.packing import pack_documents
from tidymesh.llm.secret_scan import redact_secrets
from tidymesh.llm.toxicity import fit_toxicity, score_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.3, by a model of the labels of this stage's documents.

    Null and empty texts have the score of a text without words. Repeated rows go or stay together."""
    model = fit_toxicity(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "score_" + "_".join(docs.columns)  # no column of the documents has this name
    return score_toxicity(docs, model, score_col=score).where(f"`{score}` < 0.3").select(*(F.col(f"`{c}`") for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty), the row with the largest doc_id; rows that repeat it stay together. All columns stay as they are."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return exact_dedup(rows, keep="largest").where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the rows with the smallest doc_id; rows with a null doc_id stay, as nothing tells them apart."""
    gone = jaccard_components(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark, and n_chars counted again where the text has changed; null texts stay null."""
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return redact_secrets(docs).withColumn("n_chars", length).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, each with its place in a sequence of at most 1024; null and empty texts are a document of its end alone."""
    import public_tokenizers as tok

    return pack_documents(docs, tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("secret scan", secrets), ("best-fit packing", packing)]
#: Training, similarity components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each settled, so that the next one's passes read it and don't compute it again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

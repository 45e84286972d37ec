"""From raw documents to token ids in five stages, each an operator of ``memspark.llm``.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
back as the next one's ``docs``; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memspark.llm.mixing import mix_rows
from memspark.llm.pieces import encode_documents
from memspark.llm.quality import assess
from memspark.llm.registry import tokenizer_path
from memspark.llm.repeats import remove_repeats
from memspark.llm.simhash import keep_one_of_each
from memspark.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return assess(docs).where("quality_ok").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one_of_each(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that appeared before are cut out of the texts, whole characters only."""
    kept = remove_repeats(docs, keep=("lang", "source")).withColumnRenamed("kept_text", "text")
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document taken twice is two rows."""
    return mix_rows(docs).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids of the public piece vocabulary."""
    coded = encode_documents(docs.select("doc_id", "source", "text"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeated_passages", repeated_passages), ("mixing", mixing), ("encoding", encoding)]

#: No stage but the mixing's arithmetic can be said in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

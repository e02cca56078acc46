"""The training-data pipeline: documents to token ids in five stages, each of which calls one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import bpe, langid, mixing, neardup, pii
from veristrata.llm.common import materialize, spare
from veristrata.llm.queries import LANGID_SAMPLE, MIX_SEED, MIX_WEIGHTS, tokenizer_path

#: A text goes if no language has this share of its words; with four languages a guess has a quarter.
MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null texts, and texts in no known language go."""
    return langid.keep_known(docs, langid.fit(docs, LANGID_SAMPLE), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the least id. Rows with a null or repeated id are grouped by text like others; null ids come last."""
    row = spare(docs, "__row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = neardup.components(rows, row).select(F.col(row).alias("__of"), F.col("component_id").alias("__group"))
    named = rows.select(row, "doc_id").join(found, F.col(row) == F.col("__of"))
    first = named.groupBy("__group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("x"))
    return rows.join(first.select(F.col(f"x.{row}").alias(row)), row, "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become <KIND>; n_chars follows the text."""
    out = pii.masked(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat (or not) by their source's target share; the copies are the rows. All columns stay, one called copy too."""
    return mixing.mix(docs, MIX_WEIGHTS, seed=MIX_SEED, copy=spare(docs, "__copy")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them, and the ids."""
    encoded = bpe.encode(docs, bpe.vocabulary(tokenizer_path()))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Language, near-duplicate and personal-data decisions are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them a table is written in the shared folder, so a lost executor costs one stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs

"""Corpus pipeline: filter, thin, clean and mix ``documents`` in stages that each rest as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tallyforge.llm import pii, toxicity
from tallyforge.llm.decontamination import contamination_flag, find_contamination, hit_words
from tallyforge.llm.mixing import emit_copies, mix_sources
from tallyforge.llm.neardup import drop_near_duplicates
from tallyforge.llm.shipping import prepare
from tallyforge.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model learns from the labelled ones among them."""
    prepare(spark)
    labels = toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, toxicity.learn(docs, labels), score_col="_toxicity")
    return scored.filter("_toxicity < 0.5").select(docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group."""
    prepare(spark)
    return drop_near_duplicates(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty stand in benchmark windows."""
    prepare(spark)
    rows = docs.select(F.struct("*").alias("row"), "text")
    found = find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return found.filter(~contamination_flag(hit_words(F.col("hits")), F.col("n_words"))).select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their personal data replaced by its kind; ``n_chars`` follows the text."""
    prepare(spark)
    masked = pii.mask_pii(docs, pii.labelled_lines(spark))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: one row for each copy of a document that the mix takes."""
    return emit_copies(mix_sources(docs))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("near-duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("personal-data", mask_personal_data),
    ("mix", mix),
]

#: No SQL states the trained models of the stages; tests/llm compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

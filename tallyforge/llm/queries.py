"""Queries opN over whole tables: each runs its operator and derives the digest columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from tallyforge.llm import pii, secrets, toxicity
from tallyforge.llm.decontamination import contamination_flag, find_contamination, hit_words
from tallyforge.llm.language import fold, identify_language
from tallyforge.llm.mixing import mix_sources
from tallyforge.llm.neardup import near_duplicates
from tallyforge.llm.repair import repair_summary
from tallyforge.llm.repeats import repeated_spans, without_spans
from tallyforge.llm.shipping import prepare
from tallyforge.llm.spans import base_only, count_of, joined
from tallyforge.llm.tokenfiles import checksums, read_tokens, write_tokens
from tallyforge.llm.tokens import corpus_totals
from tallyforge.llm.topk import exact_top_k
from tallyforge.llm.variants import spelling_groups, word_counts
from tallyforge.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("n_hit", hit_words(F.col("hits"))).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        _sha(F.array_join(F.array_sort("items"), ",")).alias("items_sha256"),
        contamination_flag(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def _span_digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *(count_of(spans, kind).alias(f"n_{kind}") for kind in kinds),
        _sha(joined(base_only(spans))).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"), pii.labelled_lines(spark))
    return _span_digests(found, pii.KINDS)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"), secrets.labelled_samples(spark))
    return _span_digests(found, ("assign", "access", "hex"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_totals(_table(spark, sf_dir, "documents"), scratch_path(spark, "token-ledger"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    predicted = identify_language(docs, docs.filter("NOT held_out"))
    return predicted.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, toxicity.training_labels(_table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = without_spans(repeated_spans(_table(spark, sf_dir, "documents")))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "token-files")
    write_tokens(_table(spark, sf_dir, "documents"), root)
    return checksums(read_tokens(spark, root))


def misspelt(key: object, run: str) -> str:
    """The contract's damage: of about one (document, run) in 199 a letter is lost. A null id reads as empty."""
    h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    at = h % len(run)
    return run if h % 199 else run[:at] + run[at + 1 :]


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spelling_groups(word_counts(_table(spark, sf_dir, "documents"), change=misspelt))
    return groups.select("word", "form", "root", "n", "n_near", "form_n")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to conversations, by crc32 of ``conv_id:turn``; nulls read as one space."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", blank))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return kept.select("conv_id", "turn", "role", "text", F.explode("copies")).drop("col")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return repair_summary(damaged(rows), rows)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_secrets": op3_secrets,
    "op4_tokens": op4_tokens,
    "op5_topk": op5_topk,
    "op6_language": op6_language,
    "op7_toxicity": op7_toxicity,
    "op8_repeats": op8_repeats,
    "op9_neardup": op9_neardup,
    "op10_mix": op10_mix,
    "op11_tokenfiles": op11_tokenfiles,
    "op12_variants": op12_variants,
    "op13_repair": op13_repair,
}

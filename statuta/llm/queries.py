"""One query ``opN_<name>`` per operator: production parameters over its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.common import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.simhash_covering import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


@query
def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.line_templates import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_dropped")


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.byte_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.toxicity import toxicity

    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.knn_quality import knn_quality

    scored = knn_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.chat_format import conversation_digests, format_turns, text_parts

    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return conversation_digests(format_turns(turns.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and web pages together; a page's doc_id is -1 - page_id."""
    from statuta.llm.language_id import document_evidence, identify, page_evidence

    docs = document_evidence(table(spark, sf_dir, "documents")).withColumn("page_id", F.lit(None).cast("long"))
    pages = page_evidence(table(spark, sf_dir, "pages")).withColumn("doc_id", -1 - F.col("page_id"))
    return identify(docs.unionByName(pages), ["doc_id", "page_id"])


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.hard_negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


@query
def op13_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.template_extraction import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))

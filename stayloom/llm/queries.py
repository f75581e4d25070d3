"""The registered queries of this subpackage; their digest columns are derived here from the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayloom.llm import (
    bpe, conversation_repair, decontaminate, host_reputation, jaccard_join, language_id, line_dedup, quality_model, quality_rules,
    substring_dedup, suffix_dedup, table_clustering, warc,
)
from stayloom.session import stage_path, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bpe_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op1_random_indexing_quality")
def op1(spark, folder):
    return quality_model.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_bpe_speculate_verify")
def op2(spark, folder):
    return bpe_digests(bpe.round_trip(table(spark, folder, "documents"), TOKENIZER))


@query("op3_target_likelihood_rules")
def op3(spark, folder):
    return quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_suffix_automaton_decontamination")
def op4(spark, folder):
    found = decontaminate.decontaminate(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


@query("op5_de_bruijn_substring_dedup")
def op5(spark, folder):
    kept = substring_dedup.substring_dedup(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_string_kernel_language")
def op6(spark, folder):
    return language_id.language_id(table(spark, folder, "documents"))


@query("op7_line_chunk_dedup")
def op7(spark, folder):
    kept = line_dedup.line_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("cleaned", F.lit("")), 256).alias("kept_sha256"))


@query("op8_host_reputation")
def op8(spark, folder):
    return host_reputation.url_filter(table(spark, folder, "pages")).withColumn("bad_bound", F.round("bad_bound", 8))


@query("op9_warc_segments")
def op9(spark, folder):
    path = stage_path(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), path)
    return warc.page_summary(warc.read_warc(spark, path))


@query("op10_parity_sketch_jaccard")
def op10(spark, folder):
    return jaccard_join.jaccard_groups(table(spark, folder, "documents"))


@query("op11_table_centroid_clustering", table_clustering.sql())
def op11(spark, folder):
    clustered = table_clustering.cluster_vectors(table(spark, folder, "embeddings"))
    return clustered.withColumn("centroid", table_clustering.centroid_digest(F.col("centroid"))).withColumnRenamed("centroid", "centroid_sha256")


@query("op12_grammar_conversation_repair", conversation_repair.SQL)
def op12(spark, folder):
    damaged = conversation_repair.damage(table(spark, folder, "conversations"))
    return conversation_repair.repair_conversations(damaged).conversations()


@query("op13_suffix_array_dedup")
def op13(spark, folder):
    kept = suffix_dedup.suffix_dedup(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

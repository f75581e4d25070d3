"""The corpus pipeline: each stage takes the documents that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayloom.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_model
from stayloom.llm.queries import TOKENIZER, bpe_digests, table
from stayloom.operators.prepare import number_rows
from stayloom.session import cut_lineage, tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that has the run-time settings when it is called alone, too: they bound what crosses to a worker at a time."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(docs.sparkSession)
        return fn(spark, docs, sf_dir)

    return run_stage


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the documents it is given."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def with_text(df: DataFrame, row: str, text: str) -> DataFrame:
    """The documents of struct ``row`` with a new text; ``n_chars`` follows where the text changed."""
    changed = ~F.col(text).eqNullSafe(F.col(f"{row}.text"))
    return df.select(f"{row}.doc_id", F.col(text).alias("text"), f"{row}.lang", f"{row}.source",
                     F.when(changed, F.length(text).cast("bigint")).otherwise(F.col(f"{row}.n_chars")).alias("n_chars"))


@stage
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated line chunks; one that keeps no line of those it had goes."""
    kept = line_dedup.line_dedup(docs.select(COLUMNS)).where("n_removed = 0 or n_removed < n_lines")
    return with_text(kept, "doc", "cleaned")


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id (NULL last) of each group of near duplicates, and every row without words.

    Rows are grouped, not ids: each gets a number of its own, which stays with it, so of rows that share an id only those whose texts
    are in one group go, and of equal rows one stays. Numbers follow the ids, so that of documents that meet the first is compared
    with all others, as without numbers.
    """
    rows = number_rows(docs.select(COLUMNS), ["doc_id"], "place")
    groups = jaccard_join.jaccard_groups(rows.select(F.col("place").alias("doc_id"), "text"))
    named = groups.select(F.col("doc_id").alias("place"), F.col("component_id").alias("group")).join(rows.select("place", "doc_id"), "place")
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    gone = named.join(first.where("n > 1"), "group").where("place <> first.place").select("place")
    return rows.join(cut_lineage(gone, "gone"), "place", "left_anti").select(COLUMNS)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut out; one of which more than half was benchmark goes."""
    found = decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    kept = found.where("found.n_hit = 0 or found.cleaned <> ''").select(F.struct(*COLUMNS).alias("doc"), F.col("found.cleaned").alias("cleaned"))
    return with_text(kept, "doc", "cleaned")


@stage
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left."""
    return bpe_digests(bpe.round_trip(docs, TOKENIZER))


STAGES = [("quality_classifier", good_quality), ("line_dedup", without_repeated_lines), ("ngram_jaccard_join", one_of_each_group),
          ("benchmark_decontamination", without_benchmark), ("bpe_encoding", encode_tokens)]

# Trained weights, hash sketches and merging by rank are no SQL; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each but the last written and read again; an empty table gives no rows."""
    docs = table(tune(spark), sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = cut_lineage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

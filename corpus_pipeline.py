"""From raw documents to token ids: the stages of a training corpus, each on all that the one before it kept.

Toxic documents go; repeated runs of lines go from all documents but the first that has them; one document of each
group of near duplicates stays; sources are mixed to their weights; texts become SentencePiece ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import common
from kinweave.llm.line_dedup import dedup_lines
from kinweave.llm.mixing import mix
from kinweave.llm.ngram_join import near_duplicates
from kinweave.llm.sentencepieces import encode_pieces
from kinweave.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_left: list[str] = []  # scratch folders of the stage that ran last


def _stage(work: Stage) -> Stage:
    """A stage that first deletes what the stage before it left on the shared store: its result is written by now."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.remove(spark, _left)
        _left.clear()
        before = len(common.scratch_folders)
        out = work(spark, docs, sf_dir)
        _left.extend(common.scratch_folders[before:])
        return out

    return run_stage


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5, each row by its own text; without labels of both kinds all stay. Null and empty texts stay. An empty table gives no rows."""
    docs = docs.select(*COLUMNS)
    model = fit_toxicity(docs, common.table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, score_col="__toxicity").where("__toxicity < 0.5").select(*COLUMNS)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; n_chars follows the text. A document none of whose words are left is a copy and goes; null, empty and blank texts stay as they are. An empty table gives no rows."""
    out = dedup_lines(docs.select(*COLUMNS)).where((F.col("deleted_lines") == 0) | (F.regexp_like("text", F.lit(common.WORD))))
    return out.withColumn("n_chars", F.when(F.col("deleted_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def _digest(*more: str) -> Column:
    """A number for a row's content. Hashes pass over nulls, so where they are is hashed as well."""
    return F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS], *more)


@_stage
def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least id, null the least (ties by content). Every row is a document of its own, whatever its id."""
    # Numbers are fixed once written; which rows stay doesn't depend on them, as ties go by content.
    rows = common.stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__key"), _digest().alias("__digest")), "rows")
    found = near_duplicates(rows, "__key").select(F.col("__key").alias("__of"), F.col("component_id").alias("__group"))
    grouped = rows.select("__key", "doc_id", "__digest").join(found, F.col("__key") == F.col("__of"))
    first = grouped.groupBy("__group").agg(F.min(F.struct("doc_id", "__digest", "__key")).alias("least")).select(F.col("least.__key").alias("__of"))
    return rows.join(first, F.col("__key") == F.col("__of"), "left_semi").select(*COLUMNS)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words, to the nearest whole number (0, 1 or 2 times), in the order of the schedule's slots.

    Rows without words (null and empty texts) give nothing. Every row is a document of its own, whatever its id; equal
    rows are told apart by a number among them. An empty table gives no rows.
    """
    # Keys of content and place among equal rows: the mix goes by them, so they can't depend on partitions.
    rows = docs.groupBy(*COLUMNS).agg(F.count("*").alias("__n")).withColumn("__place", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    rows = common.stored(rows.select(*COLUMNS, _digest("__place").alias("__key")), "rows")
    mixed = mix(rows, "__key").where("taken > 0").select(F.col("__key").alias("__of"), "first_slots", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0")
    taken = mixed.select("__of", "first_slots", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("__turn"))
    taken = taken.select("__of", "__turn", F.coalesce(F.get("first_slots", "__turn"), F.col("first_slots")[0]).alias("__slot"))
    out = rows.join(taken, F.col("__key") == F.col("__of"))
    return out.repartitionByRange("__slot", "__turn", "__key").sortWithinPartitions("__slot", "__turn", "__key").select(*COLUMNS)


@_stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text, a row for each row; a null text is empty. An empty table gives no rows."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", near_duplicate_groups), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: SQL can express neither compression lengths nor a sampled fit, nor piece ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result is written and read again, and deleted once the next is written."""
    docs, old = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/kinweave/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if old:
            common.remove(spark, [old])
        docs, old = spark.read.parquet(path), path
    return docs

"""A training corpus from ``documents``: language, near copies, personal data, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet in the shared folder and read again for the
next one. All stages but the last return the columns of ``documents``, in their order, and any others that came along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from stillwave.llm import byte_bpe, lang_id, mixing, near_dup, pii
from stillwave.llm.common import held_out, small_batches, stash

#: Share of a document's letters that its language must have. Below it no language prevails.
LEAST_SHARE = 0.3


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def others_aside(stage: Callable) -> Callable:
    """Other columns than those of ``documents`` pass a stage in one struct, so that their names clash with nothing."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        others = [c for c in names if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        own = [c for c in names if c in COLUMNS]
        packed = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others"))
        back = {c: F.col("_others").getField(c) if c in others else F.col(c) for c in names}
        return stage(spark, packed, sf_dir).select(*[column.alias(c) for c, column in back.items()])

    return run


@others_aside
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language: those without a letter, or where no language prevails, go.

    Learned from the labelled documents outside one hash fold; a corpus without labels keeps all its documents.
    """
    small_batches(spark)
    model = lang_id.learn(docs.where(~held_out("doc_id", 3, 1)))
    if not model["langs"]:
        return docs
    kept = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)
    return lang_id.label(docs, model).where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


@others_aside
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group of near copies (five-word shingles, similarity 0.8).

    Of rows that repeat id and text one stays; rows that repeat an id only are documents of their own; a missing id
    comes after all others. Texts without a word are nobody's copies and stay. A row is known by a hash of its id and
    text, which is the same whenever it is read.
    """
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = near_dup.near_duplicates(rows.select("_row", "text"), doc_id="_row", size=5, percent=80)
    ids = rows.groupBy("_row").agg(F.min("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")
    kept = (found.groupBy("_row").agg(F.min("component_id").alias("component_id")).join(ids, "_row")
            .groupBy("component_id").agg(first).select(F.col("first._row").alias("_row")))
    return rows.dropDuplicates(["_row"]).join(kept, "_row", "left_semi").select(*docs.columns)


@others_aside
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; no document goes."""
    return pii.redact(docs, n_chars="n_chars")


@others_aside
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources have their weights.

    A null source is a source of its own; texts without a word go; repeated rows are documents of their own.
    """
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of each document, with the digests of ids and decoded bytes; a null text has no tokens."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).select(
        "doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language ID", language), ("MinHash near-dedup", near_copies), ("PII", personal_data),
          ("mixing sources to target weights", mixture), ("byte-level BPE", tokens)]

#: Near copies and bootstrapped extraction have no SQL here; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

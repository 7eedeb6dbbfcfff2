"""The corpus pipeline: documents through quality, repeated lines, near-duplicates, leaks and tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterline.cluster import scratch_path, ship_package
from musterline.llm import decontamination, lines, pieces, quality, simhash
from musterline.llm.queries import TOKENIZERS
from musterline.llm.tables import bound_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _ready(spark: SparkSession) -> None:
    ship_package()
    bound_batches(spark)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    _ready(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stood earlier; those that lose all their lines go."""
    _ready(spark)
    return lines.deduplicated(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, as SimHash fingerprints and then shingle sets tell them."""
    _ready(spark)
    return simhash.one_of_each(docs, fingerprints=True)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    _ready(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the text's token ids (binary, little-endian unsigned 32-bit), their number, and the text
    they decode to."""
    _ready(spark)
    rows = pieces.encoded(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    count = (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    return rows.select("doc_id", "lang", "source", count, "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("line_dedup", cut_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("sentencepiece", to_tokens),
]

# The classifier cannot be said in SQL; tests/llm compares the whole run with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the stage before it kept, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

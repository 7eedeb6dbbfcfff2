"""Token counts of documents in flat, unindexed token files.

A flat file holds the tokens of document after document as little-endian 16-bit numbers, each document followed
by an end-of-document id, and nothing else. Counting reads it in blocks of fixed size: every block is searched
for the id in one vectorised pass, and a prefix scan over the blocks of a file (documents so far, place of the
last end so far) stitches documents that cross block boundaries.

Defined results: an empty document counts 0 tokens; tokens after the last end id form one more
document, as in an unfinished file; an empty file has no documents. A null text is written as an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage, task_count

END = 50256
BLOCK_TOKENS = 1 << 20
WIDTH = 2
WRITE_BYTES = 8 << 20
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def tokenizer(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path)


def write_token_files(documents: DataFrame, folder: str, ranks_path: str, end: int = END) -> DataFrame:
    """Writes one flat file per task below ``folder``; returns (file, ordinal, doc_id), the order in them.

    A task writes under a name of its own attempt and renames at its end, so a repeated one replaces the
    file of a lost one with the same rows."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast({"ranks": read_ranks(ranks_path)})
    store, root = _store(folder)
    store.create_dir(root)
    schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, task = held.value, TaskContext.get()
        encoding = value.get("encoding")
        if encoding is None:
            encoding = value["encoding"] = tokenizer(value["ranks"])
        name = f"tokens-{task.partitionId():06d}.bin"
        store, root = _store(folder)
        unfinished = f"{root}/_{name}.{task.taskAttemptId()}"
        ordinal = 0
        with store.open_output_stream(unfinished, buffer_size=WRITE_BYTES) as out:
            for batch in batches:
                ids = batch.column("doc_id")
                for text in batch.column("text").to_pylist():
                    out.write(np.array([*encoding.encode_ordinary(text or ""), end], dtype="<u2").tobytes())
                places = pa.array(range(ordinal, ordinal + len(ids)), pa.int64())
                ordinal += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), places, ids], schema=schema)
        store.move(unfinished, f"{root}/{name}")

    rows = documents.select(F.col("doc_id").cast("bigint"), "text")
    return cut_lineage(rows.mapInArrow(write, "file string, ordinal bigint, doc_id bigint"))


def blocks(spark: SparkSession, folder: str, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens, ends): the tokens of each block and the places of its end ids in the file."""
    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("tokens", pa.int64()), ("ends", pa.list_(pa.int64()))]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()):
                store, place = _store(path)
                with store.open_input_file(place) as file:
                    file.seek(block * block_tokens * WIDTH)
                    tokens = np.frombuffer(file.read(block_tokens * WIDTH), dtype="<u2")
                ends = np.flatnonzero(tokens == end) + block * block_tokens
                name = path.rsplit("/", 1)[1]
                columns = [[name], [block], [len(tokens)], [ends]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder)
    size = block_tokens * WIDTH
    last = F.floor((F.col("length") - 1) / size)
    work = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    work = work.repartition(task_count(spark), "path", "block")
    return work.mapInArrow(search, "file string, block bigint, tokens bigint, ends array<bigint>")


def document_lengths(spark: SparkSession, folder: str, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the flat files below ``folder``."""
    found = cut_lineage(blocks(spark, folder, end, block_tokens))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("file", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    carried = sums.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("documents"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"),
    )
    joined = found.join(carried, ["file", "block"])
    lengths = F.transform(
        "ends", lambda e, i: e - F.when(i == 0, F.col("previous")).otherwise(F.get(F.col("ends"), i - 1)) - 1
    )
    closed = joined.select("file", "documents", F.posexplode_outer(lengths).alias("at", "n_tokens"))
    closed = closed.filter(F.col("n_tokens").isNotNull())
    closed = closed.select("file", (F.col("documents") + F.col("at")).cast("bigint").alias("ordinal"), "n_tokens")
    whole = found.groupBy("file").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.size("ends")).alias("n"), F.max(F.array_max("ends")).alias("last")
    )
    rest = F.col("tokens") - F.coalesce("last", F.lit(-1)) - 1
    unfinished = whole.select("file", F.col("n").cast("bigint").alias("ordinal"), rest.alias("n_tokens"))
    return closed.unionByName(unfinished.filter("n_tokens > 0"))

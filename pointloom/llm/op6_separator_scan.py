"""Token counts of the documents in flat, unindexed token files, by a scan for the end-of-document id.

Files are cut into blocks of ``BLOCK`` ids, wherever that falls. Each block is searched for separators by numpy, by itself; a prefix scan over the blocks'
summaries (separators so far, place of the last one) then gives every block what it needs to number its documents
and to count the tokens of the one that begins before it. What is scanned per file is a row for each block.

Defined results:
- the separator counts for no document; two separators in a row are an empty document; a document may span any number of blocks;
- files are told apart by their whole paths, whatever their names;
- ids after the last separator are a document that is not ``ended``; an empty file has no documents; a last id that is cut short is an error;
- in the query, null and empty texts are documents without tokens, separators' strings in a text are ordinary text, and repeated
  rows and ids are documents of their own; an empty table makes no files and an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pointloom.llm import staging
from pointloom.llm.op3_token_store import default_tokenizer, encoder_of, portions, vocabulary

BLOCK, FILE_BYTES = 2 << 20, 16 << 20


def write_flat(documents: DataFrame, at: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, separator: int) -> DataFrame:
    """Write the documents' ids, each with the separator after it, as the partitions lie; what is returned (and written beside the files) is
    (``file``, ``ordinal``, ``doc_id``), which the files themselves don't hold."""
    tokenizer_path = tokenizer_path or default_tokenizer()
    width = 2 if max(vocabulary(tokenizer_path) - 1, separator) < 1 << 16 else 4
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, width, plain=True)
        end = np.array([separator], encoder.kind).tobytes()
        part, roll = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal roll, ids, held, size
            name = f"flat-{part:06d}-{roll:04d}.ids"
            staging.commit_file(f"{at}/{name}", b"".join(held))
            out = pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(np.arange(len(ids))), pa.array(ids, pa.int64())], names=["file", "ordinal", "doc_id"])
            roll, ids, held, size = roll + 1, [], [], 0
            return out

        for batch in batches:
            for piece in portions(batch, 1):
                codes, cuts = encoder.encode(piece.column(1))
                for doc, i, j in zip(piece.column(0).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    ids.append(doc)
                    held.append(codes[i:j].tobytes() + end)
                    size += len(held[-1])
                    if size >= FILE_BYTES:
                        yield close()
        if ids:
            yield close()

    return staging.keep(rows.mapInArrow(work, "file string, ordinal long, doc_id long"), "flat-documents")


def scan(spark: SparkSession, path: str, *, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``path``, ``file`` (its last part), ``ordinal``, ``start``, ``n_tokens``, ``ended`` for each document in the files of a folder or pattern."""
    names = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType())])
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(path).select("path", "length")
    last = F.floor((F.col("length") - 1) / F.lit(block * width)).cast("int")
    cuts = found.where(F.col("length") > 0).select(*names.names, F.explode(F.sequence(F.lit(0), last)).alias("block"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, length, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{uri}: {length} bytes are no whole number of ids")
                store, at = staging.open_fs(uri)
                with store.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(min(block * width, length - k * block * width), k * block * width), f"<u{width}")
                ends = np.flatnonzero(ids == separator) + k * block
                total, ended = length // width, True
                if k * block + len(ids) == total and ids[-1] != separator:
                    ends, ended = np.append(ends, total), False
                starts = np.append(-1, ends[:-1] + 1) if len(ends) else ends  # the first one's is known after the prefix scan
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri]), pa.array([k], pa.int32()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ended]), pa.array([starts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))],
                    names=["path", "block", "n", "last", "ended", "starts", "ends"],
                )

    blocks = staging.keep(cuts.repartition("path", "block").mapInArrow(work, "path string, block int, n long, last long, ended boolean, starts array<bigint>, ends array<bigint>"), "flat-blocks")
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("since"))
    each = blocks.join(carried, ["path", "block"]).select("path", "first", "since", "n", "ended", F.posexplode(F.arrays_zip("starts", "ends")).alias("k", "of"))
    start = F.when(F.col("k") == 0, F.col("since") + 1).otherwise(F.col("of.starts"))
    return each.select(
        "path",
        F.substring_index("path", "/", -1).alias("file"),
        (F.col("first") + F.col("k")).alias("ordinal"),
        start.alias("start"),
        (F.col("of.ends") - start).alias("n_tokens"),
        (F.col("ended") | (F.col("k") < F.col("n") - 1)).alias("ended"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """``op6_separator_scan``: all documents' ids in flat files, then the count of each document found by the scan alone."""
    at = staging.folder(spark, "flat")
    separator = 49407  # the tokenizer's own end of text, which ordinary text never has
    listed = write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), at, separator=separator)
    if listed.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long, file string, ordinal long")
    return scan(spark, at, separator=separator).join(listed, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")

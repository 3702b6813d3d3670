"""Token counts of flat, unindexed token files.

Such a file is a run of token ids of two bytes, in which an end-of-document id closes each document; nothing says where documents lie.
Blocks of fixed size are searched at once for the separator. A block knows its separators only; a prefix scan over the blocks of a
file (running count of separators, running last separator) then gives each block the document that it begins in and where that began.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .op05_packing import TOKENIZER, encoding_of

SEPARATOR, BLOCK_BYTES = 50256, 4 << 20
#: Blocks that a task scans, about: tasks are told by the bytes in the files, which rows that only name blocks don't show.
TASK_BLOCKS = 16


def _writer(folder: str, shipped, separator: int):
    def write(batches):
        encode, fs, out, n = encoding_of(shipped.value).encode_to_numpy, None, None, 0
        end = np.array([separator], "<u2").tobytes()
        for batch in batches:
            if out is None:
                fs, local = pafs.FileSystem.from_uri(folder)
                fs.create_dir(local, recursive=True)
                name = f"{folder}/{uuid.uuid4().hex}.bin"  # of this attempt alone; only a finished task's rows name it
                out = fs.open_output_stream(f"{local}/{name.rpartition('/')[2]}")
            for text in batch.column(1):
                ids = encode(text.as_py(), disallowed_special=())
                if len(ids) and int(ids.max()) > 0xFFFF or (ids == separator).any():
                    raise ValueError("ids must fit two bytes and not be the separator")
                out.write(ids.astype("<u2").tobytes() + end)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(batch)), pa.array(np.arange(n, n + len(batch))), batch.column(0)], names=["file", "ordinal", "doc_id"])
            n += len(batch)
        if out is not None:
            out.close()

    return write


def write_token_files(docs: DataFrame, tokenizer: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """Writes the ids of every text, and a separator after each, to flat files in the shared folder. Returns (file, ordinal, doc_id), a
    written table, which says what was meant to lie where; the scan doesn't use it. Null texts are not
    written; an empty one is a separator alone; repeated rows are written each, very long texts whole; rows with the same or no doc_id are
    told by their place; an empty table writes nothing. Ids over 65,535, or equal to the separator, raise."""
    common.bound_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text")).where("text IS NOT NULL")
    folder = common.new_path(docs.sparkSession, "tokens")
    return common.materialise(common.dealt(rows, docs).mapInArrow(_writer(folder, common.shipped_file(docs.sparkSession, tokenizer), separator), "file string, ordinal long, doc_id long"), "token-files")


def _sizes(frames):
    for pdf in frames:
        sizes = []
        for name in pdf["file"]:
            fs, local = pafs.FileSystem.from_uri(name)
            sizes.append(fs.get_file_info(local).size)
        yield pd.DataFrame({"file": pdf["file"], "size": sizes})


def _scanner(separator: int, block_bytes: int):
    def scan(frames):
        for pdf in frames:
            for name, block in zip(pdf["file"], pdf["block"]):
                fs, local = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(local) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, f.size() - block * block_bytes) & ~1, block * block_bytes), "<u2")
                at = np.flatnonzero(ids == separator) + block * (block_bytes // 2)
                row = (name, block, len(ids), at, len(at), int(at[-1]) if len(at) else None)
                yield pd.DataFrame([row], columns=["file", "block", "ids", "at", "n", "last"]).astype({"last": "Int64"})

    return scan


def blocks_of(files: DataFrame, block_bytes: int) -> DataFrame:
    """(file, block) of every block of the files, each file once, in as many partitions as their bytes call for."""
    sized = files.select("file").where("file IS NOT NULL").distinct().mapInPandas(_sizes, "file string, size long").where("size >= 2")
    sized = common.materialise(sized, "file-sizes")
    tasks = max(1, -(-(sized.agg(F.sum("size")).first()[0] or 0) // (block_bytes * TASK_BLOCKS)))
    return sized.select("file", F.explode(F.sequence(F.lit(0), F.expr(f"(size - 1) div {block_bytes}"))).alias("block")).repartition(tasks, "file", "block")


def count_tokens(files: DataFrame, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """files (file) to (file, ordinal, n_tokens, closed): every document of every file, in order from 0.

    Two separators in a row hold a document of no tokens. Ids after the last separator are one more document, which is not closed. A
    file of no ids has no document, and an odd last byte is no id. A file named twice is read once, a null name not at all; no files
    give no rows.
    """
    assert block_bytes % 2 == 0
    blocks = blocks_of(files, block_bytes).mapInPandas(_scanner(separator, block_bytes), "file string, block long, ids long, at array<long>, n long, last long")
    found = common.materialise(blocks, "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open"))
    placed = found.where("n > 0").join(scan, ["file", "block"]).select("file", "base", "open", "at", F.posexplode("at").alias("k", "end"))
    closed = placed.select("file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("end") - F.when(F.col("k") > 0, F.try_element_at("at", F.col("k"))).otherwise(F.col("open")) - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = found.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.sum("ids") - 1 - F.coalesce(F.max("last"), F.lit(-1))).alias("n_tokens"))
    return closed.unionByName(tails.where("n_tokens > 0").withColumn("closed", F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in the flat files; documents are told by their place in the file.

    A null text isn't written and has no row; an empty one counts 0. Repeated rows count each. Extra columns play no part.
    """
    written = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return count_tokens(written).join(written, ["file", "ordinal"]).select("doc_id", "n_tokens", "closed")

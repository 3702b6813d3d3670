"""Exact dedup by an exchange of Golomb-coded fingerprints.

Rows have a 64-bit fingerprint of their text, kept in a written table. Each sender, some files of it, is read where it is coded: it sorts
its fingerprints and sends every owner of a range of fingerprints a Golomb code of the gaps, about two bits more than the entropy, in place
of the fingerprints. An owner decodes what it got and answers each sender with a bitmap of those that another sender, or the same one
twice, has too; the sender reads its files again and names those rows. So fingerprints cross no exchange but as codes. Only the texts of
those suspects move, and are compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows of a sender, about, and at most those of a file of the table of fingerprints.
SENDER_ROWS = 1 << 19
#: Fingerprints that an owner gets, about, and so how many owners there are.
OWNER_ROWS = 1 << 20


def golomb_encode(sorted_values: np.ndarray, span: int) -> tuple[bytes, int]:
    """(code, remainder bits) of distinct sorted values below span: for each gap the quotient by a power of two in unary (ones
    ended by a zero), and the remainder in binary. The unary parts come first, then the remainders."""
    n = len(sorted_values)
    if not n:
        return b"", 0
    bits = max(int(np.floor(np.log2(max(span / n * 0.69, 1)))), 0)
    gaps = np.diff(sorted_values.astype(np.uint64), prepend=np.uint64(0))
    gaps[1:] -= np.uint64(1)
    q = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.ones(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    low = gaps & np.uint64((1 << bits) - 1)
    binary = np.empty((n, bits), np.uint8)
    for i in range(bits):
        binary[:, i] = (low >> np.uint64(i)) & np.uint64(1)
    return np.packbits(np.concatenate([unary, binary.ravel()])).tobytes(), bits


def golomb_decode(code: bytes, n: int, bits: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    stream = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(stream == 0)[:n]
    q = np.diff(ends, prepend=-1) - 1
    low = stream[ends[-1] + 1 :][: n * bits].reshape(n, bits)
    gaps = q.astype(np.uint64) << np.uint64(bits)
    for i in range(bits):
        gaps |= low[:, i].astype(np.uint64) << np.uint64(i)
    gaps[1:] += np.uint64(1)
    return np.cumsum(gaps, dtype=np.uint64)


def _rows_of(files: list[str]) -> tuple[np.ndarray, ...]:
    """f, r and fp of a sender's files, in their order."""
    parts = []
    for name in files:
        fs, local = pafs.FileSystem.from_uri(name)
        parts.append(pq.read_table(local, columns=["f", "r", "fp"], filesystem=fs))
    table = pa.concat_tables(parts)
    return tuple(table.column(i).to_numpy() for i in range(3))


def _send(owners: int):
    span = -(-(2**64) // owners)

    def send(frames):
        for pdf in frames:
            for s, files in zip(pdf["s"], pdf["files"]):
                value, count = np.unique(_rows_of(files)[2].view(np.uint64), return_counts=True)
                owner = (value // np.uint64(span)).astype(np.int64) if owners > 1 else np.zeros(len(value), np.int64)
                cut, rows = np.searchsorted(owner, np.arange(owners + 1)), []
                for o in np.flatnonzero(np.diff(cut)).tolist():
                    lo, hi = cut[o], cut[o + 1]
                    code, bits = golomb_encode(value[lo:hi] - np.uint64(o * span), span)
                    rows.append((s, int(o), int(hi - lo), bits, code, np.packbits(count[lo:hi] > 1).tobytes()))
                yield pd.DataFrame(rows, columns=["s", "o", "n", "bits", "code", "twice"])

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one owner: to each sender the bitmap of its fingerprints, in their order, that occur more than once over all."""
    parts = [golomb_decode(c, n, b) for c, n, b in zip(pdf["code"], pdf["n"], pdf["bits"])]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8))[:n].astype(bool) for t, n in zip(pdf["twice"], pdf["n"])]
    value, inverse, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    repeated = count > 1
    np.logical_or.at(repeated, inverse, np.concatenate(twice))
    flags = np.split(repeated[inverse], np.cumsum([len(p) for p in parts])[:-1])
    return pd.DataFrame({"s": pdf["s"], "o": pdf["o"], "bitmap": [np.packbits(x).tobytes() for x in flags], "n": pdf["n"]})


def _suspects(frames):
    for pdf in frames:
        for files, answers in zip(pdf["files"], pdf["answers"]):
            f, r, fp = _rows_of(files)
            inverse = np.unique(fp.view(np.uint64), return_inverse=True)[1]
            parts = sorted((a["o"], a["bitmap"], a["n"]) for a in answers)
            flags = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for _, b, n in parts]).astype(bool)
            some = flags[inverse]
            yield pd.DataFrame({"f": f[some], "r": r[some], "fp": fp[some]})


def exchange(prints: DataFrame) -> DataFrame:
    """Rows (f, r, fp) to those whose fp occurs more than once. (f, r) is a row's identity."""
    spark = prints.sparkSession
    path = common.new_path(spark, "fingerprints")
    prints.select("f", "r", "fp").write.option("maxRecordsPerFile", SENDER_ROWS).parquet(path)
    rows = spark.read.schema("f long, r long, fp long").parquet(path)
    n = rows.count()
    senders, owners = max(1, -(-n // SENDER_ROWS)), max(1, -(-n // OWNER_ROWS))
    files = rows.select(F.col("_metadata.file_path").alias("file")).distinct()
    sender = F.pmod(F.hash("file"), F.lit(senders)).cast("long").alias("s")
    named = common.materialise(files.groupBy(sender).agg(F.sort_array(F.collect_list("file")).alias("files")), "senders")
    codes = named.repartition(senders, "s").mapInPandas(_send(owners), "s long, o long, n long, bits int, code binary, twice binary")
    answers = codes.repartition(owners, "o").groupBy("o").applyInPandas(_answer, "s long, o long, bitmap binary, n long")
    told = answers.groupBy("s").agg(F.collect_list(F.struct("o", "bitmap", "n")).alias("answers"))
    return named.join(told, "s").repartition(senders, "s").mapInPandas(_suspects, "f long, r long, fp long")


def copies(known: DataFrame) -> DataFrame:
    """(f, r, n) of the rows whose fingerprint another row has: n is the number of rows with just this text for the one that stays (of
    the least doc_id, null last, then by a hash of the whole row), null for those that go. rows come with identities."""
    rows = known.select("f", "r", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"), common.content_hash(known).alias("c")).where("text IS NOT NULL")
    suspects = common.materialise(exchange(rows.select("f", "r", F.xxhash64("text").alias("fp"))), "suspects")
    texts = rows.join(common.small_enough(suspects, 24), ["f", "r"]).select("fp", "text", F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "c", "f", "r").alias("k"))
    # bytes are compared as the grouping key; partial aggregation collapses a hot text within each task first
    groups = texts.groupBy("fp", "text").agg(F.min("k").alias("k"), F.count("*").alias("n"))
    winners = groups.select(F.col("k.f").alias("f"), F.col("k.r").alias("r"), "n")
    return suspects.join(winners, ["f", "r"], "left").select("f", "r", "n")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs but for all save one of those with the same text byte by byte; all columns, extra ones included.

    Null texts are not equal to each other: all such rows stay; empty texts are equal. Ties of doc_id go by a hash of the
    row, and of wholly repeated rows one stays. Texts are compared whole; an empty table stays empty.
    """
    known = common.with_row_id(docs)
    return common.without(known, common.materialise(copies(known), "copies").where("n IS NULL").select("f", "r"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that stays, with the number of rows that have its text."""
    known = common.with_row_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    marked = common.materialise(copies(known), "copies").select("f", "r", F.coalesce("n", F.lit(0)).alias("n"))
    joined = known.select("f", "r", F.col("doc.doc_id").alias("doc_id")).join(common.small_enough(marked, 24), ["f", "r"], "left")
    return joined.where("n IS NULL OR n > 0").select("doc_id", F.coalesce("n", F.lit(1)).cast("long").alias("n_copies"))


SQL = "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id, 1 FROM documents WHERE text IS NULL"

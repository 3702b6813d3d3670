"""Helpers shared by the corpus operators: the shared folder, row identities, and numpy views of Arrow text."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: Sides of a join are broadcast up to this many bytes; beyond it the join shuffles.
BROADCAST_LIMIT = 32 << 20
#: Text handled at once by one numpy pass. Longer documents make a slice of their own.
SLICE_BYTES = 1 << 19
U64 = np.uint64


#: Bytes of text that go to a worker at once, where the session has Spark's own setting of 64 MB: buffers on either side follow it.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, with the default file system's scheme if it has none. Where it is unset, a temporary folder
    of this application on a local master, as in tests; on a cluster that raises, as no executor's own disk is shared."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.applicationId not in _OWN:
            _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessella-")
            atexit.register(_remove_local, _OWN[sc.applicationId])
        found = _OWN[sc.applicationId]
    elif ":" not in found:
        path = sc._jvm.org.apache.hadoop.fs.Path(found)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        found = path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString().replace("file:/", "file:///", 1)
    return found.rstrip("/")


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    if not _MADE:
        atexit.register(sweep)
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def sweep() -> None:
    """Deletes the intermediate tables that this driver made, once results that read them are written; at exit it happens by itself, as
    far as Spark can still be reached."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    try:
        while _MADE and sc is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except (Py4JError, OSError):
        pass


def shipped_file(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a file that only the driver need have."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns a scan of it: lineage ends there and no executor holds the only copy."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_id(docs: DataFrame) -> DataFrame:
    """(doc, f, r): each row as a struct, so that no column of it can clash with ours, and a stable identity of it, equal rows
    included: file hash and row number of a scan. Any plan that isn't one scan is written to the shared folder first."""
    bound_batches(docs.sparkSession)
    ids = (F.struct("*").alias("doc"), F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    try:
        return docs.select(*ids)
    except AnalysisException:
        return materialise(docs, "rows").select(*ids)


#: What a scan gives a task at least, where it can split its files: Spark's own default.
SPLIT_BYTES = 4 << 20


def dealt(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows, made of docs row by row, dealt out to all cores where docs is so small that its scan would leave cores idle: a file of one row
    group is one task. Larger tables are left as their scan parts them. The result has the same rows either way."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPLIT_BYTES else rows


def _hashable(kind: DataType) -> bool:
    parts = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []
    return not isinstance(kind, (MapType, VariantType)) and all(map(_hashable, parts))


def content_hash(known: DataFrame) -> Column:
    """A hash of all that is in a row with an identity (but maps), by which ties go before they go by place: rows that it doesn't tell apart
    are equal, so the table's folder and files have no bearing on a result."""
    names = ["doc.`" + f.name.replace("`", "``") + "`" for f in known.schema["doc"].dataType.fields if _hashable(f.dataType)]
    return F.expr(f"xxhash64({', '.join(names)})") if names else F.lit(0).cast("long")


def numbered_texts(known: DataFrame) -> DataFrame:
    """(f, r, doc_id, text) from rows with identities; nulls are still there."""
    return known.select("f", "r", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))


def without(known: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows, as they came, of all identities that gone (f, r) doesn't have."""
    return known.join(small_enough(gone, 16), ["f", "r"], "left_anti").select("doc.*")


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df marked for broadcast if its counted rows stay under the limit, else df as it is (the join then shuffles)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def spread(docs: DataFrame, k: int) -> DataFrame:
    """docs without all but k files (by name), evenly spaced in the listing, where it scans more files than that; else docs itself."""
    files = sorted({unquote(f.rpartition("/")[2]) for f in docs.inputFiles()})
    if len(files) <= k:
        return docs
    return docs.where(F.col("_metadata.file_name").isin([files[i * len(files) // k] for i in range(k)]))


def text_of(docs: DataFrame) -> Column:
    return docs["text"].cast("string")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply rounds), in place on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        n = max(n, SLICE_BYTES + (1 << 16))
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of (values[i] + 1) * base**i over s <= i < e."""
    p = np.empty(len(values) + 1, U64)
    p[0] = 0
    np.cumsum((values.astype(U64) + U64(1)) * powers(len(values) + 1)[0][: len(values)], out=p[1:])
    return p


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span that does not depend on where the span lies."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first row, last row + 1) of runs of rows with at most limit bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def fold(b: np.ndarray) -> np.ndarray:
    """Lower case for ASCII letters and for the two-byte Latin-1 capitals."""
    b = b.copy()
    b[(b >= 65) & (b <= 90)] += 32
    after = np.zeros(len(b), bool)
    after[1:] = b[:-1] == 0xC3
    b[after & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)] += 0x20
    return b


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_WIDE = np.zeros(256, bool)
_WIDE[0xE3:0xEE] = True


def words(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word in order, the row it lies in, and the first word of every row (with an end).

    A word is a run of ASCII letters and digits and of non-ASCII bytes, case folded; each character of the scripts written
    without spaces (lead bytes E3 to ED) starts a word. offsets index b and begin at 0.
    """
    b = fold(b)
    inside = _WORD[b]
    fresh = np.ones(len(b) + 1, bool)
    fresh[1:-1] = ~inside[:-1]
    fresh[offsets[offsets < len(b)]] = True
    fresh[:-1] |= _WIDE[b]
    start = np.flatnonzero(inside & fresh[:-1])
    last = fresh[1:].copy()
    last[:-1] |= ~inside[1:]
    end = np.flatnonzero(inside & last) + 1
    h = span_hash(prefix_hash(b), start, end)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return h, row, first

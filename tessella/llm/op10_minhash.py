"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch has t coordinates. In round i < t every shingle falls into one bin by a hash of its own and offers i plus a fraction;
in round t + i every shingle offers to bin i. A bin keeps its least offer and the rounds end when no bin is empty, so that every
coordinate fills after at most 2t rounds, and after about (t ln t) / n for a document of n shingles; the share of equal coordinates
estimates the Jaccard similarity with the concentration of t independent hash functions.

Documents that share a band fall into a bucket. First each is compared exactly with the bucket's head of which it shares most bands, and
what is similar is joined. Then all pairs of a bucket that aren't joined are left: their sketches are compared where the bucket lies, and
those that aren't clearly apart are compared exactly. Groups are closed over pairs found similar, never over buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, graph
from .common import U64, mix

SHINGLE, COORDINATES, ROWS = 3, 128, 3
#: Jaccard similarity of the sets of word shingles from which two documents are near duplicates.
THRESHOLD = 0.5
#: A pair goes on to exact comparison if the share of equal coordinates is at most so much under the threshold: over two standard
#: deviations of the estimate, so that about one pair in a hundred just at the threshold is lost.
MARGIN = 0.1
#: Documents of a bucket whose sketches are compared together. A larger bucket is cut into blocks of so many, and every pair of blocks is
#: a task; so no task holds more than twice as many, and no pair is left out.
BLOCK_ROWS = 2048
#: Heads with which each document is compared first. That only spares comparisons; the result has no bearing on it.
HEADS = 2
EMPTY = U64(2**64 - 1)
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64) * U64(0xD1342543DE82EF95))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of every row, in order, and the first of each row (with an end). A row of fewer words has one
    shingle of all its words; a row without words has none."""
    h, row, first = common.words(data, offsets)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    last = np.repeat(first[1:], count) - 1
    out = np.zeros(len(at), U64)
    for j in range(k):
        word = np.where(at + j <= last, h[np.minimum(at + j, last)] if len(h) else 0, U64(j))
        out = out * U64(0x9E3779B97F4A7C15) + word
    return mix(out), bounds


def sketch(elements: np.ndarray, bounds: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The t coordinates of every row; t is a power of two up to 128. A row without elements keeps EMPTY throughout."""
    rows = len(bounds) - 1
    out = np.full(rows * t, EMPTY)
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    e = elements
    for i in range(2 * t):
        v = mix(e ^ _SEEDS[i])
        at = owner * t + ((v & U64(t - 1)).astype(np.int64) if i < t else i - t)
        np.minimum.at(out, at, (v >> U64(8)) | U64(i << 56))
        full = (out.reshape(rows, t) != EMPTY).all(1)
        left = ~full[owner]
        if not left.all():
            owner, e = owner[left], e[left]
        if not len(e):
            break
    return out.reshape(rows, t)


def bands(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each run of coordinates; keys of different bands differ."""
    n, t = sketches.shape
    parts = sketches[:, : t // rows * rows].reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(1, t // rows + 1, dtype=U64), (n, t // rows)).copy()
    for j in range(rows):
        key = mix(key ^ parts[:, :, j]) * U64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


_SIGNED = "f long, r long, doc_id long, c long, h long, h2 long, bands array<long>, sketch binary"


def _signatures(batches):
    for batch in batches:
        data, off = common.utf8(batch.column(4))
        for lo, hi in common.slices(off):
            e, bounds = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            some = np.flatnonzero(np.diff(bounds))
            if not len(some):
                continue
            bounds = np.append(bounds[some], bounds[-1])
            whole = [common.span_hash(p, bounds[:-1], bounds[1:]).view(np.int64) for p in (common.prefix_hash(e), common.prefix_hash(mix(e)))]
            found = sketch(e, bounds)
            k = bands(found)
            lists = pa.ListArray.from_arrays(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32), k.ravel())
            short = (mix(found) & U64(255)).astype(np.uint8)  # a byte of each coordinate, for the estimate
            rows = pa.array(some + lo)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(4)), *map(pa.array, whole), lists, pa.array([x.tobytes() for x in short], pa.binary())], names=["f", "r", "doc_id", "c", "h", "h2", "bands", "sketch"])


def close_pairs(sketches: np.ndarray, labels: np.ndarray, threshold: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of rows with different labels that share enough bytes; with split, only pairs across it."""
    least, n = (threshold - MARGIN) * sketches.shape[1], len(sketches)
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(n if split is None else split):
        rest = np.flatnonzero(labels[i + 1 if split is None else split :] != labels[i]) + (i + 1 if split is None else split)
        for at in range(0, len(rest), BLOCK_ROWS):
            some = rest[at : at + BLOCK_ROWS]
            some = some[(sketches[some] == sketches[i]).sum(1) >= least]
            first.append(np.full(len(some), i))
            second.append(some)
    return np.concatenate(first), np.concatenate(second)


def _screen(threshold: float):
    def screen(batches):
        """Rows (key, a, b, own, id, label, sketch) sorted by the first four; a task (key, a, b) may go on in the next batch."""
        at, parts = None, []

        def close():
            own, ids, labels = (np.concatenate([p[i] for p in parts]) for i in range(3))
            sketches = np.concatenate([p[3] for p in parts])
            split = None if at[1] == at[2] else int((own == at[1]).sum())
            i, j = close_pairs(sketches, labels, threshold, split)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            key, a, b, own, ids, labels = (batch.column(i).to_numpy() for i in range(6))
            data, off = common.utf8(batch.column(6))
            sketches = data[off[0] : off[-1]].reshape(len(batch), -1)
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)]):
                task = (int(key[lo]), int(a[lo]), int(b[lo]))
                if task != at:
                    if parts:
                        yield from close()
                    at, parts = task, []
                parts.append((own[lo:hi], ids[lo:hi], labels[lo:hi], sketches[lo:hi].copy()))
        if parts:
            yield from close()

    return screen


def _similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both >= threshold * (len(a) + len(b) - both)


def _compare(threshold: float):
    def compare(batches):
        """Rows (a, b, text of a, text of b), those of one a together: a's shingles are made once a run."""
        last, mine = None, np.zeros(0, U64)

        def sets(column: pa.Array, lo: int, hi: int) -> list[np.ndarray]:
            data, off = common.utf8(column.slice(lo, hi - lo))
            e, bounds = shingles(data[off[0] : off[-1]], off - off[0])
            return [np.unique(e[x:y]) for x, y in zip(bounds, bounds[1:])]

        for batch in batches:
            a = batch.column(0).to_pylist()
            good = np.zeros(len(batch), bool)
            for lo, hi in common.slices(common.utf8(batch.column(3))[1]):
                for k, other in zip(range(lo, hi), sets(batch.column(3), lo, hi)):
                    if a[k] != last:
                        last, mine = a[k], sets(batch.column(2), k, k + 1)[0]
                    good[k] = _similar(mine, other, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return compare


def similar_pairs(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose texts (id, text) have at least the threshold as Jaccard similarity, as a written table."""
    second = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    both = second.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
    return common.materialise(both.mapInArrow(_compare(threshold), "a long, b long"), "similar")


def duplicates(known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(f, r) of the rows, given with identities, that go: all of each group but the one with the least doc_id (null last, then by
    a hash of the row). A group is a component of the graph of the pairs that share a band and whose shingle sets have at least the
    threshold as Jaccard similarity; rows of equal word sequences are together always.

    Null texts and texts without a word are in no group and all stay. Very long texts count whole. Repeated rows are one group.
    """
    rows = known.select("f", "r", F.col("doc.doc_id").cast("long").alias("doc_id"), common.content_hash(known).alias("c"), F.col("doc.text").cast("string").alias("text"))
    signed = common.materialise(common.dealt(rows.where("text IS NOT NULL"), known).mapInArrow(_signatures, _SIGNED), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "c", "f", "r")
    # equal word sequences first: one representative of each goes on
    first = signed.groupBy("h", "h2").agg(F.min(order).alias("k"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = common.materialise(first.select(F.monotonically_increasing_id().alias("id"), "*"), "representatives")
    repeated = reps.where("n > 1").select("h", "h2", F.col("k.f").alias("to_f"), F.col("k.r").alias("to_r"))
    copies = signed.select("f", "r", "h", "h2").join(common.small_enough(repeated, 32), ["h", "h2"]).where("f <> to_f OR r <> to_r").select("f", "r")
    # buckets of two and more, with the least id of each as its head
    bucket = Window.partitionBy("key")
    keyed = reps.select("id", F.explode("bands").alias("key")).withColumn("head", F.min("id").over(bucket)).withColumn("last", F.max("id").over(bucket))
    members = common.materialise(keyed.where("head <> last").select("key", "id", "head"), "buckets")
    ids = common.materialise(members.select("id").distinct(), "candidates")
    kept = reps.join(common.small_enough(ids, 8), "id", "left_semi").select("id", "k", "sketch")
    kept = common.materialise(kept, "candidate-sketches")
    places = kept.select("id", F.col("k.f").alias("f"), F.col("k.r").alias("r"))
    texts = common.materialise(rows.select("f", "r", "text").join(common.small_enough(places, 24), ["f", "r"]).select("id", "text"), "candidate-texts")
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
    heads = members.where("id <> head").groupBy(F.col("head").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("n"))
    heads = common.materialise(heads.withColumn("best", best).where(F.col("best") <= HEADS).select("a", "b"), "heads")
    near = similar_pairs(heads, texts, threshold)
    joined = graph.components(near)
    # pairs of a bucket that are not joined yet
    labelled = members.join(joined.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("label"))
    mixed = labelled.withColumn("least", F.min("label").over(bucket)).withColumn("most", F.max("label").over(bucket)).withColumn("size", F.count("*").over(bucket)).where("least <> most")
    mixed = common.materialise(mixed.select("key", "id", "label", F.ceil(F.col("size") / BLOCK_ROWS).alias("blocks")), "mixed")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("own")
    tasks = mixed.join(kept.select("id", "sketch"), "id").select("*", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "label", "sketch")
    left = tasks.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "own").mapInArrow(_screen(threshold), "a long, b long")
    left = common.materialise(left.distinct().join(common.small_enough(heads, 16), ["a", "b"], "left_anti"), "left")
    late = similar_pairs(left, texts, threshold)
    if late.limit(1).count():
        joined = graph.components(near.unionByName(late))
    grouped = kept.join(joined, F.col("id") == F.col("node")).select("root", "k")
    stays = grouped.groupBy("root").agg(F.min("k").alias("stays"))
    gone = grouped.join(stays, "root").where("k <> stays").select(F.col("k.f").alias("f"), F.col("k.r").alias("r"))
    return gone.unionByName(copies)


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without all but one of each group of near duplicates (see duplicates()); all columns unchanged, extra ones
    and nulls in them included. An empty table gives an empty one."""
    known = common.with_row_id(docs)
    return common.without(known, common.materialise(duplicates(known, threshold), "gone"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id")

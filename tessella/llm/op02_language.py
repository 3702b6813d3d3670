"""Language identification by prediction by partial matching.

A byte context tree of variable order up to three is counted for each language on a bounded sample of labelled rows and then
frozen. A byte unseen in a context costs an escape (method C) to the next shorter context, with exclusion of the bytes that the
longer one offers, down to a uniform order of minus one; so every context holds a proper distribution over the 256 bytes, and a
document's code length under a language is exact. The language with the shortest code wins.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ORDER = 3
#: Bound of the labelled sample: whole documents of each language, in hash order, until either is reached.
TRAIN_DOCS, TRAIN_BYTES = 300, 1 << 19
#: Languages that are told apart at most: those with the most labels. Labels beyond are taken for dirt.
LANGUAGES = 64
#: Files, spread over the listing, from which a language's sample is drawn if they hold enough of it; else all are.
SAMPLE_FILES = 16
#: A document is in none of the languages if under the best its code takes more than so many bits a byte, and these besides, so that
#: a few unusual bytes don't decide on a short one. Prose takes 2 to 3 bits under its own language; encoded data and other scripts
#: take 6 and more under any.
REJECT_BITS, REJECT_SLACK = 4.5, 256


class Model(NamedTuple):
    languages: list[str]
    #: Number of symbols.
    width: int
    #: Byte to symbol; all bytes that no sample has share the last symbol.
    symbol: np.ndarray
    #: Node of the longest known context, by the three symbols before (one more symbol stands for none).
    node: np.ndarray
    #: Bits, by language, then node * symbols + symbol.
    bits: list[np.ndarray]


def train(samples: dict[str, list[bytes]]) -> Model:
    """Frozen statistics of each language's sample. Every document starts without a context."""
    languages = sorted(samples)
    seen = np.zeros(256, bool)
    for texts in samples.values():
        seen[np.frombuffer(b"".join(texts), np.uint8)] = True
    a = int(seen.sum()) + 1
    symbol = np.full(256, a - 1, np.int64)
    symbol[seen] = np.arange(a - 1)
    grams = {x: _grams(samples[x], symbol, a) for x in languages}
    # contexts by order as numbers of base a + 1, nearest symbol least
    contexts = [np.unique(np.concatenate([g[k] // a for g in grams.values()])) for k in range(ORDER + 1)]
    first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    bits = [_code_lengths(grams[x], contexts, first, a, 256 - (a - 1)) for x in languages]
    return Model(languages, a, symbol, _nodes(contexts, first, a), bits)


def _grams(texts: list[bytes], symbol: np.ndarray, a: int) -> list[np.ndarray]:
    """By order k: (context of k symbols) * a + next symbol, for every place in the texts."""
    out: list[list[np.ndarray]] = [[] for _ in range(ORDER + 1)]
    for t in texts:
        s = symbol[np.frombuffer(t, np.uint8)]
        for k in range(min(ORDER, max(len(s) - 1, 0)) + 1):
            context = np.zeros(max(len(s) - k, 0), np.int64)
            for j in range(1, k + 1):
                context += s[k - j : len(s) - j] * (a + 1) ** (j - 1)
            out[k].append(context * a + s[k:])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _code_lengths(grams: list[np.ndarray], contexts: list[np.ndarray], first: np.ndarray, a: int, unseen: int) -> np.ndarray:
    weight = np.ones(a)  # bytes for which a symbol stands
    weight[-1] = unseen
    p = np.full((first[-1], a), 1 / 256)
    for k, known in enumerate(contexts):
        if k:
            suffix = first[k - 1] + np.searchsorted(contexts[k - 1], known % (a + 1) ** (k - 1))
            lower = p[suffix]
        else:
            lower = np.full((1, a), 1 / 256)
        counts = np.zeros((len(known), a))
        gram, n = np.unique(grams[k], return_counts=True)
        counts[np.searchsorted(known, gram // a), gram % a] = n
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        left = ((counts == 0) * lower * weight).sum(1, keepdims=True)  # of the shorter context, after exclusion
        there, more = total > 0, left > 1e-12
        escaped = np.where(more, kinds / np.maximum(total + kinds, 1), 0)
        q = np.where(counts > 0, counts / np.maximum(total + np.where(more, kinds, 0), 1), escaped * lower / np.maximum(left, 1e-300))
        p[first[k] : first[k + 1]] = np.where(there, q, lower)
    return -np.log2(p).astype(np.float32).ravel()


def _nodes(contexts: list[np.ndarray], first: np.ndarray, a: int) -> np.ndarray:
    """Dense over (third, second, nearest) symbol; symbol a stands for the document's start."""
    b = a + 1
    out = np.zeros(b**ORDER, np.int32)
    for k in range(1, ORDER + 1):
        for i in range(0, len(contexts[k]), 1 << 16):
            c = contexts[k][i : i + (1 << 16)]
            for high in np.arange(b ** (ORDER - k)).reshape(-1, 1) if k < ORDER else [np.zeros(1, np.int64)]:
                out[high * b**k + c] = first[k] + i + np.arange(len(c))
    return out


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each row under each language; offsets index data and begin at 0."""
    a = model.width
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    if not len(data):
        return out
    s = model.symbol[data]
    b = a + 1
    context = np.empty(len(s), np.int64)
    before = np.full(len(s), a, np.int64)
    starts = offsets[:-1][np.diff(offsets) > 0]
    context[:] = 0
    for j in range(1, ORDER + 1):
        before[:] = a
        before[j:] = s[:-j]
        for i in range(j):
            cut = starts + i
            before[cut[cut < len(s)]] = a
        context += before * b ** (j - 1)
    # a short row's start may lie within the next rows' first places: those are marked by their own start
    at = model.node[context].astype(np.int64) * a + s
    rows = np.flatnonzero(np.diff(offsets) > 0)
    for k, bits in enumerate(model.bits):
        out[rows, k] = np.add.reduceat(bits[at], starts, dtype=np.float64)
    return out


def labelled_sample(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, seed: int = 11, languages: int = LANGUAGES, files: int = SAMPLE_FILES) -> dict[str, list[bytes]]:
    """Whole texts of each labelled language, train_docs or train_bytes of them (the document that passes the bound is in), or all if
    there are fewer.

    Rows are drawn in the order of a hash of doc_id, text and place in the file, so that null or equal ids don't matter, nor where the table
    lies. Only rows with a text that isn't empty count. Of many files, some are read for the languages of which those hold enough, all for
    the others. The bound in bytes is applied before anything goes to the driver. No labels give no sample.
    """
    label = docs["lang"].cast("string")
    most = docs.groupBy(label.alias("x")).count().where("x IS NOT NULL").orderBy(F.desc("count"), "x").limit(languages).collect()
    counts = {r[0]: r[1] for r in most}
    part = common.spread(docs, files)
    found: dict[str, list[bytes]] = {}
    if part is not docs and counts:
        found = {x: t for x, t in _drawn(part, list(counts), train_docs, train_bytes, seed).items() if len(t) >= min(train_docs, counts[x]) or sum(map(len, t)) >= train_bytes}
    rest = [x for x in counts if x not in found]
    return found | (_drawn(docs, rest, train_docs, train_bytes, seed) if rest else {})


def _drawn(docs: DataFrame, languages: list[str], train_docs: int, train_bytes: int, seed: int) -> dict[str, list[bytes]]:
    known = common.with_row_id(docs).select("f", "r", F.col("doc.lang").cast("string").alias("x"), F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").cast("string").alias("t"))
    known = known.where(F.col("x").isin(languages) & (F.col("t") != ""))
    rank = F.row_number().over(Window.partitionBy("x").orderBy("k", "r", "f"))
    drawn = known.select("x", "f", "r", F.xxhash64("doc_id", "t", "r", F.lit(seed)).alias("k"), F.octet_length("t").alias("size")).withColumn("rank", rank).where(F.col("rank") <= train_docs)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("x").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumn("before", before).where(F.col("before") < train_bytes).select("f", "r", "rank")
    chosen = known.join(F.broadcast(drawn), ["f", "r"]).select("x", "rank", "t")  # at most train_docs rows a language
    out: dict[str, list[bytes]] = {}
    for x, _, t in sorted(chosen.collect()):
        out.setdefault(x, []).append(t.encode())
    return out


def identify(docs: DataFrame, reject_bits: float = REJECT_BITS, model: Model | None = None) -> DataFrame:
    """(doc, language, bits): the rows of docs that are in one of the languages, as structs, so that no column of theirs can clash with
    ours, and the bits a byte under the language.

    Null and empty texts have no language and are rejected, as is a text whose shortest code takes more than reject_bits a byte and
    REJECT_SLACK in all.
    Ties go to the language that sorts first. Repeated rows are judged each on its own. Where no row has a label, there is nothing
    to tell languages by: all rows stay, with null in both columns. An empty table gives an empty one. Texts count whole.
    """
    columns = docs.columns
    carried = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)), common.text_of(docs).alias("text"))
    doc = F.struct(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns))).alias("doc")
    return _scored(docs, carried, reject_bits, model).select(doc, "language", "bits")


def _scored(docs: DataFrame, carried: DataFrame, reject_bits: float, model: Model | None) -> DataFrame:
    """carried (anything, and last a text) without the text, but with language and bits; rejected rows are left out."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    if model is None:
        samples = labelled_sample(docs)
        if not samples:
            return carried.drop("text").withColumns({"language": F.lit(None).cast("string"), "bits": F.lit(None).cast("double")})
        model = train(samples)
    shipped = spark.sparkContext.broadcast(model)

    def score(batches):
        m = shipped.value
        for batch in batches:
            data, off = common.utf8(batch.column(batch.num_columns - 1))
            total = np.concatenate([code_lengths(m, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in common.slices(off)] or [np.zeros((0, len(m.languages)))])
            size = np.diff(off)
            best = total.argmin(1) if len(total) else np.zeros(0, int)
            rate = total[np.arange(len(total)), best] / np.maximum(size, 1)
            keep = pa.array((size > 0) & (rate * size <= reject_bits * size + REJECT_SLACK))
            names = pa.array(m.languages, pa.string()).take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], names, pa.array(rate)], schema=pa.schema([*list(batch.schema)[:-1], pa.field("language", pa.string()), pa.field("bits", pa.float64())])).filter(keep)

    kept = carried.drop("text").schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "language string, bits double"])
    return common.dealt(carried, docs).mapInArrow(score, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs in one of its languages; where lang is null it gets the language found, all else is unchanged. Text passes through the
    scoring, so nothing is joined."""
    label = F.coalesce(F.col("doc.lang").cast("string"), F.col("language")).cast(docs.schema["lang"].dataType)
    return identify(docs).select(F.col("doc").withField("lang", label).alias("doc")).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = _scored(docs, docs.select("doc_id", common.text_of(docs).alias("text")), REJECT_BITS, None)
    return found.select("doc_id", "language", F.round("bits", 4).alias("bits_per_byte"))

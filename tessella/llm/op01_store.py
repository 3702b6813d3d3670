"""A content-addressed store of token ids.

Texts become streams of token ids. A rolling hash over the last WINDOW ids cuts every stream where the content says so, so that equal
passages give equal chunks wherever they lie. A chunk is named by the SHA-256 of its ids (little-endian, two or four bytes) and stored
once. A document's recipe lists its chunks. When a text is cut, its chunks are read back and compared with the whole stream, and the
stream's own digest and the root of the Merkle tree over the chunks' names are taken. The root is taken again from the recipe as stored,
where each stored chunk is also hashed again: equal roots over intact chunks that gave the stream when cut verify that the recipe gives
it back, without moving it. reconstruct() moves it, and the stream's digest then tells.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .op05_packing import TOKENIZER, encoding_of

WINDOW, LEAST, MOST, MASK_BITS = 16, 64, 1024, 8
#: Digests that a task remembers to send a chunk's ids once; when full it forgets, and the exchange drops the repeats.
REMEMBERED = 1 << 18
_GEAR = (common.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def candidates(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash allows a cut: the hash of the WINDOW ids up to there, newest weighted least, has its top
    MASK_BITS bits clear."""
    h = _GEAR[ids & 0xFFFF] ^ (ids >> 16).astype(np.uint32)
    k = 1
    while k < WINDOW:  # sums over 2k ids from sums over k
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        k *= 2
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def cuts(n: int, allowed: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream of n ids: the first allowed place from LEAST on, or MOST."""
    out, at, places = [], 0, allowed.tolist()
    i = 0
    while n - at > LEAST:
        while i < len(places) and places[i] < at + LEAST:
            i += 1
        end = min(places[i] if i < len(places) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n or not n:
        out.append(n)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd one moves up as it is. Inner nodes and leaves are told apart by a prefix."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) & ~1 :]
    return level[0] if level else hashlib.sha256(b"\2").digest()


def as_bytes(ids: np.ndarray) -> bytes:
    """Two bytes an id, or four if one needs them (then each chunk says so by its first byte)."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return b"\4" + ids.astype("<u4").tobytes() if wide else b"\2" + ids.astype("<u2").tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[:1] == b"\4" else "<u2", offset=1).astype(np.int64)


_CUT = "f long, r long, doc_id long, seq int, n int, digest binary, root binary, stream binary, payload binary"
_NAMES = [x.split()[0] for x in _CUT.split(", ")]


def _cutter(shipped):
    def cut(batches):
        encode, known = encoding_of(shipped.value).encode_to_numpy, set()
        for batch in batches:
            rows, seq, n, digests, roots, streams, payloads = [], [], [], [], [], [], []

            def flush():
                at = pa.array(rows, pa.int64())
                kept = [pa.array(seq, pa.int32()), pa.array(n, pa.int32()), *(pa.array(x, pa.binary()) for x in (digests, roots, streams, payloads))]
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), *kept], names=_NAMES)

            for i, text in enumerate(batch.column(3)):
                ids = encode(text.as_py(), disallowed_special=())
                at, mine, back = 0, [], []
                flat = None if len(ids) and int(ids.max()) > 0xFFFF else ids.astype("<u2").tobytes()
                for k, end in enumerate(cuts(len(ids), candidates(ids))):
                    data = as_bytes(ids[at:end]) if flat is None else b"\2" + flat[2 * at : 2 * end]
                    digest = hashlib.sha256(data).digest()
                    mine.append(digest)
                    back.append(data)
                    rows.append(i)
                    seq.append(k)
                    n.append(end - at)
                    payloads.append(None if digest in known else data)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known.add(digest)
                    at = end
                whole = np.concatenate([from_bytes(x) for x in back]) if flat is None else b"".join([x[1:] for x in back])
                if not (np.array_equal(whole, ids) if flat is None else whole == flat):
                    raise ValueError("the chunks of a stream do not give it back")
                digests += mine
                roots += [merkle(mine), *[None] * (len(mine) - 1)]
                streams += [stream_digest(ids), *[None] * (len(mine) - 1)]
                if len(rows) >= 8192:
                    yield flush()
                    for x in (rows, seq, n, digests, roots, streams, payloads):
                        x.clear()
            if rows:
                yield flush()

    return cut


def stream_digest(ids: np.ndarray) -> bytes:
    """SHA-256 of a whole stream, four bytes an id."""
    return hashlib.sha256(ids.astype("<u4").tobytes()).digest()


def build(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The store as a written table: a row for each chunk of each document's recipe, in which the ids (payload) of every
    distinct chunk are there exactly once, at the first row that sent them.

    Null texts have no row; an empty one has a chunk without ids; repeated rows have each their recipe, of the same chunks; texts are cut
    whole; an empty table gives an empty store; extra columns play no part.
    """
    known = common.with_row_id(docs)
    rows = common.dealt(common.numbered_texts(known).where("text IS NOT NULL"), docs)
    cut = rows.mapInArrow(_cutter(common.shipped_file(docs.sparkSession, tokenizer)), _CUT)
    # only rows with ids meet by digest; the others, however often their chunk occurs, spread by place
    slot = F.when(F.col("payload").isNotNull(), F.col("digest")).otherwise(F.encode(F.concat_ws("/", "f", "r", "seq"), "utf-8"))
    rank = F.row_number().over(Window.partitionBy("slot").orderBy("f", "r", "seq"))
    once = cut.withColumn("slot", slot).withColumn("rank", rank).withColumn("payload", F.when(F.col("rank") == 1, F.col("payload"))).drop("rank", "slot")
    path = common.new_path(docs.sparkSession, "chunks")
    once.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(once.schema).parquet(path)


def chunks(store: DataFrame) -> DataFrame:
    """(digest, n, payload): every distinct chunk, once."""
    return store.where("payload IS NOT NULL").select("digest", "n", "payload")


def manifests(store: DataFrame) -> DataFrame:
    """(f, r, doc_id, n_tokens, n_chunks, merkle_root, stream, verified, recipe) of every document in the store; (f, r) is its row.

    verified: every chunk of the recipe is stored once, with as many ids, its stored ids hash to its name, places run from 0, and the
    recipe's Merkle root is the one that the text gave. Null and repeated doc_ids don't matter, as rows are told by place; an empty store
    has no manifest.
    """
    stored = chunks(store).select("digest", F.col("n").alias("stored_n"), (F.unhex(F.sha2("payload", 256)) == F.col("digest")).alias("intact"))
    stored = stored.groupBy("digest").agg(F.min("stored_n").alias("stored_n"), ((F.count("*") == 1) & F.bool_and("intact")).alias("intact"))
    rows = store.select("f", "r", "doc_id", "seq", "n", "digest", "root", "stream").join(stored, "digest", "left")
    rows = rows.withColumn("good", F.coalesce(F.col("intact") & (F.col("n") == F.col("stored_n")), F.lit(False)))
    docs = rows.groupBy("f", "r").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.count("*").alias("n_chunks"), F.max("seq").alias("last"), F.max("root").alias("root"), F.max("stream").alias("stream"), F.bool_and("good").alias("good"), F.sort_array(F.collect_list(F.struct("seq", "digest"))).alias("parts"))
    docs = docs.withColumn("recipe", F.col("parts.digest"))

    @F.pandas_udf("binary")
    def root_of(recipe: pd.Series) -> pd.Series:
        return recipe.map(lambda x: merkle(list(x)))

    verified = F.col("good") & (F.col("last") == F.col("n_chunks") - 1) & F.coalesce(root_of("recipe") == F.col("root"), F.lit(False))
    return docs.select("f", "r", "doc_id", "n_tokens", "n_chunks", F.lower(F.hex("root")).alias("merkle_root"), F.lower(F.hex("stream")).alias("stream"), verified.alias("verified"), "recipe")


def reconstruct(store: DataFrame, recipes: DataFrame) -> DataFrame:
    """(doc_id, ids, intact) of the given manifests' documents, from their recipes and the stored chunks; intact says that the ids have the
    stream's digest. Repeated rows and null doc_ids are told by their place and come back each; a document of no ids gives an empty
    list; no manifest gives no row; a recipe with a chunk that isn't stored gives what is there, not intact."""
    parts = recipes.select("f", "r", "doc_id", "stream", F.posexplode("recipe").alias("seq", "digest"))
    joined = parts.join(chunks(store).select("digest", "payload"), "digest", "left")
    whole = joined.groupBy("f", "r").agg(F.first("doc_id").alias("doc_id"), F.first("stream").alias("stream"), F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("p"))

    @F.pandas_udf("ids array<long>, digest string")
    def ids(parts: pd.Series) -> pd.DataFrame:
        found = [np.concatenate([np.zeros(0, np.int64), *(from_bytes(p) for p in x if p is not None)]) for x in parts]
        return pd.DataFrame({"ids": found, "digest": [stream_digest(x).hex() for x in found]})

    return whole.select("doc_id", "stream", ids(F.col("p.payload")).alias("x")).select("doc_id", F.col("x.ids").alias("ids"), (F.col("x.digest") == F.col("stream")).alias("intact"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole store: a row for every document's manifest, verified, and one for every distinct chunk, whose name (in digest) the recipes
    give and whose ids are in payload; the other kind's columns are null.

    A null text has no stream and no manifest; an empty one has a recipe of one chunk without ids. Very long texts are cut whole.
    Repeated rows have each their manifest, of the same chunks. Extra columns play no part, and an empty table gives no row.
    """
    store = build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    stored = chunks(store).select(F.lit("chunk").alias("kind"), F.col("n").cast("long").alias("n_tokens"), "digest", "payload")
    return manifests(store).drop("f", "r").withColumn("kind", F.lit("document")).unionByName(stored, True)

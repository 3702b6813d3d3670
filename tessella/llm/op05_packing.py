"""Best-fit packing by a grouping genetic algorithm on islands.

Documents (their tokens and one separator) go into bins of a fixed number of tokens. A document longer than a bin is cut; its full
pieces fill bins of their own and the rest is an item like any other. Items are spread over shards of bounded size by a hash, so
that the work grows with the input and every shard is a problem of the same kind. Several islands evolve each shard: a crossover
injects whole well-filled bins of one parent into another, removes the bins in which their documents lie already, and puts
the displaced documents back by best fit, longest first. After every epoch each island's elite migrates to the next one of its shard.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
#: Items of a shard, about; islands that evolve each; epochs, between which elites migrate; generations in each; packings of an island.
SHARD_ITEMS, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2048, 3, 3, 10, 6
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding_of(data: bytes):
    """The tokenizer of the contents of a file of ranks (base64 of the bytes, rank)."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str):
    with open(path, "rb") as f:
        return encoding_of(f.read())


def _counter(shipped):
    def count(batches):
        encode = encoding_of(shipped.value).encode_to_numpy
        for batch in batches:
            n = pa.array([len(encode(t, disallowed_special=())) for t in (x.as_py() for x in batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], n], names=["c", "doc_id", "n"])

    return count


def best_fit(items: np.ndarray, lengths: np.ndarray, assign: np.ndarray, loads: list[int], capacity: int) -> None:
    """Puts items, longest first (ties by place), each into the fullest bin that has room, the first of equals, or into a new one.
    assign and loads are changed."""
    keys = sorted(((capacity - x) << 32) | i for i, x in enumerate(loads) if x < capacity)
    for i in items[np.lexsort((items, -lengths[items]))].tolist():
        size = int(lengths[i])
        at = bisect_left(keys, size << 32)
        if at < len(keys):
            key = keys.pop(at)
            bin_, room = key & 0xFFFFFFFF, (key >> 32) - size
            loads[bin_] += size
        else:
            bin_, room = len(loads), capacity - size
            loads.append(size)
        assign[i] = bin_
        if room:
            insort(keys, (room << 32) | bin_)


def _rebuilt(assign: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """With bins numbered from 0, and the items marked -1 put back by best fit."""
    out = assign.copy()
    kept = out >= 0
    _, out[kept] = np.unique(out[kept], return_inverse=True)
    loads = np.bincount(out[kept], lengths[kept]).astype(np.int64).tolist() if kept.any() else []
    best_fit(np.flatnonzero(~kept), lengths, out, loads, capacity)
    return out


def cross(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """a with whole bins injected from the better-filled half of b's."""
    loads = np.bincount(b, lengths)
    good = np.argsort(-loads, kind="stable")[: max(1, len(loads) // 2)]
    chosen = rng.choice(good, max(1, int(len(good) * rng.uniform(0.2, 0.6))), replace=False)
    injected = np.isin(b, chosen)
    out = np.where(np.isin(a, a[injected]), -1, a)
    out[injected] = b[injected] + int(a.max()) + 1
    return _rebuilt(out, lengths, capacity)


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """a with its emptiest bins, and some others at random, dissolved and packed anew."""
    loads = np.bincount(a, lengths)
    n = len(loads)
    gone = np.concatenate([np.argsort(loads, kind="stable")[: max(1, n // 20)], rng.integers(0, n, max(1, n // 20))])
    return _rebuilt(np.where(np.isin(a, gone), -1, a), lengths, capacity)


def fitness(a: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins: of two packings with as many bins, the one with the fuller full bins is fitter."""
    loads = np.bincount(a, lengths) / capacity
    return float((loads**2).mean()) if len(loads) else 1.0


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after so many generations, fittest first; the fittest is never lost."""
    scored = sorted(((fitness(x, lengths, capacity), -i, x) for i, x in enumerate(population)), key=lambda s: s[:2], reverse=True)
    for g in range(generations):
        i, j = rng.choice(len(scored), 2, replace=len(scored) < 2)
        a, b = scored[min(i, j)][2], scored[max(i, j)][2]
        young = [cross(b, a, lengths, capacity, rng), mutate(scored[0][2], lengths, capacity, rng)]
        scored = sorted([*scored, *((fitness(x, lengths, capacity), -len(population) * (g + 2) - k, x) for k, x in enumerate(young))], key=lambda s: s[:2], reverse=True)[: len(population)]
    return [x for _, _, x in scored]


def _founders(capacity: int, islands: int, population: int):
    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf.sort_values(["c", "k", "piece"])["length"].to_numpy(np.int64)
        shard, rows = int(pdf["shard"].iloc[0]), []
        for island in range(islands):
            rng = np.random.default_rng([shard, island])
            first = np.full(len(lengths), -1)
            all_ = [_rebuilt(first, lengths, capacity)]
            while len(all_) < population:  # best fit after a random start
                some = first.copy()
                few = rng.permutation(len(lengths))[: max(1, len(lengths) // 8)]
                filled, load, bin_ = some, capacity + 1, -1
                for i in few.tolist():
                    load += int(lengths[i])
                    if load > capacity:
                        bin_, load = bin_ + 1, int(lengths[i])
                    filled[i] = bin_
                all_.append(_rebuilt(filled, lengths, capacity))
            rows.append((shard, island, lengths.astype(np.int32), np.concatenate(all_).astype(np.int32), fitness(all_[0], lengths, capacity)))
        return pd.DataFrame(rows, columns=["shard", "island", "lengths", "population", "fitness"])

    return found


_STATE = "shard long, island int, lengths array<int>, population array<int>, fitness double"


def _epoch(capacity: int, generations: int, epoch: int):
    def run(frames):
        for pdf in frames:
            rows = []
            for x in pdf.itertuples(index=False):
                lengths = np.asarray(x.lengths, np.int64)
                people = list(np.asarray(x.population, np.int64).reshape(-1, len(lengths)))
                if x.elite is not None:
                    people[-1] = np.asarray(x.elite, np.int64)
                people = evolve(lengths, people, capacity, generations, np.random.default_rng([x.shard, x.island, epoch]))
                rows.append((x.shard, x.island, x.lengths, np.concatenate(people).astype(np.int32), fitness(people[0], lengths, capacity)))
            yield pd.DataFrame(rows, columns=["shard", "island", "lengths", "population", "fitness"])

    return run


def items(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """(c, k, doc_id, n): every row of docs with a text, and its tokens with the separator. c is a hash of doc_id and text and k numbers the
    rows that share it; such rows are equal in all that counts here, so the table's name and files have no bearing on the packing."""
    common.bound_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text")).where("text IS NOT NULL")
    counted = common.dealt(rows.select(F.xxhash64("doc_id", "text").alias("c"), "doc_id", "text"), docs).mapInArrow(_counter(common.shipped_file(docs.sparkSession, tokenizer)), "c long, doc_id long, n long")
    k = F.row_number().over(Window.partitionBy("c").orderBy("doc_id", "n")).cast("long").alias("k")
    return common.materialise(counted.select("c", k, "doc_id", (F.col("n") + 1).alias("n")), "lengths")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, piece, start, length, bin): every piece of every document and the bin it lies in; no bin holds over capacity tokens.

    A null text has no tokens and isn't packed; an empty one is its separator. A text longer than a bin is cut, each full piece
    a bin of its own. Repeated rows are packed each on its own (doc_id then doesn't tell them apart, the bins do). An empty table
    gives an empty one. Other columns play no part. The packing is the same on every run over the same rows, wherever they lie.
    """
    counted = items(docs, capacity, tokenizer)
    whole = F.expr(f"n div {capacity}")
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {capacity}"))))
    pieces = pieces.select("c", "k", "doc_id", F.col("piece").cast("long").alias("piece"), (F.col("piece") < whole).alias("full"), F.when(F.col("piece") < whole, F.lit(capacity)).otherwise(F.col("n") % capacity).cast("long").alias("length"))
    start = (F.col("piece") * capacity).alias("start")
    full = pieces.where("full").select("doc_id", "piece", start, "length", F.concat_ws("-", F.lit("f"), "c", "k", "piece").alias("bin"))
    count = counted.where(f"n % {capacity} <> 0").count()
    shards = max(1, -(-count // shard_items))
    rest = pieces.where("NOT full").withColumn("shard", F.pmod(F.xxhash64("c", "k"), F.lit(shards)))
    state = common.materialise(rest.groupBy("shard").applyInPandas(_founders(capacity, ISLANDS, POPULATION), _STATE), "islands")
    for epoch in range(EPOCHS):
        elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.expr("slice(population, 1, size(lengths))").alias("elite"))
        joined = state.join(elite, ["shard", "island"]) if epoch else state.withColumn("elite", F.lit(None).cast("array<int>"))
        state = common.materialise(joined.repartition("shard", "island").mapInPandas(_epoch(capacity, GENERATIONS, epoch), _STATE), "islands")
    best = state.groupBy("shard").agg(F.max_by(F.expr("slice(population, 1, size(lengths))"), F.struct("fitness", -F.col("island"))).alias("bins"))
    members = rest.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("c", "k", "piece", "doc_id", "length"))).alias("members"))
    packed = members.join(best, "shard").select("shard", F.explode(F.arrays_zip("members", "bins")).alias("x"))
    packed = packed.select(F.col("x.members.doc_id").alias("doc_id"), F.col("x.members.piece").alias("piece"), (F.col("x.members.piece") * capacity).alias("start"), F.col("x.members.length").alias("length"), F.concat_ws("-", F.lit("s"), "shard", "x.bins").alias("bin"))
    return packed.unionByName(full)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

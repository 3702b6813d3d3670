"""Readers of cohorts, audits, result grids, dense indexes, candidate and label caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import schemas
from tessella.functions.scalars import is_safe_name
from tessella.operators import relate


def read_cohort(spark: SparkSession, path: str, need_unlabelled: bool = True) -> DataFrame:
    """Samples of a cohort document. It must state its size rightly, hold safe and unique names and, where asked, that it was
    made without ground truth."""
    doc = spark.read.schema(schemas.COHORT).option("multiLine", True).json(path)
    head = doc.select("cohort_size", "generated_without_gt", F.size("samples").alias("n")).first()
    if head is None or head["n"] is None or head["n"] < 1:
        raise ValueError("the cohort has no samples")
    if head["cohort_size"] is not None and head["cohort_size"] != head["n"]:
        raise ValueError(f"cohort_size is {head['cohort_size']} for {head['n']} samples")
    if need_unlabelled and head["generated_without_gt"] is not True:
        raise ValueError("the cohort must be generated without ground truth")
    rows = doc.select(F.explode("samples").alias("s")).select("s.*")
    if rows.where(~is_safe_name(F.col("image_name")) | F.col("dataset").isNull()).limit(1).count():
        raise ValueError("a sample has an unsafe name or no dataset")
    relate.require_unique(rows, "image_name")
    return rows


def read_audit(spark: SparkSession, path: str, schema: str = schemas.AUDIT) -> DataFrame:
    """Audit records, a JSON object a line; blank lines are skipped and broken ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_exact_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose header is exactly the schema's names in order, with or without a byte order mark."""
    want = [f.name for f in T._parse_datatype_string(schema)]
    head = spark.read.text(path).limit(1).first()
    if head is None or head[0].lstrip("﻿").strip() != ",".join(want):
        raise ValueError(f"the header must be {','.join(want)}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(path)


def read_seed_results(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Results of a complete grid: no repeated, unknown or missing (group, seed, dataset)."""
    rows, keys = read_exact_csv(spark, path, schemas.SEED_RESULT), ["group", "seed", "dataset"]
    relate.require_unique(rows, keys)
    for bad, what in ((rows.join(expected, keys, "left_anti"), "unknown"), (expected.join(rows, keys, "left_anti"), "missing")):
        first = bad.select(*keys).orderBy(*keys).limit(1).collect()
        if first:
            raise ValueError(f"{what} row {tuple(first[0])}")
    return rows


def read_dense_index(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(position, file) of an index document {"0": file, "1": file, ...}; keys must run from 0 without gaps."""
    doc = spark.read.text(path, wholetext=True)
    rows = doc.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "file")).select(F.col("k").try_cast("long").alias("position"), "file")
    n = relate.require_dense_index(rows, "position")
    if expected is not None and n != expected:
        raise ValueError(f"{n} entries where {expected} are expected")
    return rows


def label_cache(spark: SparkSession, root: str, extractor: str, mode: str, datasets: str) -> DataFrame:
    """Rows of the partitioned cache (extractor=/mode=/dataset=) for A+B+... ; only those partitions are read."""
    return spark.read.parquet(root).where((F.col("extractor") == extractor) & (F.col("mode") == mode) & F.col("dataset").isin(datasets.split("+")))


def write_label_cache(rows: DataFrame, root: str) -> None:
    rows.write.mode("append").partitionBy("extractor", "mode", "dataset").parquet(root)


def legacy_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row for each image of a document {image_name: {...}}."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", schemas.LEGACY_STATS)).alias("image_name", "s")).select("image_name", "s.*")


def named_paths(arguments: list[str]) -> dict[str, str]:
    """NAME=PATH arguments; names are unique and neither part is empty."""
    out: dict[str, str] = {}
    for a in arguments:
        name, eq, path = a.partition("=")
        if not eq or not name or not path or name in out:
            raise ValueError(f"bad or repeated argument {a}")
        out[name] = path
    return out


def read_maps(spark: SparkSession, index: str, folder: str, dims: int = 2, clip: bool = True) -> DataFrame:
    """(position, shape, data) of the NPY files that a dense index lists: floats, axes of length 1 dropped, of so many axes, held
    within 0..1 where asked. A listed file that isn't there, or of another shape, raises."""
    import numpy as np

    from tessella.sources.images import decode

    entries = read_dense_index(spark, index)
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    relate.require_same_keys(entries, files.join(entries, "file", "left_semi"), "file")

    def run(frames):
        for pdf in frames:
            arrays = [np.squeeze(decode(bytes(c)).astype(np.float32)) for c in pdf["content"]]
            for name, a in zip(pdf["file"], arrays):
                if a.ndim != dims:
                    raise ValueError(f"{name} has {a.ndim} axes where {dims} are expected")
            out = pdf[["position"]].copy()
            out["shape"] = [list(a.shape) for a in arrays]
            out["data"] = [(np.clip(a, 0, 1) if clip else a).ravel() for a in arrays]
            yield out

    return entries.join(files, "file").select("position", "file", "content").mapInPandas(run, "position long, shape array<int>, data array<float>")

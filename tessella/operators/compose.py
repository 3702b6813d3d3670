"""Whole jobs: composing a label artifact from sources, and evaluating label sets against ground truth."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import kernels, relate, select, stats
from tessella.sources import artifacts, images


def compose(spark: SparkSession, cohort: DataFrame, sources: list[tuple[str, str, DataFrame | None]], root: str | Path, experiment: str) -> Path:
    """Copies one label file for each cohort row into a new artifact: from the first source (name, folder, keys) that lists the name
    and has its file; keys None lists all. Everything is checked before the folder is made: every row must find a file. Writes audit.jsonl and
    a manifest with counts; copies are verified by hash."""
    if not artifacts.ID.fullmatch(experiment):
        raise ValueError(f"bad experiment id {experiment!r}")
    if (Path(root) / experiment).exists():
        raise FileExistsError(Path(root) / experiment)
    relate.require_unique(cohort, "image_name")
    tiers, files = [], None
    for name, folder, keys in sources:
        there = images.list_images(spark, folder).select("image_name", "path")
        if keys is not None:
            there = relate.include_keys(there, keys, "image_name")
        tiers.append((name, there))
        one = there.withColumn("source", F.lit(name))
        files = one if files is None else files.unionByName(one)
    chosen = relate.choose_source(cohort.select("dataset", "image_name"), "image_name", tiers, "none").join(files, ["image_name", "source"], "left")
    missing = [r[0] for r in select.first_few(chosen.where("path IS NULL"), [F.col("image_name")], 5).collect()]
    if missing:
        raise ValueError(f"no label for {', '.join(missing)}")
    out = artifacts.create(root, experiment)
    with artifacts.manifest(out, experiment=experiment) as state:
        (out / "labels").mkdir()
        audit = []
        for r in chosen.orderBy("dataset", "image_name").toLocalIterator():
            path = Path(r["path"].removeprefix("file:"))
            audit.append({"dataset": r["dataset"], "image_name": r["image_name"], "origin": r["source"], **artifacts.copy_verified(path, out / "labels" / path.name)})
        artifacts.write_jsonl(audit, out / "audit.jsonl")
        state["source_counts"] = {n: sum(a["origin"] == n for a in audit) for n, _, _ in sources}
        state["count"] = len(audit)
    return out


def evaluate(spark: SparkSession, truth: str, predictions: dict[str, str], fallbacks: dict[str, str] | None = None, include: DataFrame | None = None, bands: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(dataset, prediction, image_name, fallback, metrics...) of every prediction set against the ground truth, by file stem. A
    set with a fallback folder takes what it lacks from there; key sets must then be equal. Stems are filtered before files are
    read; rasters of a set are resized to the truth's size."""
    if any(b <= 0 for b in bands) or not predictions:
        raise ValueError("bands must be positive and there must be a prediction set")

    def listed(folder: str) -> DataFrame:
        df = images.list_images(spark, folder)
        return relate.include_keys(df, include, "image_name") if include is not None else df

    gt = listed(truth)
    relate.require_unique(gt, "image_name")
    if include is not None:
        absent = relate.unknown_members(include, gt, "image_name").limit(1).collect()
        if absent:
            raise ValueError(f"no ground truth for {absent[0][0]}")
    sets = None
    for name, folder in predictions.items():
        one = listed(folder).select("image_name", "content", F.lit(False).alias("fallback"))
        relate.require_unique(one, "image_name")
        if fallbacks and name in fallbacks:
            rest = listed(fallbacks[name]).select("image_name", "content", F.lit(True).alias("fallback"))
            one = one.unionByName(relate.exclude_keys(rest, one, "image_name"))
        relate.require_same_keys(gt, one, "image_name")
        one = one.withColumn("prediction", F.lit(name))
        sets = one if sets is None else sets.unionByName(one)
    pairs = gt.select("image_name", F.col("content").alias("truth"), F.element_at(F.split("path", "/"), -3).alias("dataset")).join(sets, "image_name")
    one = np.ones((2, 2), bool)
    names = list(kernels.pair_metrics(one, one, bands))
    whole = {"component_count", "component_count_delta", "component_count_error"}

    def run(frames):
        for pdf in frames:
            rows = []
            for t, c in zip(pdf["truth"], pdf["content"]):
                g, p = (images.as_gray(images.decode(bytes(x))) for x in (t, c))
                p = p if p.shape == g.shape else kernels.resize_bilinear(p, *g.shape)
                m = kernels.pair_metrics(np.asarray(p) > 127, g > 127, bands)
                rows.append([m[n] for n in names])
            out = pdf[["dataset", "prediction", "image_name", "fallback"]].reset_index(drop=True)
            for i, n in enumerate(names):
                out[n] = [r[i] for r in rows]
            yield out

    schema = "dataset string, prediction string, image_name string, fallback boolean, " + ", ".join(f"{n} {'long' if n in whole else 'double'}" for n in names)
    return pairs.select("dataset", "prediction", "image_name", "fallback", "truth", "content").mapInPandas(run, schema)


def summarise(facts: DataFrame, metrics: list[str], baseline: str | None = None, failure_below: float = -0.2) -> dict[str, DataFrame]:
    """Means with an ALL row, and paired differences from the baseline with the failure rate of IoU."""
    out = {"summary": stats.grouped_with_all(facts, ["prediction"], "dataset", stats.mean_columns(metrics))}
    if baseline is not None:
        d = relate.paired_with_baseline(facts, ["dataset", "image_name"], "prediction", baseline, metrics)
        aggs = [F.count("*").alias("n"), *(F.avg(f"d_{m}").alias(f"d_{m}") for m in metrics), stats.failure_rate(F.col("d_iou"), failure_below).alias("failure_rate")]
        out["comparison"] = stats.grouped_with_all(d, ["prediction"], "dataset", aggs)
    return out

"""Unified index, forced coverage, all box overlaps, and the older refinement, over the driver tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import kernels, legacy, raster, select
from tessella.registry import register

from .common import q6, r6, table
from .rasters import _PX, H, W, _maps, _pairs


@register(
    "unified_index",
    "SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id) - 1 AS position, d.source AS dataset, coalesce('gt/' || l.doc_id || '.png', 'coarse/' || d.doc_id || '.png') AS label_path, l.doc_id IS NOT NULL AS has_gt FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def unified_index(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("gt/"), "doc_id", F.lit(".png")).alias("gt"))
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset")).join(l, "doc_id", "left")
    out = d.select("doc_id", "dataset", F.coalesce("gt", F.concat(F.lit("coarse/"), "doc_id", F.lit(".png"))).alias("label_path"), F.col("gt").isNotNull().alias("has_gt"))
    return select.ranked(out, [F.col("doc_id")])


@register("stratified_cohort")
def stratified_cohort(spark, sf):
    """Four of each route by reliability, with a rare and an empty case forced in."""
    e = table(spark, sf, "events").select("event_id", S.route(F.col("value") / 500).alias("route"), F.col("value").alias("reliability"), F.col("event_type"))
    forced = {"rare": F.col("event_id") % 997 == 3, "large": F.col("reliability") > 400}
    return select.stratified_cohort(e, "route", ["low", "medium", "high"], "reliability", "event_id", 4, forced)


@register(
    "full_box_overlaps",
    f"""WITH {_PX}, b AS (SELECT vec_id, min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0, max(x) + 1.0::DOUBLE AS x1, max(y) + 1.0::DOUBLE AS y1 FROM fg GROUP BY 1),
j AS (SELECT a.vec_id // 2 AS pair, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS s,
pow(greatest(a.x1, c.x1) - least(a.x0, c.x0), 2) + pow(greatest(a.y1, c.y1) - least(a.y0, c.y0), 2) + 1e-7 AS diagonal, (pow(c.x0 + c.x1 - a.x0 - a.x1, 2) + pow(c.y0 + c.y1 - a.y0 - a.y1, 2)) / 4 AS apart,
4 / (pi() * pi()) * pow(atan((c.x1 - c.x0) / (c.y1 - c.y0 + 1e-7)) - atan((a.x1 - a.x0) / (a.y1 - a.y0 + 1e-7)), 2) AS v FROM b a JOIN b c ON a.vec_id % 2 = 0 AND c.vec_id = a.vec_id + 1)
SELECT pair, {q6('i / (s - i + 1e-7) - apart / diagonal')} AS diou, {q6('i / (s - i + 1e-7) - (apart / diagonal + v * v / (v - i / (s - i + 1e-7) + (1 + 1e-7)))')} AS ciou FROM j""",
)
def full_box_overlaps(spark, sf):
    def box(c):
        m = raster.moments(raster.mask_of(F.col(c)), W)
        return [m["x0"].cast("double").alias(f"{c}x0"), m["y0"].cast("double").alias(f"{c}y0"), (m["x1"] + 1.0).alias(f"{c}x1"), (m["y1"] + 1.0).alias(f"{c}y1")]

    b = _pairs(spark, sf).select("pair", *box("p"), *box("g")).where("px0 IS NOT NULL AND gx0 IS NOT NULL")
    o = S.box_overlaps(*([F.col(f"{c}{k}") for k in ("x0", "y0", "x1", "y1")] for c in "pg"))
    return b.select("pair", r6(o["diou"]).alias("diou"), r6(o["ciou"]).alias("ciou"))


@register("legacy_refined")
def legacy_refined(spark, sf):
    """Choice and gate of the older refinement: three thresholds of one map against the other."""

    def run(p, g):
        rows = []
        for a, b in zip(p, g):
            rgb = np.repeat((np.clip(a + 0.5, 0, 1) * 255)[:, :, None], 3, 2)
            out = legacy.refine([a > t for t in (-0.05, 0.0, 0.05)], [0.8, 0.7, 0.6], b > 0, rgb)
            rows.append((int(out["label"].sum()), -1 if out["index"] is None else out["index"], out["decision"]))
        area, index, decision = zip(*rows)
        return {"area": np.array(area, np.int64), "chosen": np.array(index, np.int64), "decision": np.array(decision, object)}

    return raster.map_rasters(_pairs(spark, sf), ["pair"], ["p", "g"], H, W, run, "area long, chosen long, decision string")


@register("edge_aware_masks")
def edge_aware_masks(spark, sf):
    """Masks snapped to their map by the bilateral solver, where the result stays close."""

    def run(v):
        found = [legacy.snapped(x > 0, np.repeat((np.clip(x + 0.5, 0, 1) * 255)[:, :, None], 3, 2)) for x in v]
        return {"area": np.array([m.sum() for m, _ in found], np.int64), "snapped": np.array([u for _, u in found], bool)}

    return raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, run, "area long, snapped boolean")


@register("sampled_prompts")
def sampled_prompts(spark, sf):
    """Points inside, outside the grown box, and cautiously between, seeded by the raster's key."""

    def run(v, key):
        rows = []
        for x, k in zip(v, key[:, 0, 0].astype(int)):
            m = x > 0
            box = legacy.grown(legacy.box_of(m) or (0, 0, 0, 0), 0.3, H, W)
            rows.append((len(kernels.sampled_points(m, 5, k)), len(legacy.outside_points(box, H, W, 3, k)), len(legacy.cautious_points(m, box, 2, 2.0, k))))
        a, b, c = (np.array(x, np.int64) for x in zip(*rows))
        return {"inside": a, "outside": b, "cautious": c}

    keyed = _maps(spark, sf).withColumn("key", F.array_repeat(F.col("vec_id").cast("double"), H * W))
    return raster.map_rasters(keyed, ["vec_id"], ["embedding", "key"], H, W, run, "inside long, outside long, cautious long")

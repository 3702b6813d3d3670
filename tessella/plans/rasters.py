"""Raster metrics over embeddings: 64 values are an 8 x 8 map, values over 0 its mask; vec 2k predicts vec 2k + 1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import kernels, raster, stats
from tessella.registry import register

from .common import q6, r6, table

H = W = 8
E = "embedding"
_SUM = "list_sum(list_transform(range(1, 65), lambda i: {}))"


def _maps(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding")


def _pairs(spark, sf):
    e = _maps(spark, sf)
    p = e.where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("pair"), F.col("embedding").alias("p"))
    g = e.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("pair"), "label", F.col("embedding").alias("g"))
    return p.join(g, "pair")


_PAIR = "pr AS (SELECT a.vec_id // 2 AS pair, b.label, a.embedding AS p, b.embedding AS g FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1)"
_SOFT = "least(greatest(p[i]::DOUBLE + 0.5, 0), 1)"
_BASIC = f"""{_PAIR}, m AS (SELECT pair, label, {_SUM.format('CASE WHEN p[i] > 0 AND g[i] > 0 THEN 1 ELSE 0 END')}::BIGINT AS inter, {_SUM.format('CASE WHEN p[i] > 0 OR g[i] > 0 THEN 1 ELSE 0 END')}::BIGINT AS uni,
{_SUM.format('CASE WHEN p[i] > 0 THEN 1 ELSE 0 END')}::BIGINT AS pa, {_SUM.format('CASE WHEN g[i] > 0 THEN 1 ELSE 0 END')}::BIGINT AS ga, {_SUM.format(f'abs({_SOFT} - CASE WHEN g[i] > 0 THEN 1 ELSE 0 END)')} / 64 AS mae FROM pr),
x AS (SELECT pair, label, CASE WHEN uni = 0 THEN 1.0::DOUBLE ELSE inter::DOUBLE / uni END AS iou, mae, abs(pa - ga)::DOUBLE / greatest(ga, 1) AS area_error, pa, ga FROM m)"""


def _basic(spark, sf):
    p, g = raster.mask_of(F.col("p")), raster.mask_of(F.col("g"))
    r = _pairs(spark, sf).select("pair", "label", p.alias("pm"), g.alias("gm"), raster.soft_of(F.col("p")).alias("soft"))
    pa, ga = raster.area(F.col("pm")), raster.area(F.col("gm"))
    return r.select("pair", "label", raster.iou(F.col("pm"), F.col("gm")).alias("iou"), raster.mean_absolute(F.col("soft"), F.col("gm"), 64).alias("mae"), (F.abs(pa - ga) / F.greatest(ga, F.lit(1))).alias("area_error"), pa.alias("pa"), ga.alias("ga"))


@register("label_quality_summary", f"WITH {_BASIC} SELECT CASE WHEN grouping(label) = 1 THEN 'ALL' ELSE label::VARCHAR END AS dataset, count(*) AS n, {q6('avg(iou)')} AS iou, {q6('avg(mae)')} AS mae, {q6('avg(area_error)')} AS area_error, {q6('avg(CASE WHEN iou - 0.5 < -0.2 THEN 1.0 ELSE 0.0 END)')} AS catastrophic_rate FROM x GROUP BY GROUPING SETS ((label), ())")
def label_quality_summary(spark, sf):
    x = _basic(spark, sf).withColumnRenamed("label", "dataset").withColumn("z", F.lit(0))
    aggs = [F.count("*").alias("n"), *(r6(F.avg(c)).alias(c) for c in ("iou", "mae", "area_error")), r6(stats.failure_rate(F.col("iou") - 0.5)).alias("catastrophic_rate")]
    return stats.grouped_with_all(x, ["z"], "dataset", aggs).drop("z")


@register("pair_metrics_basic", f"WITH {_BASIC} SELECT pair, {q6('iou')} AS iou, {q6('mae')} AS mae, {q6('area_error')} AS area_error FROM x")
def pair_metrics_basic(spark, sf):
    return _basic(spark, sf).select("pair", *(r6(c).alias(c) for c in ("iou", "mae", "area_error")))


_PX = "px AS (SELECT vec_id, label, ((i - 1) // 8)::INTEGER AS y, ((i - 1) % 8)::INTEGER AS x, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), fg AS (SELECT vec_id, y, x FROM px WHERE v > 0)"


def _moments(spark, sf):
    m = raster.moments(raster.mask_of(E), W)
    return _maps(spark, sf).select("vec_id", "label", raster.area(raster.mask_of(E)).alias("area"), *(c.alias(k) for k, c in m.items()))


@register("mask_area_centroid", f"WITH {_PX} SELECT e.vec_id, count(f.y) AS area, {q6('avg(f.x)')} AS cx, {q6('avg(f.y)')} AS cy FROM embeddings e LEFT JOIN fg f USING (vec_id) GROUP BY 1")
def mask_area_centroid(spark, sf):
    return _moments(spark, sf).select("vec_id", "area", r6("cx").alias("cx"), r6("cy").alias("cy"))


@register("bounding_boxes", f"WITH {_PX} SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM fg GROUP BY 1")
def bounding_boxes(spark, sf):
    return _moments(spark, sf).where("area > 0").select("vec_id", "x0", "y0", "x1", "y1")


@register("weak_boxes", f"WITH {_PX}, b AS (SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM fg GROUP BY 1) SELECT vec_id, greatest(0, x0 - px) AS x0, greatest(0, y0 - py) AS y0, least(7, x1 + px) AS x1, least(7, y1 + py) AS y1 FROM (SELECT *, greatest(2, round_even((x1 - x0 + 1) * 0.1::DOUBLE, 0)::INTEGER) AS px, greatest(2, round_even((y1 - y0 + 1) * 0.1::DOUBLE, 0)::INTEGER) AS py FROM b)")
def weak_boxes(spark, sf):
    m = _moments(spark, sf).where("area > 0")
    box = S.padded_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), H, W)
    return m.select("vec_id", *(c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))))


@register("centroid_shift", f"WITH {_PX}, c AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy FROM fg GROUP BY 1) SELECT a.vec_id // 2 AS pair, {q6('CASE WHEN p.cx IS NULL AND g.cx IS NULL THEN 0.0 WHEN p.cx IS NULL OR g.cx IS NULL THEN 1.0 ELSE sqrt((p.cx - g.cx) ** 2 + (p.cy - g.cy) ** 2) / sqrt(128.0::DOUBLE) END')} AS shift FROM embeddings a LEFT JOIN c p ON p.vec_id = a.vec_id LEFT JOIN c g ON g.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0 AND a.vec_id + 1 IN (SELECT vec_id FROM embeddings)")
def centroid_shift(spark, sf):
    p, g = raster.moments(raster.mask_of(F.col("p")), W), raster.moments(raster.mask_of(F.col("g")), W)
    return _pairs(spark, sf).select("pair", r6(S.centroid_shift(p["cx"], p["cy"], g["cx"], g["cy"], H, W)).alias("shift"))


@register("box_overlaps", f"WITH {_PX}, b AS (SELECT vec_id, min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0, max(x) + 1.0::DOUBLE AS x1, max(y) + 1.0::DOUBLE AS y1 FROM fg GROUP BY 1), j AS (SELECT a.vec_id // 2 AS pair, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS s, (greatest(a.x1, c.x1) - least(a.x0, c.x0)) * (greatest(a.y1, c.y1) - least(a.y0, c.y0)) AS h FROM b a JOIN b c ON a.vec_id % 2 = 0 AND c.vec_id = a.vec_id + 1) SELECT pair, {q6('i / (s - i + 1e-7)')} AS iou, {q6('i / (s - i + 1e-7) - (h + 1e-7 - (s - i + 1e-7)) / (h + 1e-7)')} AS giou FROM j")
def box_overlaps(spark, sf):
    def box(c):
        m = raster.moments(raster.mask_of(F.col(c)), W)
        return [m["x0"].cast("double").alias(f"{c}x0"), m["y0"].cast("double").alias(f"{c}y0"), (m["x1"] + 1.0).alias(f"{c}x1"), (m["y1"] + 1.0).alias(f"{c}y1")]

    b = _pairs(spark, sf).select("pair", *box("p"), *box("g")).where("px0 IS NOT NULL AND gx0 IS NOT NULL")
    o = S.box_overlaps(*([F.col(f"{c}{k}") for k in ("x0", "y0", "x1", "y1")] for c in "pg"))
    return b.select("pair", r6(o["iou"]).alias("iou"), r6(o["giou"]).alias("giou"))


# neighbourhoods

_OFF = "o AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx))"
_DIL = f"{_PX}, {_OFF}, dil AS (SELECT DISTINCT vec_id, y + dy AS y, x + dx AS x FROM fg, o WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7), bgd AS (SELECT DISTINCT vec_id, y + dy AS y, x + dx AS x FROM (SELECT vec_id, y, x FROM px WHERE v <= 0), o WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)"


def _counted(name, kernel):
    def f(masks):
        return {name: kernel(masks > 0).sum((1, 2)).astype(np.int64)}

    return f


@register("dilate", f"WITH {_DIL} SELECT e.vec_id, count(d.y) AS area FROM embeddings e LEFT JOIN dil d USING (vec_id) GROUP BY 1")
def dilate(spark, sf):
    return raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, _counted("area", lambda m: kernels.dilate(m, kernels.square())), "area long")


@register("erode", f"WITH {_DIL} SELECT e.vec_id, 64 - count(d.y) AS area FROM embeddings e LEFT JOIN bgd d USING (vec_id) GROUP BY 1")
def erode(spark, sf):
    return raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, _counted("area", lambda m: kernels.erode(m, kernels.square())), "area long")


_EDGE = f"{_DIL}, edge AS (SELECT d.vec_id, d.y, d.x FROM dil d JOIN bgd b USING (vec_id, y, x))"


@register("boundary_pixels", f"WITH {_EDGE} SELECT e.vec_id, count(d.y) AS n FROM embeddings e LEFT JOIN edge d USING (vec_id) GROUP BY 1")
def boundary_pixels(spark, sf):
    return raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, _counted("n", kernels.gradient_boundary), "n long")


_INNER = f"{_PX}, inn AS (SELECT f.vec_id, f.y, f.x FROM fg f WHERE f.y IN (0, 7) OR f.x IN (0, 7) OR EXISTS (SELECT 1 FROM px b WHERE b.vec_id = f.vec_id AND b.v <= 0 AND abs(b.y - f.y) <= 1 AND abs(b.x - f.x) <= 1))"


@register("inner_boundary", f"WITH {_INNER} SELECT e.vec_id, count(d.y) AS n FROM embeddings e LEFT JOIN inn d USING (vec_id) GROUP BY 1")
def inner_boundary(spark, sf):
    return raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, _counted("n", lambda m: kernels.inner_boundary(m, 1)), "n long")


def _scores(spark, sf):
    return raster.map_rasters(_pairs(spark, sf), ["pair", "label"], ["p", "g"], H, W, lambda p, g: raster.boundary_scores(p, g, 1, 1), "bf double, p_b double, r_b double, boundary_iou double")


@register("bf_score", f"""WITH {_EDGE}, n AS (SELECT vec_id, count(*) AS n FROM edge GROUP BY 1),
hit AS (SELECT a.vec_id, count(*) AS n FROM edge a WHERE EXISTS (SELECT 1 FROM edge b WHERE b.vec_id = CASE WHEN a.vec_id % 2 = 0 THEN a.vec_id + 1 ELSE a.vec_id - 1 END AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 1) GROUP BY 1),
s AS (SELECT a.vec_id // 2 AS pair, CASE WHEN np.n > 0 AND ng.n > 0 THEN coalesce(hp.n, 0)::DOUBLE / np.n ELSE 0 END AS p, CASE WHEN np.n > 0 AND ng.n > 0 THEN coalesce(hg.n, 0)::DOUBLE / ng.n ELSE 0 END AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 LEFT JOIN n np ON np.vec_id = a.vec_id LEFT JOIN n ng ON ng.vec_id = b.vec_id LEFT JOIN hit hp ON hp.vec_id = a.vec_id LEFT JOIN hit hg ON hg.vec_id = b.vec_id WHERE a.vec_id % 2 = 0)
SELECT pair, {q6('p')} AS precision, {q6('r')} AS recall, {q6('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS bf FROM s""")
def bf_score(spark, sf):
    return _scores(spark, sf).select("pair", r6("p_b").alias("precision"), r6("r_b").alias("recall"), r6("bf").alias("bf"))


@register("boundary_iou", f"WITH {_INNER}, u AS (SELECT vec_id // 2 AS pair, y, x, count(*) AS n FROM inn GROUP BY 1, 2, 3), c AS (SELECT pair, count(*) AS uni, count(*) FILTER (WHERE n = 2) AS inter FROM u GROUP BY 1) SELECT a.vec_id // 2 AS pair, {q6('coalesce(inter::DOUBLE / uni, 1.0)')} AS boundary_iou FROM embeddings a LEFT JOIN c ON c.pair = a.vec_id // 2 WHERE a.vec_id % 2 = 0 AND a.vec_id + 1 IN (SELECT vec_id FROM embeddings)")
def boundary_iou(spark, sf):
    return _scores(spark, sf).select("pair", r6("boundary_iou").alias("boundary_iou"))


@register("proximity_matches", f"WITH {_EDGE} SELECT a.vec_id // 2 AS pair, count(*) AS n FROM edge a WHERE a.vec_id % 2 = 0 AND EXISTS (SELECT 1 FROM edge b WHERE b.vec_id = a.vec_id + 1 AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 4) GROUP BY 1")
def proximity_matches(spark, sf):
    """The spatial join relationally: boundary pixels of the prediction meet the truth's expanded by a disc of offsets, an equi-join."""
    edges = raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, lambda m: {"at": np.fromiter((np.flatnonzero(e) for e in kernels.gradient_boundary(m > 0)), object, len(m))}, "at array<long>")
    px = edges.select("vec_id", F.explode("at").alias("i")).select("vec_id", F.expr("i div 8").alias("y"), (F.col("i") % 8).alias("x"))
    disc = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx <= 4))
    near = px.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("pair"), "y", "x", F.explode(disc).alias("o")).select("pair", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    mine = px.where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("pair"), "y", "x")
    return mine.join(near, ["pair", "y", "x"]).groupBy("pair").agg(F.count("*").alias("n"))


# components

_CC = f"""WITH RECURSIVE {_PX}, l AS (SELECT vec_id, y, x, y * 8 + x AS seed FROM fg
UNION SELECT f.vec_id, f.y, f.x, l.seed FROM l JOIN fg f ON f.vec_id = l.vec_id AND abs(f.y - l.y) <= 1 AND abs(f.x - l.x) <= 1),
cc AS (SELECT vec_id, y, x, min(seed) AS c FROM l GROUP BY 1, 2, 3), ca AS (SELECT vec_id, c, count(*) AS a, avg(x) AS cx, avg(y) AS cy, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM cc GROUP BY 1, 2)"""


def _components(spark, sf, expected=1, least=4):
    return raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, lambda m: raster.component_columns(m, least, expected), raster.COMPONENT_SCHEMA)


@register("components", f"{_CC} SELECT e.vec_id, count(c) AS component_count, coalesce(sum(a), 0)::BIGINT AS foreground_area, coalesce(max(a), 0) AS largest_area FROM embeddings e LEFT JOIN ca USING (vec_id) GROUP BY 1")
def components(spark, sf):
    return _components(spark, sf).select("vec_id", "component_count", "foreground_area", "largest_area")


@register("component_profile", f"{_CC}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY a DESC) AS k FROM ca) SELECT e.vec_id, count(*) FILTER (WHERE a >= 4) AS effective, {q6('CASE WHEN count(c) = 0 THEN 1.0 ELSE coalesce(sum(a) FILTER (WHERE k <= 2), 0)::DOUBLE / sum(a) END')} AS top_k_mass, {q6('CASE WHEN count(c) = 0 THEN 0.0 ELSE 1 - coalesce(sum(a) FILTER (WHERE k <= 2), 0)::DOUBLE / sum(a) END')} AS extra_mass FROM embeddings e LEFT JOIN r USING (vec_id) GROUP BY 1")
def component_profile(spark, sf):
    return _components(spark, sf, 2).select("vec_id", F.col("effective_count").alias("effective"), r6("top_k_mass").alias("top_k_mass"), r6("extra_mass").alias("extra_mass"))


@register("largest_component", f"{_CC} SELECT vec_id, {q6('cx')} AS cx, {q6('cy')} AS cy, x0::BIGINT AS x0, y0::BIGINT AS y0, x1::BIGINT AS x1, y1::BIGINT AS y1 FROM ca QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, c) = 1")
def largest_component(spark, sf):
    return _components(spark, sf).where("foreground_area > 0").select("vec_id", r6("cx").alias("cx"), r6("cy").alias("cy"), "x0", "y0", "x1", "y1")


@register("component_count_error", f"{_CC}, n AS (SELECT e.vec_id, count(c) AS n FROM embeddings e LEFT JOIN ca USING (vec_id) GROUP BY 1) SELECT a.vec_id // 2 AS pair, a.n - b.n AS delta, abs(a.n - b.n) AS error FROM n a JOIN n b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1")
def component_count_error(spark, sf):
    c = _components(spark, sf).select("vec_id", "component_count")
    p = c.where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("pair"), F.col("component_count").alias("a"))
    g = c.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("pair"), F.col("component_count").alias("b"))
    return p.join(g, "pair").select("pair", (F.col("a") - F.col("b")).alias("delta"), F.abs(F.col("a") - F.col("b")).alias("error"))


@register("island_cleanup", f"{_CC}, s AS (SELECT cc.vec_id, cc.c, bool_or(px.v > 0.15) AS kept FROM cc JOIN px USING (vec_id, y, x) GROUP BY 1, 2) SELECT e.vec_id, count(s.c) AS before, count(*) FILTER (WHERE kept) AS after FROM embeddings e LEFT JOIN s USING (vec_id) GROUP BY 1")
def island_cleanup(spark, sf):
    def clean(v):
        labels = kernels.least_labels(v > 0).reshape(len(v), -1)
        flat = v.reshape(len(v), -1)
        before = np.array([len(np.unique(l[l >= 0])) for l in labels])
        after = np.array([len(np.unique(l[(l >= 0) & (x > 0.15)])) for l, x in zip(labels, flat)])
        return {"before": before, "after": after}

    return raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, clean, "before long, after long")


@register("look_twice", f"{_CC}, m AS (SELECT e.vec_id, coalesce(max(a), 0) AS a FROM embeddings e LEFT JOIN ca USING (vec_id) GROUP BY 1) SELECT vec_id, CASE WHEN m.a = 0 THEN 1 WHEN m.a / 64.0 >= 0.4 THEN 0 ELSE (SELECT count(*) FROM ca WHERE ca.vec_id = m.vec_id AND ca.a / 64.0 > 0.01) END::BIGINT AS boxes FROM m")
def look_twice(spark, sf):
    def boxes(v):
        return {"boxes": np.array([len(b) if (b := kernels.look_twice(m, 0.4)) is not None else 0 for m in v > 0], np.int64)}

    return raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, boxes, "boxes long")


# ratios, invariants, tiles


@register("transition_zone", f"SELECT vec_id, {q6('len(list_filter(embedding, lambda v: v::DOUBLE + 0.5 >= 0.4 AND v::DOUBLE + 0.5 <= 0.6)) / 64.0::DOUBLE')} AS ratio FROM embeddings")
def transition_zone(spark, sf):
    s = raster.soft_of(E)
    return _maps(spark, sf).select("vec_id", r6(raster.share(s, lambda v: (v >= 0.4) & (v <= 0.6), 64)).alias("ratio"))


_D = "list_transform(range(1, 65), lambda i: abs(p[i]::DOUBLE - g[i]::DOUBLE))"


@register("audit_ratios", f"WITH {_PAIR}, d AS (SELECT pair, {_D} AS d FROM pr) SELECT pair, " + ", ".join(f"{q6(f'len(list_filter(d, lambda v: v > {t})) / 64.0::DOUBLE')} AS {n}" for n, t in (("changed", "1 / 255.0::DOUBLE"), ("changed_01", "0.01"), ("changed_05", "0.05"), ("changed_10", "0.1"))) + f", {q6('list_sum(d) / 64')} AS mean_change FROM d")
def audit_ratios(spark, sf):
    d = F.zip_with("p", "g", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    r = _pairs(spark, sf).select("pair", d.alias("d"))
    cuts = (("changed", 1 / 255.0), ("changed_01", 0.01), ("changed_05", 0.05), ("changed_10", 0.1))
    over = lambda t: lambda v: v > t  # noqa: E731  a default argument would be taken for the element's index
    return r.select("pair", *(r6(raster.share(F.col("d"), over(t), 64)).alias(n) for n, t in cuts), r6(F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / 64).alias("mean_change"))


@register("control_audit", f"SELECT vec_id, {q6('list_min(e)')} AS lo, {q6('list_max(e)')} AS hi, {q6('list_sum(e) / 64')} AS mean, {q6('len(list_filter(e, lambda v: v > 0.5)) / 64.0::DOUBLE')} AS fg_ratio FROM (SELECT vec_id, list_transform(embedding, lambda v: least(greatest(v::DOUBLE + 0.5, 0), 1)) AS e FROM embeddings)")
def control_audit(spark, sf):
    r = _maps(spark, sf).select("vec_id", raster.soft_of(E).alias("s"))
    return r.select("vec_id", r6(F.array_min("s")).alias("lo"), r6(F.array_max("s")).alias("hi"), r6(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / 64).alias("mean"), r6(raster.share(F.col("s"), lambda v: v > 0.5, 64)).alias("fg_ratio"))


@register("invariant_failures", f"WITH {_PAIR} SELECT count(*) FILTER (WHERE NOT ok) AS failures, count(*) AS n FROM (SELECT {_SUM.format('CASE WHEN p[i] > 0.2 AND g[i] < -0.2 THEN 1 ELSE 0 END')} = 0 AS ok FROM pr)")
def invariant_failures(spark, sf):
    ok = F.forall(F.zip_with("p", "g", lambda a, b: ~((a > F.lit(0.2)) & (b < F.lit(-0.2)))), lambda x: x)
    return _pairs(spark, sf).select(ok.alias("ok")).agg(F.count_if(~F.col("ok")).alias("failures"), F.count("*").alias("n"))


@register("low_density", "SELECT vec_id, len(list_filter(embedding, lambda v: v > 0.2)) / 64.0 < 0.05 AS low FROM embeddings")
def low_density(spark, sf):
    return _maps(spark, sf).select("vec_id", (raster.share(E, lambda v: v > F.lit(0.2), 64) < 0.05).alias("low"))


@register("quantised_masks", "SELECT vec_id, len(list_filter(embedding, lambda v: round_even(least(greatest(v::DOUBLE + 0.5, 0), 1) * 255, 0) > 127)) AS area FROM embeddings")
def quantised_masks(spark, sf):
    return _maps(spark, sf).select("vec_id", F.size(F.filter(raster.soft_of(E), lambda v: F.rint(v * 255) > 127)).cast("long").alias("area"))


@register("tile_means", f"WITH {_PX} SELECT vec_id, (y // 4 * 2 + x // 4)::BIGINT AS tile, {q6('avg(v)')} AS mean FROM px GROUP BY 1, 2")
def tile_means(spark, sf):
    t = raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, lambda v: {"means": v.reshape(-1, 2, 4, 2, 4).mean((2, 4)).reshape(-1, 4)}, "means array<double>")
    return t.select("vec_id", F.posexplode("means").alias("tile", "mean")).select("vec_id", F.col("tile").cast("long").alias("tile"), r6("mean").alias("mean"))


@register("tile_merge", f"WITH {_PX}, t AS (SELECT vec_id, y, x, avg(v * (1 + ty * 2 + tx)) AS v FROM px, range(0, 2) a(ty), range(0, 2) b(tx) WHERE y BETWEEN ty * 3 AND ty * 3 + 4 AND x BETWEEN tx * 3 AND tx * 3 + 4 GROUP BY 1, 2, 3) SELECT vec_id, {q6('sum(v)')} AS total FROM t GROUP BY 1")
def tile_merge(spark, sf):
    corners = [(0, 0), (0, 3), (3, 0), (3, 3)]

    def merge(v):
        return {"total": np.array([kernels.merge_overlapping([x[a : a + 5, b : b + 5] * (1 + k) for k, (a, b) in enumerate(corners)], corners, 8, 8).sum() for x in v])}

    return raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, merge, "total double").select("vec_id", r6("total").alias("total"))


@register("center_crop", f"WITH {_PX} SELECT vec_id, {q6('sum(v)')} AS total FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY 1")
def center_crop(spark, sf):
    inner = [y * 8 + x for y in range(2, 6) for x in range(2, 6)]
    total = F.aggregate(F.transform(F.array(*map(F.lit, inner)), lambda i: F.get(E, i).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return _maps(spark, sf).select("vec_id", r6(total).alias("total"))


@register("entropy_windows", f"WITH {_PX}, e AS (SELECT vec_id, y // 2 AS wy, x // 2 AS wx, avg(-p * ln(greatest(p, 1e-5))) AS s FROM (SELECT *, least(greatest(v + 0.5, 0), 1) AS p FROM px) GROUP BY 1, 2, 3) SELECT vec_id, wy::BIGINT AS wy, wx::BIGINT AS wx FROM e WHERE s > 0.34")
def entropy_windows(spark, sf):
    def windows(v):
        p = np.clip(v + 0.5, 0, 1)
        return {"at": np.fromiter((x[:, 0] * 4 + x[:, 1] for x in (kernels.entropy_windows(q, 4, 0.34) for q in p)), object, len(p))}

    t = raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, windows, "at array<long>")
    return t.select("vec_id", F.explode("at").alias("k")).select("vec_id", F.expr("k div 4").alias("wy"), (F.col("k") % 4).alias("wx"))


# curves

_HIST = f"{_PAIR}, q AS (SELECT pair, label, i, floor((p[i] - list_min(p))::DOUBLE / (list_max(p) - list_min(p))::DOUBLE * 255)::INTEGER AS b, g[i] > 0 AS fg FROM (SELECT pair, label, list_transform(p, lambda v: v::DOUBLE) AS p, g FROM pr), range(1, 65) t(i)), c AS (SELECT pair, label, t, count(*) FILTER (WHERE fg AND b >= t) AS ff, count(*) FILTER (WHERE NOT fg AND b >= t) AS fb, count(*) FILTER (WHERE fg) AS n FROM q, range(0, 256) r(t) GROUP BY 1, 2, 3)"
_EM = "CASE WHEN n = 0 THEN (64 - ff - fb) WHEN n = 64 THEN (ff + fb) ELSE " + " + ".join(f"({c}) * pow(2 * ({a}) * ({b}) / (({a}) * ({a}) + ({b}) * ({b}) + 2.220446049250313e-16) + 1, 2) / 4" for c, a, b in (("ff", "1 - (ff + fb) / 64.0::DOUBLE", "1 - n / 64.0::DOUBLE"), ("fb", "1 - (ff + fb) / 64.0::DOUBLE", "-n / 64.0::DOUBLE"), ("n - ff", "-(ff + fb) / 64.0::DOUBLE", "1 - n / 64.0::DOUBLE"), ("64 - ff - fb - n + ff", "-(ff + fb) / 64.0::DOUBLE", "-n / 64.0::DOUBLE"))) + " END / (63 + 2.220446049250313e-16)"
_FM = "CASE WHEN ff = 0 THEN 0 ELSE 1.3 * (ff::DOUBLE / (ff + fb)) * (ff::DOUBLE / greatest(n, 1)) / (0.3 * (ff::DOUBLE / (ff + fb)) + ff::DOUBLE / greatest(n, 1)) END"


def _curves(spark, sf):
    def run(p, g):
        found = [(kernels.e_measure(*x)[1], kernels.f_measure(*x)[1]) for x in (kernels.prepared(a, (b > 0).astype(float)) for a, b in zip(p, g))]
        return {"em": np.stack([a for a, _ in found]), "fm": np.stack([b for _, b in found])}

    return raster.map_rasters(_pairs(spark, sf), ["pair", "label"], ["p", "g"], H, W, run, "em array<double>, fm array<double>")


def _curve(spark, sf, name):
    out = raster.curve_means(_curves(spark, sf), ["label"], name)
    return out.select("label", r6("max").alias("max"), r6("mean").alias("mean"))


@register("em_curve", f"WITH {_HIST}, m AS (SELECT label, t, avg({_EM}) AS v FROM c GROUP BY 1, 2) SELECT label, {q6('max(v)')} AS max, {q6('avg(v)')} AS mean FROM m GROUP BY 1")
def em_curve(spark, sf):
    return _curve(spark, sf, "em")


@register("fm_curve", f"WITH {_HIST}, m AS (SELECT label, t, avg({_FM}) AS v FROM c GROUP BY 1, 2) SELECT label, {q6('max(v)')} AS max, {q6('avg(v)')} AS mean FROM m GROUP BY 1")
def fm_curve(spark, sf):
    return _curve(spark, sf, "fm")


@register("auroc", f"WITH {_PAIR}, q AS (SELECT pair, p[i] AS s, g[i] > 0 AS fg FROM pr, range(1, 65) t(i)), r AS (SELECT pair, fg, rank() OVER (PARTITION BY pair ORDER BY s) + (count(*) OVER (PARTITION BY pair, s) - 1) / 2.0 AS k FROM q), a AS (SELECT pair, count(*) FILTER (WHERE fg) AS n1, count(*) FILTER (WHERE NOT fg) AS n0, sum(k) FILTER (WHERE fg) AS k FROM r GROUP BY 1) SELECT pair, {q6('(k - n1 * (n1 + 1) / 2.0) / (n1 * n0)::DOUBLE')} AS auroc FROM a WHERE n1 > 0 AND n0 > 0")
def auroc(spark, sf):
    out = raster.map_rasters(_pairs(spark, sf), ["pair"], ["p", "g"], H, W, lambda p, g: {"auroc": np.array([v if (v := kernels.auroc(a, b > 0)) is not None else np.nan for a, b in zip(p, g)])}, "auroc double")
    return out.where("NOT isnan(auroc)").select("pair", r6("auroc").alias("auroc"))


# arrow kernels without an oracle: tested on fixtures


@register("pair_metrics_full")
def pair_metrics_full(spark, sf):
    """Every pair metric, S-measure, weighted F and band metrics included."""
    out = raster.evaluate_pairs(_pairs(spark, sf), ["pair", "label"], "p", "g", H, W, (1, 2))
    return out.select("pair", "label", *(r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c not in ("pair", "label")))


def _enhanced(ff: str, fb: str) -> str:
    """The SQL of the enhanced alignment of a mask with so many pixels on and off the truth."""
    on, rest = f"({ff} + {fb})", f"(ga - {ff})"
    terms = ((ff, f"(1 - {on} / 64.0::DOUBLE)", "(1 - ga / 64.0::DOUBLE)"), (fb, f"(1 - {on} / 64.0::DOUBLE)", "(-ga / 64.0::DOUBLE)"), (rest, f"(-{on} / 64.0::DOUBLE)", "(1 - ga / 64.0::DOUBLE)"), (f"(64 - {on} - {rest})", f"(-{on} / 64.0::DOUBLE)", "(-ga / 64.0::DOUBLE)"))
    total = " + ".join(f"{n} * pow(2 * {a} * {b} / ({a} * {a} + {b} * {b} + 2.220446049250313e-16::DOUBLE) + 1, 2) / 4" for n, a, b in terms)
    return f"(CASE WHEN ga = 0 THEN 64 - {on} WHEN ga = 64 THEN {on} ELSE {total} END / 63.0::DOUBLE)"


def _f(tp: str, on: str) -> str:
    p, r = f"({tp} / greatest({on}, 1)::DOUBLE)", f"({tp} / greatest(ga, 1)::DOUBLE)"
    return f"(CASE WHEN {tp} = 0 THEN 0.0::DOUBLE ELSE 1.3 * {p} * {r} / (0.3 * {p} + {r}) END)"


_COUNTED = ("iou", "mae", "area_ratio", "absolute_area_error", "e_max", "e_mean", "f_max")
_COUNTS_SQL = {
    "iou": "CASE WHEN uni = 0 THEN 1.0::DOUBLE ELSE inter / uni::DOUBLE END",
    "mae": "(uni - inter) / 64.0::DOUBLE",
    "area_ratio": "pa / greatest(ga, 1)::DOUBLE",
    "absolute_area_error": "abs(pa - ga) / greatest(ga, 1)::DOUBLE",
    "e_max": f"greatest({_enhanced('inter', '(pa - inter)')}, {_enhanced('ga', '(64 - ga)')})",
    "e_mean": f"(255 * {_enhanced('inter', '(pa - inter)')} + {_enhanced('ga', '(64 - ga)')}) / 256",
    "f_max": f"greatest({_f('inter', 'pa')}, {_f('ga', '64')})",
}


@register("pair_metrics_counted", f"WITH {_BASIC} SELECT pair, label, {', '.join(f'{q6(_COUNTS_SQL[c])} AS {c}' for c in _COUNTED)} FROM m")
def pair_metrics_counted(spark, sf):
    """Those of the pair metrics that counts of pixels give, by the kernels, against SQL."""
    out = raster.evaluate_pairs(_pairs(spark, sf), ["pair", "label"], "p", "g", H, W)
    return out.select("pair", "label", *(r6(c).alias(c) for c in _COUNTED))


@register("metric_summary_ci")
def metric_summary_ci(spark, sf):
    """Mean and bootstrap bounds of IoU by label and over all."""
    x = _basic(spark, sf).select(F.col("label").cast("string").alias("dataset"), "pair", "iou")
    return stats.bootstrap(x.unionByName(x.withColumn("dataset", F.lit("ALL"))), ["dataset"], "pair", "iou").select("dataset", "n", *(r6(c).alias(c) for c in ("mean", "ci_lower", "ci_upper")))


@register("refined_labels")
def refined_labels(spark, sf):
    """The whole refinement of each map: localisation, route, prompts, candidates, choice, constraint, calibration."""

    def refine(p, g):
        rows = []
        for a, b in zip(p, g):
            coarse, semantic = np.clip(a + 0.5, 0, 1), np.clip(b + 0.5, 0, 1)
            coarse = (coarse - coarse.min()) / max(float(np.ptp(coarse)), 1e-9)
            rgb = np.repeat((semantic * 255)[:, :, None], 3, 2)
            found = kernels.localise(coarse, np.stack([semantic, 1 - semantic, coarse] * 3))
            prompts = kernels.prompts(coarse, found["probability"], found["route"])
            candidates = [{"prompt": x["name"], "index": i, "mask": semantic > t} for x in prompts for i, t in enumerate((0.4, 0.5, 0.6))]
            assessed = kernels.assess(candidates, coarse, found["probability"], rgb)
            limits = kernels.constraint(coarse, found["probability"], found["route"])
            out = kernels.calibrate(kernels.choose(assessed), assessed, coarse, found["probability"], rgb, limits)
            rows.append((found["route"], found["reliability"], len(prompts), len(candidates), out["fusion"]["changed_ratio"], out["growth"], out["fallback"]))
        names = ("route", "reliability", "prompts", "candidates", "changed_ratio", "growth", "fallback")
        return {n: np.array(v, object) if n in ("route", "fallback") else np.array(v) for n, v in zip(names, zip(*rows))}

    out = raster.map_rasters(_pairs(spark, sf), ["pair"], ["p", "g"], H, W, refine, "route string, reliability double, prompts long, candidates long, changed_ratio double, growth long, fallback string")
    return out.withColumns({c: r6(c) for c in ("reliability", "changed_ratio")})


@register("packed_masks", "SELECT vec_id, len(list_filter(embedding, lambda v: v > 0)) AS area, 8::BIGINT AS size, true AS same FROM embeddings")
def packed_masks(spark, sf):
    def pack(v):
        packed = [kernels.pack_mask(m) for m in v > 0]
        back = [kernels.unpack_mask(b, 8, 8) for b in packed]
        return {"area": np.array([b.sum() for b in back], np.int64), "size": np.array([len(b) for b in packed], np.int64), "same": np.array([(a == b).all() for a, b in zip(v > 0, back)], bool)}

    return raster.map_rasters(_maps(spark, sf), ["vec_id"], ["embedding"], H, W, pack, "area long, size long, same boolean")

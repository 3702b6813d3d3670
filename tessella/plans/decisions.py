"""Decision formulas, gates and schedules over events and literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.registry import register

from .common import q6, r6, table

_GAMMAS = (0.5, 1.0, 2.0, 5.0, 50.0)


@register("gate_sweep", f"SELECT g::DOUBLE AS gamma, " + ", ".join(f"{q6(f'100.0 * avg(CASE WHEN {t} THEN 1.0 ELSE 0.0 END)')} AS pct_{n}" for n, t in (("full", "s > 1.2"), ("fallback", "s < 0.4"), ("fusion", "s >= 0.4 AND s <= 1.2"))) + f" FROM (SELECT g, 0.7 + g * (value / 500) / 10 AS s FROM events, (VALUES {', '.join(f'({g}::DOUBLE)' for g in _GAMMAS)}) v(g)) GROUP BY 1")
def gate_sweep(spark, sf):
    gammas = F.explode(F.array(*map(F.lit, _GAMMAS))).alias("gamma")
    s = table(spark, sf, "events").select("value", gammas).withColumn("g", S.gate(0.7 + F.col("gamma") * (F.col("value") / 500) / 10, 0.4, 1.2))
    pct = lambda name: r6(100.0 * F.avg((F.col("g") == name).cast("int")))
    return s.groupBy("gamma").agg(pct("FULL").alias("pct_full"), pct("FALLBACK").alias("pct_fallback"), pct("FUSION").alias("pct_fusion"))


@register("gate_truth_table", f"SELECT s::DOUBLE AS score, m AS mask, c AS coarse, {q6('s * m + (1.0 - s) * c')} AS value, s * m + (1.0 - s) * c > 0.5 AS on FROM (VALUES (0.1::DOUBLE), (0.3), (0.6), (1.0), (1.2), (2.0), (5.0)) a(s), (VALUES (0), (1)) b(m), (VALUES (0), (1)) d(c)".replace(" AS on", ' AS "on"'))
def gate_truth_table(spark, sf):
    scores = spark.createDataFrame([(x,) for x in (0.1, 0.3, 0.6, 1.0, 1.2, 2.0, 5.0)], "score double")
    bits = lambda n: spark.createDataFrame([(0,), (1,)], f"{n} int")
    t = scores.crossJoin(bits("mask")).crossJoin(bits("coarse"))
    s, m, c = F.col("score"), F.col("mask"), F.col("coarse")
    return t.select("score", "mask", "coarse", r6(s * m + (1.0 - s) * c).alias("value"), S.fused_pixel(s, m, c).alias("on"))


_V = "value / 500"


@register("gate_scores", f"SELECT event_id, {q6(f'0.3 * {_V} + 0.4 * least({_V}, 0.5) + 0.3 * (1 - {_V})')} AS selection, {q6(f'0.3 * {_V} + 0.4 * least({_V}, 0.5) + 50 * (1 - {_V})')} AS gate FROM events")
def gate_scores(spark, sf):
    v = F.col("value") / 500
    return table(spark, sf, "events").select("event_id", r6(S.selection_score(v, F.least(v, F.lit(0.5)), 1 - v)).alias("selection"), r6(S.gate_score(v, F.least(v, F.lit(0.5)), 1 - v)).alias("gate"))


@register("gate_decisions", f"SELECT event_id, CASE WHEN s < 0.2 THEN 'FALLBACK' WHEN s > 999 THEN 'FULL' ELSE 'FUSION' END AS decision FROM (SELECT event_id, 0.3 * {_V} + 50 * ({_V} - 0.02) AS s FROM events)")
def gate_decisions(spark, sf):
    v = F.col("value") / 500
    return table(spark, sf, "events").select("event_id", S.gate(S.gate_score(v, F.lit(0.0), v - 0.02)).alias("decision"))


@register("apm_blend", f"SELECT event_id, {q6('w')} AS weight, {q6(f'{_V} * (1 - w) + 0.25 * w')} AS label FROM (SELECT *, least(greatest(0.5 * (1 + cos(abs({_V} - 0.4) * pi())) + (event_id % 25) / 30.0, 0), 1)::DOUBLE AS w FROM events)")
def apm_blend(spark, sf):
    v = F.col("value") / 500
    w = S.blend_weight(v, F.lit(0.4), F.col("event_id") % 25, 25, 5)
    return table(spark, sf, "events").select("event_id", r6(w).alias("weight"), r6(S.blended(v, F.lit(0.25), w)).alias("label"))


@register("ema_decay", f"SELECT event_id, {q6('least(1 - 1.0::DOUBLE / (event_id % 2000 + 1), 0.999)')} AS decay FROM events")
def ema_decay(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(S.ema_decay(F.col("event_id") % 2000)).alias("decay"))


@register("epoch_schedule", "SELECT e::BIGINT AS epoch, (e >= 20 AND (e - 20) % 2 = 0) AS late, (e >= 3 AND (e - 3) % 5 = 0) AS early FROM range(0, 25) t(e)")
def epoch_schedule(spark, sf):
    e = F.col("epoch")
    return spark.range(25).select(F.col("id").alias("epoch")).select("epoch", S.epoch_due(e, -5, 2, 25).alias("late"), S.epoch_due(e, 3, 5, 25).alias("early"))


@register("math_scores", f"SELECT event_id, {q6(f'1 / (1 + exp(-least(greatest(({_V} - 0.4) / 0.1, -20), 20)))')} AS sigmoid, {q6(f'least(2 * {_V}, 1)')} AS adaptive, {q6(f'-{_V} * ln(greatest({_V}, 1e-5))')} AS entropy FROM events")
def math_scores(spark, sf):
    v = F.col("value") / 500
    return table(spark, sf, "events").select("event_id", r6(S.sigmoid(v - 0.4, 0.1)).alias("sigmoid"), r6(S.adaptive_threshold(v)).alias("adaptive"), r6(S.entropy(v)).alias("entropy"))


@register("min_max_normalise", f"SELECT event_id, {q6('(value - lo) / (hi - lo)')} AS x FROM events JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) USING (event_type) WHERE hi <> lo")
def min_max_normalise(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    r = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(r, "event_type").select("event_id", r6(S.min_max(F.col("value"), F.col("lo"), F.col("hi"))).alias("x"))


@register("half_even_rounding", "SELECT event_id, round_even(value, 1) AS r FROM (SELECT event_id, floor(value) / 4.0::DOUBLE AS value FROM events)")
def half_even_rounding(spark, sf):
    return table(spark, sf, "events").select("event_id", F.bround(F.floor("value") / 4.0, 1).alias("r"))


@register("agreements", f"SELECT event_id, {q6('CASE WHEN a = 0 OR b = 0 THEN 0 ELSE least(a, b)::DOUBLE / greatest(a, b) END')} AS area, {q6('1.0::DOUBLE / (1 + abs(a - b))')} AS components, {q6('least(a + 1, b + 1)::DOUBLE / greatest(a + 1, b + 1)')} AS ratio FROM (SELECT event_id, floor(value)::BIGINT % 9 AS a, event_id % 7 AS b FROM events)")
def agreements(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.floor("value") % 9).alias("a"), (F.col("event_id") % 7).alias("b"))
    a, b = F.col("a"), F.col("b")
    return e.select("event_id", r6(S.area_agreement(a, b)).alias("area"), r6(S.component_agreement(a, b)).alias("components"), r6(S.ratio_score(a, b)).alias("ratio"))


@register("route_radius", "SELECT event_id, (CASE event_id % 3 WHEN 0 THEN least(greatest(round_even(0.05 * r, 0), 2), 12) WHEN 1 THEN least(greatest(round_even(0.1 * r, 0), 4), 20) ELSE 0 END)::INTEGER AS radius FROM (SELECT event_id, sqrt(greatest(floor(value) * 40, 1) / pi()) AS r FROM events)")
def route_radius(spark, sf):
    k = F.col("event_id") % 3
    route = F.when(k == 0, "high").when(k == 1, "medium").otherwise("low")
    return table(spark, sf, "events").select("event_id", S.route_radius(route, F.floor("value") * 40.0).alias("radius"))


_BOX = "(SELECT event_id, (event_id % 50)::INTEGER AS x, (event_id % 30)::INTEGER AS y, (event_id % 17 + 1)::INTEGER AS w, (event_id % 13 + 1)::INTEGER AS h FROM events)"


def _boxes(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", (i % 50).cast("int").alias("x"), (i % 30).cast("int").alias("y"), (i % 17 + 1).cast("int").alias("w"), (i % 13 + 1).cast("int").alias("h"))


@register("expanded_boxes", f"SELECT event_id, nx AS x, ny AS y, least(nw, 64 - nx)::INTEGER AS w, least(nh, 48 - ny)::INTEGER AS h FROM (SELECT *, greatest(0, trunc(x - (nw - w) / 2.0))::INTEGER AS nx, greatest(0, trunc(y - (nh - h) / 2.0))::INTEGER AS ny FROM (SELECT *, trunc(w * 1.3::DOUBLE)::INTEGER AS nw, trunc(h * 1.3::DOUBLE)::INTEGER AS nh FROM {_BOX}))")
def expanded_boxes(spark, sf):
    out = S.expanded_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 48, 64, 0.3)
    return _boxes(spark, sf).select("event_id", *(c.alias(n) for c, n in zip(out, "xywh")))


@register("look_twice_boxes", f"SELECT event_id, trunc(CASE WHEN nx + nw > 64 THEN 64 - nw ELSE nx END)::INTEGER AS x, trunc(CASE WHEN ny + nh > 48 THEN 48 - nh ELSE ny END)::INTEGER AS y, trunc(nw)::INTEGER AS w, trunc(nh)::INTEGER AS h FROM (SELECT *, greatest(x - (nw - w) / 2, 0) AS nx, greatest(y - (nh - h) / 2, 0) AS ny FROM (SELECT *, w * 1.3::DOUBLE AS nw, h * 1.3::DOUBLE AS nh FROM {_BOX}))")
def look_twice_boxes(spark, sf):
    out = S.look_twice_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 48, 64)
    return _boxes(spark, sf).select("event_id", *(c.alias(n) for c, n in zip(out, "xywh")))


@register("colour_transform", f"SELECT event_id, {q6('0.299 * r + 0.587 * g + 0.114 * b')} AS y, {q6('-0.168736 * r - 0.331264 * g + 0.5 * b + 128')} AS u, {q6('0.5 * r - 0.418688 * g - 0.081312 * b + 128')} AS v FROM (SELECT event_id, (event_id % 256)::DOUBLE AS r, (event_id * 7 % 256)::DOUBLE AS g, (event_id * 13 % 256)::DOUBLE AS b FROM events)")
def colour_transform(spark, sf):
    i = F.col("event_id")
    out = S.yuv((i % 256).cast("double"), (i * 7 % 256).cast("double"), (i * 13 % 256).cast("double"))
    return table(spark, sf, "events").select("event_id", *(r6(c).alias(n) for c, n in zip(out, "yuv")))

"""Prototypes, margins and seeds over embeddings; the label is the class or the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import vectors as V
from tessella.registry import register

from .common import q6, r6, table

_UNIT = "u AS (SELECT vec_id, label, i, embedding[i]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 1e-6) AS x FROM embeddings, range(1, 65) t(i))"
_PROTO = f"{_UNIT}, m AS (SELECT label, i, avg(x) AS x, count(*) AS n FROM u GROUP BY 1, 2), p AS (SELECT label, i, n, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-6) AS x FROM m)"


@register("prototype", f"WITH {_PROTO} SELECT label, n, i - 1 AS dim, {q6('x')} AS x FROM p")
def prototype(spark, sf):
    p = V.prototypes(table(spark, sf, "embeddings"), "label", "embedding")
    return p.select("label", "n", F.posexplode("prototype").alias("dim", "x")).select("label", "n", F.col("dim").cast("long").alias("dim"), r6("x").alias("x"))


_MARGIN = f"WITH {_PROTO}, g AS (SELECT vec_id, u.label, sum(u.x * a.x) - sum(u.x * b.x) AS margin FROM u JOIN p a ON a.i = u.i AND a.label = 1 JOIN p b ON b.i = u.i AND b.label = 0 GROUP BY 1, 2)"


def _margins(spark, sf):
    e = table(spark, sf, "embeddings")
    p = V.prototypes(e.where("label IN (0, 1)"), "label", "embedding")
    return V.margins(e.select("vec_id", "label", "embedding"), "embedding", p.where("label = 1"), p.where("label = 0"))


@register("prototype_margin", f"{_MARGIN} SELECT vec_id, {q6('margin')} AS margin FROM g")
def prototype_margin(spark, sf):
    return _margins(spark, sf).select("vec_id", r6("margin").alias("margin"))


@register("semantic_route", f"{_MARGIN}, s AS (SELECT vec_id, 1 / (1 + exp(-least(greatest(margin / 0.1, -20), 20))) AS p FROM g) SELECT vec_id, {q6('p')} AS probability, p > 0.5 AS foreground, CASE WHEN p >= 0.67 THEN 'high' WHEN p >= 0.33 THEN 'medium' ELSE 'low' END AS route FROM s")
def semantic_route(spark, sf):
    p = S.sigmoid(F.col("margin"), 0.1)
    return _margins(spark, sf).select("vec_id", r6(p).alias("probability"), (p > 0.5).alias("foreground"), S.route(p).alias("route"))


@register("seed_similarity", f"""WITH {_UNIT}, w AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda v: v::DOUBLE)) AS w FROM embeddings),
s AS (SELECT label, vec_id AS seed FROM w QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(w, 9), vec_id) = 1),
c AS (SELECT u.vec_id, u.label, sum(u.x * b.x) AS c FROM u JOIN s USING (label) JOIN u b ON b.vec_id = s.seed AND b.i = u.i GROUP BY 1, 2)
SELECT vec_id, {q6('c')} AS cosine, c > 0.1 AS background, {q6('CASE WHEN c > 0.1 THEN 0.0 ELSE (1 - c) / (max(1 - c) OVER (PARTITION BY label) + 1e-10) END')} AS dissimilarity FROM c""")
def seed_similarity(spark, sf):
    total = F.round(F.aggregate(V.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 9)
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding", total.alias("w"))
    out = V.similarity_to_seed(e, "vec_id", "embedding", "w", ["label"], 0.1)
    return out.select("vec_id", r6("cosine").alias("cosine"), "background", r6("dissimilarity").alias("dissimilarity"))


@register("head_weights", f"WITH q AS (SELECT label, vec_id, len(list_filter(embedding, lambda v: v > 0)) / 64.0::DOUBLE + 1e-10 AS q FROM embeddings) SELECT label, vec_id, {q6('ln(sum(q) OVER (PARTITION BY label) / q)')} AS beta FROM q")
def head_weights(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", (F.size(F.filter("embedding", lambda v: v > 0)) / 64.0).alias("q"))
    return V.head_weights(e, "label", "vec_id", "q").select("label", "vec_id", r6("beta").alias("beta"))

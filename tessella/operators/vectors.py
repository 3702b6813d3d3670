"""Vector operators on array columns, by higher-order functions: no exploding, no shuffle but for the grouped means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 1e-6) -> Column:
    """Scaled to length 1; vectors shorter than eps are divided by it. The length is bound once, by a list of it alone."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / F.greatest(n, F.lit(eps)))), 1)


def prototypes(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, n, prototype): unit mean of the unit vectors of each class."""
    units = rows.select(by, unit(doubles(F.col(vector))).alias("u")).select(by, F.posexplode("u").alias("i", "x"))
    means = units.groupBy(by, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    packed = means.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    return packed.select(by, "n", unit(F.col("m")).alias("prototype"))


def margins(rows: DataFrame, vector: str, fg: DataFrame, bg: DataFrame) -> DataFrame:
    """rows with margin: cosine with the fg prototype less that with the bg one. Each prototype frame has one row."""
    u = unit(doubles(F.col(vector)))
    both = fg.select(F.col("prototype").alias("__f")).crossJoin(bg.select(F.col("prototype").alias("__b")))
    return rows.crossJoin(both).withColumn("margin", dot(u, F.col("__f")) - dot(u, F.col("__b"))).drop("__f", "__b")


def similarity_to_seed(rows: DataFrame, key: str, vector: str, weight: str, batch: list[str], threshold: float) -> DataFrame:
    """Cosine of every row with the batch's seed (least weight, then least key), the background flag (over the threshold), and the
    dissimilarity of the others as a share of the batch's largest."""
    seeds = rows.groupBy(*batch).agg(F.min(F.struct(F.col(weight), F.col(key), F.col(vector).alias("v")))["v"].alias("__s"))
    out = rows.join(seeds, batch).withColumn("cosine", dot(unit(doubles(F.col(vector))), unit(doubles(F.col("__s"))))).drop("__s")
    most = out.groupBy(*batch).agg(F.max(1.0 - F.col("cosine")).alias("__m"))
    out = out.join(most, batch).withColumn("background", F.col("cosine") > threshold)
    return out.withColumn("dissimilarity", F.when(F.col("background"), 0.0).otherwise((1.0 - F.col("cosine")) / (F.col("__m") + 1e-10))).drop("__m")


def head_weights(rows: DataFrame, batch: str, head: str, active: str) -> DataFrame:
    """ln(sum of Q over heads / Q) of each head's share Q of active places."""
    q = rows.select(batch, head, (F.col(active).cast("double") + 1e-10).alias("q"))
    total = q.groupBy(batch).agg(F.sum("q").alias("t"))
    return q.join(total, batch).select(batch, head, F.ln(F.col("t") / F.col("q")).alias("beta"))

"""Label sources joined by key: ordered fallbacks, integrity of key sets, pairing with a baseline.

All joins are declared; Spark picks the strategy from sizes, and nothing here is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, source): the primary's value where there is a row of it, else the fallback's. A primary row whose value is
    null still counts as primary."""
    p = primary.select(F.col(key), F.col(value).alias("__p"), F.lit(True).alias("__has"))
    f = fallback.select(F.col(key), F.col(value).alias("__f"))
    joined = p.join(f, key, "full_outer")
    return joined.select(key, F.when(F.col("__has"), F.col("__p")).otherwise(F.col("__f")).alias(value), F.when(F.col("__has"), "primary").otherwise("fallback").alias("source"))


def choose_source(samples: DataFrame, key: str, tiers: list[tuple[str, DataFrame]], last: str) -> DataFrame:
    """samples with a column source: the first tier that has the key, else last. Each tier is a frame of distinct keys."""
    out, chosen = samples, None
    for name, keys in tiers:
        flag = f"__{name}"
        out = out.join(keys.select(key).distinct().withColumn(flag, F.lit(True)), key, "left")
        chosen = F.when(F.col(flag), name) if chosen is None else chosen.when(F.col(flag), name)
    return out.withColumn("source", chosen.otherwise(last) if chosen is not None else F.lit(last)).drop(*(f"__{n}" for n, _ in tiers))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of the left only are "missing" (on the right), keys of the right only are "extra"."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def require_same_keys(left: DataFrame, right: DataFrame, key: str, preview: int = 5) -> None:
    """Raises ValueError, naming the first few, unless both sides have the same keys."""
    bad = key_differences(left, right, key).orderBy("side", key).limit(preview).collect()
    if bad:
        raise ValueError("key sets differ: " + ", ".join(f"{r['side']} {r[key]}" for r in bad))


def require_unique(df: DataFrame, key: str | list[str]) -> None:
    keys = [key] if isinstance(key, str) else key
    bad = df.groupBy(*keys).count().where("count > 1").orderBy(*keys).limit(5).collect()
    if bad:
        raise ValueError("repeated keys: " + ", ".join(str(tuple(r)[:-1]) for r in bad))


def require_dense_index(df: DataFrame, index: str) -> int:
    """Number of rows, if the index runs from 0 without gaps or repeats; else ValueError."""
    r = df.agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi")).first()
    if r["n"] and (r["d"] != r["n"] or r["lo"] != 0 or r["hi"] != r["n"] - 1):
        raise ValueError(f"index {index} is not dense: {r['n']} rows, {r['d']} distinct, {r['lo']} to {r['hi']}")
    return r["n"]


def include_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def exclude_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def unknown_members(names: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return names.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def paired_with_baseline(facts: DataFrame, keys: list[str], member: str, baseline: str, metrics: list[str]) -> DataFrame:
    """Every row of another member with its difference from the baseline's row of the same keys, by metric as d_<metric>."""
    base = facts.where(F.col(member) == baseline).select(*keys, *(F.col(m).alias(f"__{m}") for m in metrics))
    return facts.where(F.col(member) != baseline).join(base, keys).select(*keys, member, *((F.col(m) - F.col(f"__{m}")).alias(f"d_{m}") for m in metrics))


def lookup(df: DataFrame, table: DataFrame, key: str, column: str, default: object) -> DataFrame:
    """df with the table's column by key, or the default where there is no row or a null. The table's keys are distinct."""
    return df.join(table.select(key, column), key, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def drifted(left: DataFrame, right: DataFrame, index: str, columns: list[str]) -> DataFrame:
    """Rows of equal index whose columns differ (nulls equal), and rows that one side alone has."""
    r = right.select(F.col(index), *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__right"))
    l = left.select(index, *columns, F.lit(True).alias("__left"))
    same: Column = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return l.join(r, index, "full_outer").where(F.col("__left").isNull() | F.col("__right").isNull() | ~same).select(index)


def zipped(index: str, *parts: DataFrame) -> DataFrame:
    """Parts with a common position, joined on it."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, index)
    return out


def expand_predictions(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every truth row with every prediction set's row of the same key."""
    return truth.join(predictions, key)


def exactly_one(selected: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The table's rows that the selection names; ValueError unless each names exactly one."""
    counts = selected.select(*keys).join(table.groupBy(*keys).agg(F.count("*").alias("__n")), keys, "left")
    bad = counts.where("__n IS NULL OR __n <> 1").limit(1).collect()
    if bad:
        raise ValueError(f"not exactly one row for {tuple(bad[0])[:-1]}")
    return selected.select(*keys).join(table, keys)


def stability(candidates: DataFrame, image: str, prompt: str, index: str, similarity: Column, default: float = 0.5) -> DataFrame:
    """Mean, over the other prompts of the image, of the best similarity with one of their candidates; the default if there is
    no other. The similarity is an expression over the aliases a and b of the candidates."""
    a, b = candidates.alias("a"), candidates.alias("b")
    met = a.join(b, (F.col(f"a.{image}") == F.col(f"b.{image}")) & (F.col(f"a.{prompt}") != F.col(f"b.{prompt}")))
    best = met.groupBy(F.col(f"a.{image}").alias(image), F.col(f"a.{prompt}").alias(prompt), F.col(f"a.{index}").alias(index), F.col(f"b.{prompt}").alias("__other")).agg(F.max(similarity).alias("__best"))
    mean = best.groupBy(image, prompt, index).agg(F.avg("__best").alias("stability"))
    return candidates.select(image, prompt, index).join(mean, [image, prompt, index], "left").withColumn("stability", F.coalesce("stability", F.lit(default)))

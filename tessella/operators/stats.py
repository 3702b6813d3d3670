"""Grouped statistics over fact tables: overall rows, distributions, histograms, bootstrap, macro averages, crosstabs, sweeps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_with_all(rows: DataFrame, by: list[str], within: str, aggregates: list[Column], label: str = "ALL") -> DataFrame:
    """Aggregates by (by, within), and by alone with the label in place of within; one pass by grouping sets. Values of within that
    are null stay a group of their own."""
    sets = [[*map(F.col, by), F.col(within)], [*map(F.col, by)]]
    out = rows.groupingSets(sets, *map(F.col, by), F.col(within)).agg(F.grouping(within).alias("__all"), *aggregates)
    return out.withColumn(within, F.when(F.col("__all") == 1, F.lit(label)).otherwise(F.col(within).cast("string"))).drop("__all")


def mean_columns(metrics: list[str], bands: list[int] = ()) -> list[Column]:
    """Counts and means of the metrics, and of band_{w}_{iou,bf} for the given widths."""
    return [F.count("*").alias("n"), *(F.avg(m).alias(m) for m in [*metrics, *(f"band_{w}_{k}" for w in bands for k in ("iou", "bf"))])]


def failure_rate(difference: Column, below: float = -0.2) -> Column:
    return F.avg(F.when(difference.isNotNull(), (difference < below).cast("int")))


def zero_filled_counts(rows: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """Rows by key over the whole domain, 0 included; other keys are left out."""
    keys = rows.sparkSession.createDataFrame([(d,) for d in domain], f"`{key}` string")
    return keys.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def macro_mean_std(rows: DataFrame, group: str, seed: str, dataset: str, metrics: list[str]) -> DataFrame:
    """Per (group, dataset): seeds, mean and sample deviation over seeds; and per group a row MACRO of the seeds' means over
    datasets. The deviation of one seed is null."""

    def over_seeds(df: DataFrame) -> DataFrame:
        return df.groupBy(group, dataset).agg(F.count("*").alias("n_seeds"), *(a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))))

    macro = rows.groupBy(group, seed).agg(*(F.avg(m).alias(m) for m in metrics)).withColumn(dataset, F.lit("MACRO"))
    return over_seeds(rows).unionByName(over_seeds(macro))


def formatted(c: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", c)


def grid(spark, **domains: list) -> DataFrame:
    """Cross product of the domains."""
    out = None
    for name, values in domains.items():
        one = spark.createDataFrame([(v,) for v in values], f"`{name}` {'long' if isinstance(values[0], int) else 'string'}")
        out = one if out is None else out.crossJoin(one)
    return out


def missing_cells(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).join(rows.select(*keys).distinct(), keys, "left_anti")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


#: Rank error of the sketches that bracket quantiles, as a share of a group's rows; brackets are wider than twice that.
SKETCH = 10_000


def exact_quantiles(rows: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """(by, n, least, most, mean, q): exact, linearly interpolated quantiles of each group at the given shares, as an array; nulls are left
    out, groups of nulls alone have none. No group is sorted or kept in memory: a sketch with a guaranteed rank error brackets each
    place, the rows below are counted, and only the distinct values inside the brackets are ordered."""
    names = [f"__g{i}" for i in range(len(by))]
    v = rows.select(*(F.col(b).alias(g) for b, g in zip(by, names)), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    wide = 3.0 / SKETCH
    shares = F.array(*(F.lit(min(max(q + d, 0.0), 1.0)) for q in at for d in (-wide, wide)))
    bounds = v.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"), F.percentile_approx("v", shares, SKETCH).alias("s"))
    few = F.col("n") <= SKETCH  # a bracket would be narrower than the two places between which to interpolate: all is inside
    lows = [F.when(few, F.col("least")).otherwise(F.col("s")[2 * j]) if q > wide else F.col("least") for j, q in enumerate(at)]
    highs = [F.when(few, F.col("most")).otherwise(F.col("s")[2 * j + 1]) if q < 1 - wide else F.col("most") for j, q in enumerate(at)]
    ends = [F.struct(F.lit(float(q)).alias("q"), lo.alias("lo"), hi.alias("hi")) for q, lo, hi in zip(at, lows, highs)]
    bounds = bounds.withColumn("b", F.array(*ends)).drop("s")

    def with_groups(left: DataFrame, right: DataFrame) -> DataFrame:
        renamed = right.select(*(F.col(g).alias(f"{g}r") for g in names), *(c for c in right.columns if c not in names))
        same = F.lit(True)
        for g in names:
            same = same & F.col(g).eqNullSafe(F.col(f"{g}r"))
        return (left.join(renamed, same) if names else left.crossJoin(renamed)).drop(*(f"{g}r" for g in names))

    met = with_groups(v, bounds.select(*names, "b"))
    below = met.groupBy(*names).agg(F.array(*(F.count_if(F.col("v") < F.col("b")[j]["lo"]) for j in range(len(at)))).alias("below"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(at) - 1)), lambda j: (F.col("v") >= F.get("b", j)["lo"]) & (F.col("v") <= F.get("b", j)["hi"]))
    counts = met.select(*names, "v", F.explode(inside).alias("j")).groupBy(*names, "j", "v").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*names, "j").orderBy("v")))
    upto = with_groups(with_groups(upto, below), bounds.select(*names, "n", "b"))
    place = F.get("b", F.col("j"))["q"] * (F.col("n") - 1)
    last = F.get("below", F.col("j")) + F.col("upto") - 1
    here = lambda k: F.max(F.when((k <= last) & (k > last - F.col("c")), F.col("v")))
    found = upto.groupBy(*names, "j").agg(F.first(place).alias("place"), here(F.floor(place)).alias("lo"), here(F.ceil(place)).alias("hi"))
    part = F.col("place") - F.floor("place")
    q = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - part) * F.col("lo") + part * F.col("hi"))
    listed = found.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", q.alias("q")))), lambda x: x["q"]).alias("q"))
    return with_groups(bounds.drop("b"), listed).select(*(F.col(g).alias(b) for g, b in zip(names, by)), "n", "least", "most", "mean", "q")


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, p05, median, p95, max and mean by exact, linearly interpolated quantiles; nulls are left out."""
    out = exact_quantiles(rows, by, value, [0.05, 0.5, 0.95])
    return out.select(*by, "n", F.col("least").alias("min"), F.col("q")[0].alias("p05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"), F.col("most").alias("max"), "mean")


def quantiles(rows: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """One row for each quantile."""
    return exact_quantiles(rows, by, value, at).select(*by, F.posexplode("q").alias("k", "value")).withColumn("q", F.element_at(F.array(*map(F.lit, at)), F.col("k") + 1)).drop("k")


def fixed_histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, lo, hi, n, percent) over half-open bins; empty bins are there; values outside all bins count for the percent's base only."""
    spark = rows.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lo double, hi double")
    v = F.col(value)
    place = None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        test = (v >= a) & (v < b)
        place = F.when(test, i) if place is None else place.when(test, i)
    counts = rows.where(v.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return bins.join(counts, "bin", "left").crossJoin(total).select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("percent"))


def below_thresholds(rows: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n): rows with a value under each threshold, in one pass."""
    counts = rows.agg(*(F.count_if(F.col(value) < t).alias(f"t{i}") for i, t in enumerate(thresholds)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)))).alias("x")).select("x.*")


def correlation(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson's over rows where both are there."""
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts and row percents by column value, and a row Total."""
    aggs = [a for v in values for a in (F.count_if(F.col(column) == v).alias(f"n_{v}"), (100.0 * F.count_if(F.col(column) == v) / F.count("*")).alias(f"pct_{v}"))]
    out = rows.groupingSets([[F.col(row)], []], F.col(row)).agg(F.grouping(row).alias("__g"), F.count("*").alias("n"), *aggs)
    return out.withColumn(row, F.when(F.col("__g") == 1, "Total").otherwise(F.col(row).cast("string"))).drop("__g")


def leaderboard(rows: DataFrame, strategies: list[str], baseline: str) -> DataFrame:
    """Mean, mean difference from the baseline and share of wins (strictly over it, in percent) by strategy."""
    long = rows.where(F.col(baseline).isNotNull()).select(F.col(baseline).alias("__b"), F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), F.col(s).alias("v")) for s in strategies))).alias("x")).select("__b", "x.*")
    return long.groupBy("strategy").agg(F.avg("v").alias("mean"), F.avg(F.col("v") - F.col("__b")).alias("mean_delta"), (100.0 * F.avg((F.col("v") > F.col("__b")).cast("int"))).alias("win_rate"))


def bootstrap_interval(values: np.ndarray, resamples: int = 1000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float, float]:
    """Mean and percentile bounds of the means of resamples by the legacy generator, seeded anew for every call. Values come in a
    fixed order, as that decides the resamples."""
    v, rng = np.asarray(values, float), np.random.RandomState(seed)
    if not len(v):
        return float("nan"), float("nan"), float("nan")
    means = np.array([v[rng.choice(len(v), size=len(v), replace=True)].mean() for _ in range(resamples)])
    return float(v.mean()), float(np.percentile(means, 100 * alpha / 2)), float(np.percentile(means, 100 * (1 - alpha / 2)))


def bootstrap(rows: DataFrame, by: list[str], key: str, value: str, resamples: int | None = 1000) -> DataFrame:
    """(by, n, mean, ci_lower, ci_upper) of each group, its rows in the order of the key. None: as many resamples as rows, at most 1000.
    The resamples are those of a seeded generator over the ordered rows, so a group goes to one task whole: meant for groups that one task
    can hold, as metric tables of a label set are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.dropna(subset=["v"]).sort_values("k", kind="stable")["v"].to_numpy()
        m, lo, hi = bootstrap_interval(v, resamples if resamples is not None else min(1000, max(len(v), 1)))
        return pd.DataFrame([[*(pdf[b].iloc[0] for b in by), len(v), m, lo, hi]], columns=[*by, "n", "mean", "ci_lower", "ci_upper"])

    small = rows.select(*by, F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.select(*by).schema)
    return small.groupBy(*by).applyInPandas(run, f"{kinds}, n long, mean double, ci_lower double, ci_upper double")


def smoothed(rows: DataFrame, by: list[str], order: list[Column], value: str, window: int = 20) -> DataFrame:
    """Median, mean and maximum of the last rows of each series, and its running mean."""
    w = Window.partitionBy(*by).orderBy(*order)
    last, so_far = w.rowsBetween(-(window - 1), 0), w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"median": F.percentile(value, F.lit(0.5)).over(last), "avg": F.avg(value).over(last), "max": F.max(value).over(last), "global_avg": F.avg(value).over(so_far)})


def running_best(rows: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Least value so far, and whether the row set it."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"best": F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "improved": F.coalesce(F.col(value) < before, F.lit(True))})


def ema(rows: DataFrame, by: list[str], order: list[Column], value: str, alpha: float = 0.999) -> DataFrame:
    """Last value per series of e = d e + (1 - d) x with d = min(1 - 1 / (step + 1), alpha), steps from 0 (so the first value starts it)."""
    steps = F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__v")))).alias("s")
    fold = F.aggregate(
        F.transform("s", lambda x, i: F.struct(i.cast("double").alias("i"), x["__v"].alias("v"))),
        F.lit(0.0),
        lambda e, x: e * F.least(1.0 - 1.0 / (x["i"] + 1.0), F.lit(alpha)) + (1.0 - F.least(1.0 - 1.0 / (x["i"] + 1.0), F.lit(alpha))) * x["v"],
    )
    return rows.groupBy(*by).agg(steps).select(*by, F.size("s").cast("long").alias("n"), fold.alias("ema"))


def top_k_accuracy(rows: DataFrame, item: str, score: str, match: Column, k: int, tie: str) -> DataFrame:
    """Percent of items with a match among their k best-scored rows."""
    r = rows.withColumn("__r", F.row_number().over(Window.partitionBy(item).orderBy(F.col(score).desc(), F.col(tie).asc())))
    hit = r.groupBy(item).agg(F.max(F.when((F.col("__r") <= k) & match, 1).otherwise(0)).alias("hit"))
    return hit.agg((100.0 * F.avg("hit")).alias("accuracy"), F.count("*").alias("n"))


def splat_and_slice(rows: DataFrame, cells: list[str], value: str) -> DataFrame:
    """Every row with the sum and count of its grid cell."""
    sums = rows.groupBy(*cells).agg(F.sum(value).alias("cell_sum"), F.count(value).alias("cell_n"))
    return rows.join(sums, cells)

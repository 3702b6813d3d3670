"""Deterministic selection: frozen top fractions, positions, strata, quotas. Every order is total, so results don't depend on
partitioning; python's round (half to even) is rint and bround here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


#: Rows up to which an order statistic is found by one sort.
SORTED_AT_ONCE = 1_000_000


def kth_smallest(rows: DataFrame, value: str, k: int) -> object:
    """The value at place k (from 0) of the ascending order, exactly, nulls left out. Many rows are never sorted: approximate
    quantiles bracket the place, counts make the bracket exact, and the rows inside go on until they are few or all equal."""
    inside, base = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v")), 0
    n = inside.count()
    if not 0 <= k < n:
        raise IndexError(f"no place {k} among {n}")
    spread = 5e-4
    while n > SORTED_AT_ONCE:
        at = (k - base + 0.5) / n
        lo, hi = inside.agg(F.percentile_approx("v", F.array(F.lit(max(at - spread, 0.0)), F.lit(min(at + spread, 1.0))), 20_000)).first()[0]
        below, upto = inside.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v") <= hi)).first()
        if not below <= k - base < upto:
            spread *= 4  # the sketch missed; a wider bracket ends at the whole
            continue
        if lo == hi:
            return lo
        if upto - below == n:
            break
        inside, base, n = inside.where(F.col("v").between(lo, hi)), base + below, upto - below
    return inside.orderBy("v").offset(k - base).limit(1).first()[0]


def top_fraction(rows: DataFrame, score: str, name: str, fraction: float) -> DataFrame:
    """The rows of the highest scores (ties by name): of all rows, unscored ones included, the fraction rounded half to even, but
    at least one and no more than are scored. ValueError if none is scored. Rows over the last score that counts are taken by a
    filter; only the rows of that score are sorted."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    n, scored = rows.agg(F.count("*"), F.count(score)).first()
    if not scored:
        raise ValueError("no row is scored")
    k = min(max(round(n * fraction), 1), scored)
    last = kth_smallest(rows, score, scored - k)
    over = rows.where(F.col(score) > last)
    ties = rows.where(F.col(score) == last)
    return over.unionByName(ties.orderBy(F.col(name).asc()).limit(k - over.count()))


def top_fraction_by(rows: DataFrame, group: str, score: str, name: str, fraction: float) -> DataFrame:
    """top_fraction within every group, in one pass; groups without a score have no row."""
    w = Window.partitionBy(group)
    n, scored = F.count("*").over(w), F.count(score).over(w)
    k = F.least(F.greatest(F.bround(n * F.lit(fraction), 0), F.lit(1.0)), scored.cast("double"))
    ranked = rows.withColumn("__k", k).where(F.col(score).isNotNull())
    return ranked.withColumn("__r", F.row_number().over(w.orderBy(F.col(score).desc(), F.col(name).asc()))).where("__r <= __k").drop("__k", "__r")


def selection_metadata(all_rows: DataFrame, selected: DataFrame, score: str) -> DataFrame:
    a = all_rows.agg(F.count("*").alias("total_count"), F.count(score).alias("scored_count"))
    return a.crossJoin(selected.agg(F.count("*").alias("selected_count"), F.min(score).alias("selected_score_min"), F.max(score).alias("selected_score_max")))


def ranked(rows: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "position", start: int = 0) -> DataFrame:
    """Position in the given total order, within groups or overall. Overall, rows are sorted by ranges and each range is numbered from the
    count of those before it, so no task sees the whole table."""
    if not by:
        return rows.orderBy(*order).select("*", (InternalFunction.distributed_sequence_id() + start).cast("long").alias(name))
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1 + start).cast("long"))


def at_quantile_positions(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """k rows of each group at evenly spaced positions of its order, first and last included, halves to even; small groups whole. Rows
    are ranked over all groups by ranges, so no task sees a group whole, and those at the wanted ranks are kept."""
    r = ranked(rows, [*map(F.col, by), *order], name="__p")
    groups = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    few = groups.count() * k <= SORTED_AT_ONCE
    if few:  # the ranks before each group in one task; else from the rows
        groups = groups.select("__n", (F.sum("__n").over(Window.orderBy(*by)) - F.col("__n")).alias("__s"))
    else:
        groups = r.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__p").alias("__s"))
    n = F.col("__n")
    step = (n - 1) / float(max(k - 1, 1))
    positions = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(j == k - 1, n - 1 if k > 1 else F.lit(0)).otherwise(F.rint(j * step)).cast("long"))
    inside = F.when(n <= k, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(positions)
    wanted = groups.select(F.explode(F.transform(inside, lambda i: i + F.col("__s"))).alias("__p"))
    return r.join(F.broadcast(wanted) if few else wanted, "__p", "left_semi").drop("__p")


def tertiles(rows: DataFrame, value: str, name: str = "tertile") -> DataFrame:
    """0, 1 or 2 by the values at places n // 3 and 2n // 3 of the order, lower cut inclusive; equal values are never parted. Null
    values have no tertile."""
    n = rows.where(F.col(value).isNotNull()).count()
    if not n:
        return rows.withColumn(name, F.lit(None).cast("int"))
    low, high = kth_smallest(rows, value, n // 3), kth_smallest(rows, value, 2 * n // 3)
    v = F.col(value)
    return rows.withColumn(name, F.when(v.isNull(), None).when(v <= low, 0).when(v <= high, 1).otherwise(2))


def quota_cohort(rows: DataFrame, dataset: str, route: str, routes: list[str], order: list[Column], per_dataset: int) -> DataFrame:
    """per_dataset rows of each dataset, spread as evenly over the routes as they allow: rows take turns by their place within
    the route, then by the routes' order. A dataset with fewer rows gives all."""
    turn = F.row_number().over(Window.partitionBy(dataset, route).orderBy(*order))
    place = F.array_position(F.array(*map(F.lit, routes)), F.col(route))
    r = rows.where(F.col(route).isin(routes)).withColumn("__turn", turn).withColumn("__place", place)
    return r.withColumn("__slot", F.row_number().over(Window.partitionBy(dataset).orderBy("__turn", "__place"))).where(F.col("__slot") <= per_dataset).drop("__turn", "__place", "__slot")


def balanced_cohort(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """k rows of every cell at quantile positions; ValueError if a cell has fewer."""
    short = rows.groupBy(*by).count().where(F.col("count") < k).limit(1).collect()
    if short:
        raise ValueError(f"too few rows for {tuple(short[0])[:-1]}")
    return at_quantile_positions(rows, by, order, k)


def stratified_cohort(rows: DataFrame, route: str, routes: list[str], reliability: str, index: str, per_route: int, forced: dict[str, Column]) -> DataFrame:
    """per_route rows of each route at quantile positions of reliability; then for each forced property that no chosen row has, the
    first row with it (by index) takes the place of the last chosen row that isn't forced itself. The chosen rows are a handful,
    so that step runs on the driver."""
    cells = at_quantile_positions(rows.where(F.col(route).isin(routes)), [route], [F.col(reliability), F.col(index)], per_route)
    place = F.array_position(F.array(*map(F.lit, routes)), F.col(route))
    chosen = [r[0] for r in cells.select(index, place.alias("p"), reliability).orderBy("p", reliability, index).limit(per_route * len(routes)).collect()]
    pinned: set[int] = set()
    for test in forced.values():
        have = rows.where(F.col(index).isin(chosen) & test).select(index).collect()
        if have:
            pinned.add(have[0][0])
            continue
        first = rows.where(test).orderBy(index).select(index).limit(1).collect()
        if first:
            for i in range(len(chosen) - 1, -1, -1):
                if chosen[i] not in pinned:
                    chosen[i] = first[0][0]
                    break
            pinned.add(first[0][0])
    return rows.where(F.col(index).isin(chosen))


def best_per(rows: DataFrame, by: list[str], order: list[Column], minimum: Column | None = None) -> DataFrame:
    """First row of each group in the order; where that one misses the minimum the group has no row."""
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")
    return first if minimum is None else first.where(minimum)


def first_few(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def ends_and_middle(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n lowest ("worst"), n highest ("best") and n middle rows of a total order, with their kind; a row may be of several."""
    r = ranked(rows, order, name="__i").withColumn("__n", F.lit(rows.count()))
    middle = F.greatest(F.floor(F.col("__n") / 2) - n // 2, F.lit(0))
    kinds = F.array_compact(F.array(F.when(F.col("__i") < n, F.lit("worst")), F.when(F.col("__i") >= F.col("__n") - n, F.lit("best")), F.when((F.col("__i") >= middle) & (F.col("__i") < middle + n), F.lit("middle"))))
    return r.withColumn("kind", F.explode(kinds)).drop("__i", "__n")


def with_counter(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """name_{n}: the nth row of that name, from 0."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return rows.withColumn("counted_name", F.concat_ws("_", F.col(name), n.cast("string")))


def latest(rows: DataFrame, time: str, path: str) -> DataFrame:
    return rows.orderBy(F.col(time).desc(), F.col(path).asc()).limit(1)

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import raster, relate, select, stats


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_top_fraction_with_ties_and_unscored(spark):
    audit = rows(spark, [("b", 0.8), ("a", 0.8), ("c", 0.9), ("d", 0.1)], "n string, s double")
    got = select.top_fraction(audit, "s", "n", 0.5)
    assert {r.n for r in got.collect()} == {"a", "c"}
    meta = select.selection_metadata(audit, got, "s").first()
    assert (meta.selected_count, meta.selected_score_min) == (2, 0.8)
    more = audit.unionByName(rows(spark, [(f"x{i}", None) for i in range(6)], "n string, s double"))
    assert select.top_fraction(more, "s", "n", 0.25).count() == 2  # 2.5 to even
    assert select.top_fraction_by(more.withColumn("g", F.lit(1)), "g", "s", "n", 0.25).count() == 2
    with pytest.raises(ValueError):
        select.top_fraction(more.where("s IS NULL"), "s", "n", 0.5)
    with pytest.raises(ValueError):
        select.top_fraction(more, "s", "n", 0.0)


def test_cohorts(spark):
    data = [(i, d, r, v) for i, (d, r, v) in enumerate((d, r, v) for d in "AB" for r in ("low", "medium", "high") for v in (0.1, 0.3, 0.6, 0.9))]
    df = rows(spark, data, "i long, d string, r string, v double")
    cells = select.balanced_cohort(df, ["d", "r"], [F.col("v"), F.col("i")], 2)
    assert cells.count() == 12 and {r.v for r in cells.collect()} == {0.1, 0.9}
    with pytest.raises(ValueError):
        select.balanced_cohort(df, ["d", "r"], [F.col("v")], 5)
    many = rows(spark, [(i, d, r) for d in "AB" for i, r in enumerate(["low"] + ["medium"] * 40 + ["high"] * 40)], "i long, d string, r string")
    quota = select.quota_cohort(many, "d", "r", ["low", "medium", "high"], [F.col("i")], 60)
    by = {(r.d, r.r): r["count"] for r in quota.groupBy("d", "r").count().collect()}
    assert sum(by.values()) == 120 and by["A", "low"] == 1 and abs(by["A", "medium"] - by["A", "high"]) <= 1


def test_stratified_cohort_forces_coverage(spark):
    df = rows(spark, [(i, ("low", "medium", "high")[i % 3], i / 30, i == 7) for i in range(30)], "i long, r string, v double, e boolean")
    got = select.stratified_cohort(df, "r", ["low", "medium", "high"], "v", "i", 4, {"empty": F.col("e")})
    assert got.count() == 12 and got.where("e").count() == 1


def test_tertiles_never_part_equal_values(spark):
    df = rows(spark, [(i, v) for i, v in enumerate([1.0] * 5 + [2.0] * 2 + [3.0] * 2 + [None])], "i long, v double")
    got = {(r.v, r.tertile) for r in select.tertiles(df, "v").collect()}
    assert got == {(1.0, 0), (2.0, 1), (3.0, 2), (None, None)}


def test_sources_and_keys(spark):
    cohort = rows(spark, [("selected",), ("naive",), ("fallback",)], "k string")
    frozen, naive = rows(spark, [("selected",)], "k string"), rows(spark, [("selected",), ("naive",)], "k string")
    got = relate.choose_source(cohort, "k", [("fine", frozen), ("naive", naive)], "soft")
    assert {r.k: r.source for r in got.collect()} == {"selected": "fine", "naive": "naive", "fallback": "soft"}
    both = relate.with_fallback(rows(spark, [("a", None)], "k string, v long"), rows(spark, [("a", 1), ("b", 2)], "k string, v long"), "k", "v")
    assert {(r.k, r.v, r.source) for r in both.collect()} == {("a", None, "primary"), ("b", 2, "fallback")}
    with pytest.raises(ValueError, match="missing"):
        relate.require_same_keys(cohort, frozen, "k")
    with pytest.raises(ValueError):
        relate.require_unique(cohort.union(cohort), "k")
    assert relate.require_dense_index(spark.range(4), "id") == 4
    with pytest.raises(ValueError):
        relate.require_dense_index(spark.range(1, 4), "id")
    with pytest.raises(ValueError):
        relate.exactly_one(cohort, naive, ["k"])


def test_macro_golden(spark):
    data = [(g, s, d, 0.5 + 0.01 * i) for g in "abcd" for i, s in enumerate((42, 3407, 2025)) for d in "wxyz"]
    out = stats.macro_mean_std(rows(spark, data, "g string, s long, d string, m double"), "g", "s", "d", ["m"])
    assert out.count() == 20
    r = out.where("g = 'a' AND d = 'MACRO'").select(stats.formatted(F.col("m_mean")).alias("m"), stats.formatted(F.col("m_std")).alias("s"), "n_seeds").first()
    assert tuple(r) == ("0.510000", "0.010000", 3)


def test_bootstrap_equals_a_rerun(spark):
    v = np.linspace(0, 1, 50) ** 2
    df = rows(spark, [("g", i, float(x)) for i, x in enumerate(v)], "g string, k long, v double").repartition(5)
    got = stats.bootstrap(df, ["g"], "k", "v").first()
    rng = np.random.RandomState(42)
    means = [v[rng.choice(50, 50, True)].mean() for _ in range(1000)]
    assert (got.ci_lower, got.ci_upper) == (pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))


def test_half_even_radius_and_scores(spark):
    df = rows(spark, [("high", 7800.0), ("medium", 7800.0), ("low", 7800.0)], "r string, a double")
    assert [r[0] for r in df.select(S.route_radius(F.col("r"), F.col("a"))).collect()] == [2, 5, 0]
    one = rows(spark, [(1.2, 0, 1)], "s double, m int, c int").select(S.fused_pixel(F.col("s"), F.col("m"), F.col("c"))).first()
    assert one[0] is False
    names = rows(spark, [("a10.b",), ("a9.b",), (".x",)], "n string")
    assert [r.n for r in names.orderBy(S.natural_key(F.col("n"))).collect()][-2:] == ["a9.b", "a10.b"]
    assert {r[0] for r in names.select(S.file_stem(F.col("n"))).collect()} == {"a10", "a9", ".x"}


def test_empty_tables(spark):
    none = rows(spark, [], "k string, g string, v double")
    assert relate.key_differences(none, none, "k").count() == 0
    assert stats.distribution(none, ["g"], "v").count() == 0
    assert select.at_quantile_positions(none, ["g"], [F.col("v")], 3).count() == 0
    assert select.tertiles(none, "v").count() == 0
    assert stats.bootstrap(none, ["g"], "k", "v").count() == 0


@pytest.mark.parametrize("ties", [1, 400])
def test_order_statistics_without_a_sort(spark, monkeypatch, ties):
    v = np.random.default_rng(ties).integers(0, 20000 // ties, 20000).astype(float)
    df = rows(spark, [(float(x),) for x in v], "v double").union(rows(spark, [(None,)] * 3, "v double"))
    monkeypatch.setattr(select, "SORTED_AT_ONCE", 50)
    for k in (0, 1, 6666, 13333, 19999):
        assert select.kth_smallest(df, "v", k) == np.sort(v)[k]
    with pytest.raises(IndexError):
        select.kth_smallest(df, "v", 20000)


def test_rasters_that_do_not_fit_have_null_results(spark):
    rows = spark.createDataFrame([(1, [1.0] * 4), (2, None), (3, [1.0] * 3), (4, [1.0, None, 1.0, 1.0]), (5, [0.0] * 4)], "k long, v array<double>")
    total = lambda v: {"total": v.sum((1, 2)), "flat": v.reshape(len(v), -1)}
    got = {r.k: (r.total, r.flat) for r in raster.map_rasters(rows, ["k"], ["v"], 2, 2, total, "total double, flat array<double>").collect()}
    assert got == {1: (4.0, [1.0] * 4), 2: (None, None), 3: (None, None), 4: (None, None), 5: (0.0, [0.0] * 4)}
    assert raster.map_rasters(rows.where("k = 2"), ["k"], ["v"], 2, 2, total, "total double, flat array<double>").first().total is None


def test_ranks_over_the_whole_table_need_no_single_task(spark):
    rows = spark.range(5000).selectExpr("id", "(id * 7919) % 5003 AS v").repartition(6)
    got = select.ranked(rows, [F.col("v").desc()], start=1)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    want = {v: i + 1 for i, v in enumerate(sorted((r.v for r in rows.collect()), reverse=True))}
    assert {r.v: r.position for r in got.collect()} == want
    assert select.ranked(rows.where("id < 0"), [F.col("v")]).count() == 0


def test_quantiles_are_exact_and_sort_no_group(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [(g, float(x)) for g, n in (("a", 3001), ("b", 1), ("c", 2), (None, 500)) for x in np.round(rng.normal(size=n), 2)] + [("a", None), ("d", None)] + [("e", 1.0)] * 2000 + [("e", 2.0)] * 3
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    at = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for sketch in (10_000, 40):
        monkeypatch.setattr(stats, "SKETCH", sketch)
        got = {r.g: r.q for r in stats.exact_quantiles(df, ["g"], "v", at).collect()}
        assert set(got) == {"a", "b", "c", "e", None}
        for g, q in got.items():
            assert np.allclose(q, np.percentile([v for k, v in data if k == g and v is not None], [100 * x for x in at]))
        (q,) = stats.exact_quantiles(df, [], "v", at).collect()
        assert np.allclose(q.q, np.percentile([v for _, v in data if v is not None], [100 * x for x in at]))
    assert stats.exact_quantiles(df.where("g = 'z'"), ["g"], "v", at).count() == 0


@pytest.mark.parametrize("at_once", [1_000_000, 0])
def test_quantile_positions_are_exact_and_no_task_sees_a_group(spark, monkeypatch, at_once):
    monkeypatch.setattr(select, "SORTED_AT_ONCE", at_once)
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = np.random.default_rng(5)
    data = [(i, g, v) for i, (g, v) in enumerate((g, None if v == 3 else float(v)) for g, n in (("a", 4000), ("b", 1), ("c", 4), (None, 61)) for v in rng.integers(0, 40, n))]
    df = own.createDataFrame(data, "i long, g string, v double").repartition(5)
    for k, sign in ((1, 1), (4, 1), (7, -1)):
        order = [F.col("v") if sign > 0 else F.col("v").desc_nulls_first(), F.col("i")]
        got = select.at_quantile_positions(df, ["g"], order, k).withColumn("task", F.spark_partition_id()).collect()
        want = set()
        for g in ("a", "b", "c", None):
            ids = [i for i, h, v in sorted(data, key=lambda x: (x[2] is not None, sign * (x[2] or 0), x[0])) if h == g]
            want |= set(ids) if len(ids) <= k else {ids[round(p)] for p in np.linspace(0, len(ids) - 1, k)}
        assert sorted(r.i for r in got) == sorted(want)
        assert k == 1 or len({r.task for r in got if r.g == "a"}) > 1

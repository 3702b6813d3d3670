"""Grouped statistics over orders, events, lineitem, labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import relate, stats
from tessella.registry import register

from .common import SCORE, q6, r6, score, table


@register("grouping_all", f"SELECT o_orderpriority AS prediction, CASE WHEN grouping(o_orderstatus) = 1 THEN 'ALL' ELSE o_orderstatus END AS dataset, count(*) AS n, {q6('avg(o_totalprice)')} AS price FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority))")
def grouping_all(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("prediction"), F.col("o_orderstatus").alias("dataset"), "o_totalprice")
    return stats.grouped_with_all(o, ["prediction"], "dataset", [F.count("*").alias("n"), r6(F.avg("o_totalprice")).alias("price")])


_METRICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("metric_means", f"SELECT l_returnflag AS prediction, CASE WHEN grouping(l_linestatus) = 1 THEN 'ALL' ELSE l_linestatus END AS dataset, count(*) AS n, {', '.join(f'{q6(f"avg({m})")} AS {m}' for m in _METRICS)} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))")
def metric_means(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("prediction"), F.col("l_linestatus").alias("dataset"), *_METRICS)
    out = stats.grouped_with_all(l, ["prediction"], "dataset", stats.mean_columns(list(_METRICS)))
    return out.select("prediction", "dataset", "n", *(r6(m).alias(m) for m in _METRICS))


_MACRO = "WITH r AS (SELECT o_orderpriority AS grp, year(o_orderdate) AS seed, o_orderstatus AS dataset, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2, 3), x AS (SELECT grp, seed, dataset, m FROM r UNION ALL SELECT grp, seed, 'MACRO', avg(m) FROM r GROUP BY 1, 2)"


def _seeds(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("seed"), F.col("o_orderstatus").alias("dataset")).agg(F.avg("o_totalprice").alias("m"))


@register("macro_mean_std", f"{_MACRO} SELECT grp, dataset, count(*) AS n_seeds, {q6('avg(m)')} AS m_mean, {q6('stddev_samp(m)')} AS m_std FROM x GROUP BY 1, 2")
def macro_mean_std(spark, sf):
    out = stats.macro_mean_std(_seeds(spark, sf), "grp", "seed", "dataset", ["m"])
    return out.select("grp", "dataset", "n_seeds", r6("m_mean").alias("m_mean"), r6("m_std").alias("m_std"))


@register("macro_formatted", f"{_MACRO} SELECT grp, printf('%.2f', avg(m)) AS text FROM x WHERE dataset = 'MACRO' GROUP BY 1")
def macro_formatted(spark, sf):
    out = stats.macro_mean_std(_seeds(spark, sf), "grp", "seed", "dataset", ["m"]).where("dataset = 'MACRO'")
    return out.select("grp", stats.formatted(F.col("m_mean"), 2).alias("text"))


@register("grid_template", "SELECT g AS grp, s::BIGINT AS seed, d AS dataset FROM (VALUES ('a'), ('b'), ('c'), ('d')) x(g), (VALUES (42), (3407), (2025)) y(s), (VALUES ('w'), ('x'), ('y'), ('z')) z(d)")
def grid_template(spark, sf):
    return stats.grid(spark, grp=["a", "b", "c", "d"], seed=[42, 3407, 2025], dataset=["w", "x", "y", "z"])


@register("grid_completeness", "SELECT l.lang, s.source FROM (SELECT DISTINCT lang FROM documents) l, (SELECT DISTINCT source FROM documents) s WHERE (l.lang, s.source) NOT IN (SELECT (lang, source) FROM documents WHERE n_chars > 8000)")
def grid_completeness(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", "n_chars")
    return stats.missing_cells(d.where("n_chars > 8000"), d.select("lang").distinct().crossJoin(d.select("source").distinct()), ["lang", "source"])


@register("repeated_keys", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return stats.repeated_keys(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])


@register("distribution_summary", "SELECT event_type, count(value) AS n, " + ", ".join(f"{q6(x)} AS {n}" for n, x in (("min", "min(value)"), ("p05", "quantile_cont(value, 0.05)"), ("median", "quantile_cont(value, 0.5)"), ("p95", "quantile_cont(value, 0.95)"), ("max", "max(value)"), ("mean", "avg(value)"))) + " FROM events GROUP BY event_type")
def distribution_summary(spark, sf):
    out = stats.distribution(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *(r6(c).alias(c) for c in ("min", "p05", "median", "p95", "max", "mean")))


_QS = [0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0]


@register("quantile_set", " UNION ALL ".join(f"SELECT event_type, {q}::DOUBLE AS q, {q6(f'quantile_cont(value, {q})')} AS value FROM events GROUP BY event_type" for q in _QS))
def quantile_set(spark, sf):
    return stats.quantiles(table(spark, sf, "events"), ["event_type"], "value", _QS).select("event_type", "q", r6("value").alias("value"))


@register("empty_full_counts", "SELECT label, count(*) FILTER (WHERE a = 0) AS n_empty, count(*) FILTER (WHERE a = 64) AS n_full, count(*) AS n FROM (SELECT label, len(list_filter(embedding, lambda v: v > 0.3)) AS a FROM embeddings) GROUP BY label")
def empty_full_counts(spark, sf):
    a = F.size(F.filter("embedding", lambda v: v > F.lit(0.3)))
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count_if(a == 0).alias("n_empty"), F.count_if(a == 64).alias("n_full"), F.count("*").alias("n"))


@register("value_counts_null", "SELECT l.quality::BIGINT AS quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def value_counts_null(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return table(spark, sf, "documents").select("doc_id").join(l, "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"))


_EDGES = [float(x) for x in range(0, 60, 4)]


@register("histogram_fixed", f"WITH b(bin, lo, hi) AS (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))}) SELECT bin, lo, hi, count(l_quantity) AS n, {q6('100.0 * count(l_quantity) / (SELECT count(l_quantity) FROM lineitem)')} AS percent FROM b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1, 2, 3")
def histogram_fixed(spark, sf):
    return stats.fixed_histogram(table(spark, sf, "lineitem"), "l_quantity", _EDGES).select("bin", "lo", "hi", "n", r6("percent").alias("percent"))


@register("threshold_exceed", "SELECT t::DOUBLE AS threshold, count(*) FILTER (WHERE l_quantity < t) AS n FROM lineitem, (VALUES (5), (10), (25), (50)) v(t) GROUP BY 1")
def threshold_exceed(spark, sf):
    return stats.below_thresholds(table(spark, sf, "lineitem"), "l_quantity", [5, 10, 25, 50])


@register("percentile_table", "SELECT l_returnflag, " + ", ".join(f"{q6(f'quantile_cont(l_extendedprice, {q / 100})')} AS p{q}" for q in (5, 10, 25, 50, 75, 90, 95)) + f", {q6('avg(l_extendedprice)')} AS mean, {q6('stddev_pop(l_extendedprice)')} AS std FROM lineitem GROUP BY 1")
def percentile_table(spark, sf):
    at = (5, 10, 25, 50, 75, 90, 95)
    out = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(*(F.lit(q / 100) for q in at))).alias("p"), F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("std"))
    return out.select("l_returnflag", *(r6(F.col("p")[i]).alias(f"p{q}") for i, q in enumerate(at)), r6("mean").alias("mean"), r6("std").alias("std"))


@register("pearson_corr", f"SELECT l_returnflag, count(*) AS n, {q6('corr(l_quantity, l_extendedprice)')} AS r FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1")
def pearson_corr(spark, sf):
    return stats.correlation(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", "n", r6("r").alias("r"))


@register("crosstab_total", "SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{v}') AS n_{v}, {q6(f"100.0 * count(*) FILTER (WHERE o_orderstatus = '{v}') / count(*)")} AS pct_{v}" for v in "OFP") + " FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
def crosstab_total(spark, sf):
    out = stats.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", list("OFP"))
    return out.select("o_orderpriority", "n", *(c for v in "OFP" for c in (F.col(f"n_{v}"), r6(f"pct_{v}").alias(f"pct_{v}"))))


@register("strategy_leaderboard", " UNION ALL ".join(f"SELECT '{s}' AS strategy, {q6(f'avg({s})')} AS mean, {q6(f'avg({s} - l_tax)')} AS mean_delta, {q6(f'100.0 * avg(CASE WHEN {s} > l_tax THEN 1.0 ELSE 0.0 END)')} AS win_rate FROM lineitem" for s in ("l_discount", "l_tax", "l_quantity")))
def strategy_leaderboard(spark, sf):
    out = stats.leaderboard(table(spark, sf, "lineitem"), ["l_discount", "l_tax", "l_quantity"], "l_tax")
    return out.select("strategy", *(r6(c).alias(c) for c in ("mean", "mean_delta", "win_rate")))


@register("best_strategy", "SELECT strategy FROM (SELECT 'l_discount' AS strategy, avg(l_discount) AS m FROM lineitem UNION ALL SELECT 'l_tax', avg(l_tax) FROM lineitem) ORDER BY m DESC, strategy LIMIT 1")
def best_strategy(spark, sf):
    return stats.leaderboard(table(spark, sf, "lineitem"), ["l_discount", "l_tax"], "l_tax").orderBy(F.col("mean").desc(), "strategy").limit(1).select("strategy")


@register("selected_summary", f"SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS dataset, count(l.doc_id) AS n, {q6('coalesce(avg(l.quality), 0.0)')} AS mean FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1 GROUP BY GROUPING SETS ((lang), ())")
def selected_summary(spark, sf):
    l = table(spark, sf, "labels").where("toxic = 1").select("doc_id", "quality", F.lit(1).alias("one"))
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("dataset"), F.lit(0).alias("z")).join(l, "doc_id", "left")
    return stats.grouped_with_all(d, ["z"], "dataset", [F.count("one").alias("n"), r6(F.coalesce(F.avg("quality"), F.lit(0.0))).alias("mean")]).drop("z")


@register("route_counts", "SELECT r.route, count(e.route) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('none')) r(route) LEFT JOIN (SELECT CASE WHEN value / 500 >= 0.67 THEN 'high' WHEN value / 500 >= 0.33 THEN 'medium' ELSE 'low' END AS route FROM events) e ON e.route = r.route GROUP BY 1")
def route_counts(spark, sf):
    return stats.zero_filled_counts(table(spark, sf, "events").select(S.route(F.col("value") / 500).alias("route")), "route", ["high", "medium", "low", "none"])


@register("smoothed_value", "SELECT event_id, round(median(value) OVER w, 9) AS median, round(avg(value) OVER w, 9) AS avg, round(max(value) OVER w, 9) AS max, round(avg(value) OVER g, 9) AS global_avg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING), g AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def smoothed_value(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = stats.smoothed(e, ["user_id"], [F.col("ts"), F.col("event_id")], "value")
    return out.select("event_id", *(F.round(c, 9).alias(c) for c in ("median", "avg", "max", "global_avg")))


@register("running_best", f"SELECT event_id, {q6('min(value) OVER w')} AS best, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_best(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return stats.running_best(e, ["user_id"], [F.col("ts"), F.col("event_id")], "value").select("event_id", r6("best").alias("best"), "improved")


_EMA = """WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
e AS (SELECT user_id, i, 0.0::DOUBLE * 0 + (1 - least(1 - 1.0::DOUBLE / (i + 1.0), 0.9)) * value AS e FROM s WHERE i = 0
UNION ALL SELECT s.user_id, s.i, e.e * least(1 - 1.0::DOUBLE / (s.i + 1.0), 0.9) + (1 - least(1 - 1.0::DOUBLE / (s.i + 1.0), 0.9)) * s.value FROM e JOIN s ON s.user_id = e.user_id AND s.i = e.i + 1)"""


@register("ema_fold", f"{_EMA} SELECT user_id, max(i) + 1 AS n, {q6('max_by(e, i)')} AS ema FROM e GROUP BY user_id")
def ema_fold(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return stats.ema(e, ["user_id"], [F.col("ts"), F.col("event_id")], "value", 0.9).select("user_id", "n", r6("ema").alias("ema"))


@register("top_k_accuracy", f"SELECT {q6('100.0 * avg(hit)')} AS accuracy, count(*) AS n FROM (SELECT conv_id, max(CASE WHEN r <= 2 AND role = 'assistant' THEN 1.0 ELSE 0.0 END) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) GROUP BY 1)")
def top_k_accuracy(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    return stats.top_k_accuracy(c, "conv_id", "size", F.col("role") == "assistant", 2, "turn").select(r6("accuracy").alias("accuracy"), "n")


@register("splat_and_slice", f"SELECT l_orderkey, l_linenumber, {q6('sum(l_tax) OVER (PARTITION BY l_returnflag, l_linestatus, floor(l_quantity / 10), floor(l_discount * 100), floor(l_extendedprice / 20000))')} AS cell_sum FROM lineitem")
def splat_and_slice(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_returnflag", "l_linestatus", F.floor(F.col("l_quantity") / 10).alias("a"), F.floor(F.col("l_discount") * 100).alias("b"), F.floor(F.col("l_extendedprice") / 20000).alias("c"))
    return stats.splat_and_slice(l, ["l_returnflag", "l_linestatus", "a", "b", "c"], "l_tax").select("l_orderkey", "l_linenumber", r6("cell_sum").alias("cell_sum"))


@register("bootstrap_mean", f"SELECT event_type, count(*) AS n, {q6('avg(value)')} AS mean FROM events GROUP BY 1")
def bootstrap_mean(spark, sf):
    return stats.bootstrap(table(spark, sf, "events"), ["event_type"], "event_id", "value", 10).select("event_type", "n", r6("mean").alias("mean"))


@register("bootstrap_ci")
def bootstrap_ci(spark, sf):
    return stats.bootstrap(table(spark, sf, "events"), ["event_type"], "event_id", "value").select("event_type", "n", *(r6(c).alias(c) for c in ("mean", "ci_lower", "ci_upper")))


@register("bootstrap_ci_capped")
def bootstrap_ci_capped(spark, sf):
    return stats.bootstrap(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice", None).select("o_orderpriority", "n", *(r6(c).alias(c) for c in ("mean", "ci_lower", "ci_upper")))


@register("paired_percent_negative", f"SELECT event_type, {q6('100.0 * avg(CASE WHEN value - 200 < 0 THEN 1.0 ELSE 0.0 END)')} AS percent FROM events GROUP BY 1")
def paired_percent_negative(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(r6(100.0 * stats.failure_rate(F.col("value") - 200, 0.0)).alias("percent"))


@register("score_over_one", f"SELECT count(*) FILTER (WHERE {SCORE} > 1) AS over_1, count(*) FILTER (WHERE {SCORE} > 999) AS over_999 FROM events")
def score_over_one(spark, sf):
    return table(spark, sf, "events").select(score().alias("k")).agg(F.count_if(F.col("k") > 1).alias("over_1"), F.count_if(F.col("k") > 999).alias("over_999"))


@register("unit_sizes", f"SELECT page_id, {q6('strlen(html) / 1024.0::DOUBLE')} AS kb, {q6('strlen(html) / 1048576.0::DOUBLE')} AS mb FROM pages")
def unit_sizes(spark, sf):
    n = F.octet_length("html")
    return table(spark, sf, "pages").select("page_id", r6(S.in_unit(n, "KB")).alias("kb"), r6(S.in_unit(n, "MB")).alias("mb"))


@register("utc_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events")
def utc_timestamps(spark, sf):
    return table(spark, sf, "events").select("event_id", S.utc_iso(F.col("ts")).alias("iso"))


@register("source_audit", "SELECT lang, count(*) AS n, count(l.doc_id) AS refined, count(*) - count(l.doc_id) AS fallback FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def source_audit(spark, sf):
    d = relate.choose_source(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", [("refined", table(spark, sf, "labels"))], "fallback")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "refined").alias("refined"), F.count_if(F.col("source") == "fallback").alias("fallback"))

"""Frozen selections, positions, strata and quotas over events, documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import select
from tessella.registry import register

from .common import SCORE, q6, r6, score, table

_SCORED = f"SELECT event_id, event_type, {SCORE} AS k FROM events WHERE event_type = 'click'"
_TOP = f"WITH s AS ({_SCORED}), n AS (SELECT greatest(1, least(count(k), round_even(count(*) * 0.25, 0)))::BIGINT AS n FROM s) SELECT event_id, k FROM (SELECT event_id, k, row_number() OVER (ORDER BY k DESC, event_id) AS r FROM s WHERE k IS NOT NULL), n WHERE r <= n"


def _scored(spark, sf):
    return table(spark, sf, "events").where("event_type = 'click'").select("event_id", "event_type", score().alias("k"))


@register("top_fraction", _TOP)
def top_fraction(spark, sf):
    return select.top_fraction(_scored(spark, sf), "k", "event_id", 0.25).select("event_id", "k")


@register("top_fraction_meta", f"WITH t AS ({_TOP}) SELECT (SELECT count(*) FROM ({_SCORED})) AS total_count, (SELECT count(k) FROM ({_SCORED})) AS scored_count, count(*) AS selected_count, min(k) AS selected_score_min, max(k) AS selected_score_max FROM t")
def top_fraction_meta(spark, sf):
    rows = _scored(spark, sf)
    return select.selection_metadata(rows, select.top_fraction(rows, "k", "event_id", 0.25), "k")


@register("top_fraction_by_group", f"WITH s AS (SELECT event_id, event_type, {SCORE} AS k FROM events), n AS (SELECT event_type, greatest(1, least(count(k), round_even(count(*) * 0.1, 0)))::BIGINT AS n FROM s GROUP BY 1) SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k DESC, event_id) AS r FROM s WHERE k IS NOT NULL) JOIN n USING (event_type) WHERE r <= n")
def top_fraction_by_group(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", score().alias("k"))
    return select.top_fraction_by(rows, "event_type", "k", "event_id", 0.1).select("event_type", "event_id")


@register("nested_score", f"SELECT event_id, {SCORE} AS score FROM events WHERE {SCORE} IS NOT NULL")
def nested_score(spark, sf):
    return table(spark, sf, "events").select("event_id", score().alias("score")).where("score IS NOT NULL")


@register("quantile_positions", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), p AS (SELECT DISTINCT event_type, CASE WHEN j = 6 THEN n - 1 ELSE round_even(j * ((n - 1) / 6.0::DOUBLE), 0)::BIGINT END AS i FROM (SELECT DISTINCT event_type, n FROM r), range(0, 7) t(j)) SELECT event_type, event_id FROM r JOIN p USING (event_type, i)")
def quantile_positions(spark, sf):
    return select.at_quantile_positions(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], [F.col("value"), F.col("event_id")], 7).select("event_type", "event_id")


@register("positional_index", "SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS position FROM pages")
def positional_index(spark, sf):
    return select.ranked(table(spark, sf, "pages").select("page_id", "url"), [F.col("url"), F.col("page_id")]).select("page_id", "position")


@register("rank_table", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey FROM orders QUALIFY rank <= 50")
def rank_table(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return select.ranked(select.first_few(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 50), [F.col("o_totalprice").desc(), F.col("o_orderkey")], name="rank", start=1).select("rank", "o_orderkey")


@register("first_n_listed", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 100")
def first_n_listed(spark, sf):
    return select.first_few(table(spark, sf, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 100)


@register("first_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 5")
def first_missing(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")
    return select.first_few(d, [F.col("doc_id")], 5)


@register("ends_and_middle", "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey, 'worst' AS kind FROM r WHERE i < 5 UNION ALL SELECT c_custkey, 'best' FROM r WHERE i >= n - 5 UNION ALL SELECT c_custkey, 'middle' FROM r WHERE i >= greatest(n // 2 - 2, 0) AND i < greatest(n // 2 - 2, 0) + 5")
def ends_and_middle(spark, sf):
    return select.ends_and_middle(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")], 5).select("c_custkey", "kind")


_TERTILE = "WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) - 1 AS i, count(*) OVER () AS n FROM events), c AS (SELECT max(CASE WHEN i = n // 3 THEN value END) AS a, max(CASE WHEN i = 2 * n // 3 THEN value END) AS b FROM r) SELECT event_id, value, CASE WHEN value <= a THEN 0 WHEN value <= b THEN 1 ELSE 2 END AS tertile FROM events, c"


def _tertiles(spark, sf):
    return select.tertiles(table(spark, sf, "events").select("event_id", "value"), "value")


@register("tertile_cut", f"SELECT event_id, tertile FROM ({_TERTILE})")
def tertile_cut(spark, sf):
    return _tertiles(spark, sf).select("event_id", "tertile")


@register("tertile_balance", f"SELECT tertile, count(*) AS n, {q6('avg(value)')} AS mean, {q6('stddev_pop(value)')} AS std FROM ({_TERTILE}) GROUP BY tertile")
def tertile_balance(spark, sf):
    return _tertiles(spark, sf).groupBy("tertile").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"))


@register("dataset_balanced_quota", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS turn, list_position(['en', 'de', 'fr'], lang) AS place FROM documents WHERE lang IN ('en', 'de', 'fr')) SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, place) AS slot FROM t) WHERE slot <= 10")
def dataset_balanced_quota(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang", "n_chars", "doc_id")
    return select.quota_cohort(d, "source", "lang", ["en", "de", "fr"], [F.col("n_chars"), F.col("doc_id")], 10).select("source", "doc_id")


@register("balanced_cohort", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), p AS (SELECT DISTINCT lang, CASE WHEN j = 3 THEN n - 1 ELSE round_even(j * ((n - 1) / 3.0::DOUBLE), 0)::BIGINT END AS i FROM (SELECT DISTINCT lang, n FROM r), range(0, 4) t(j)) SELECT lang, doc_id FROM r JOIN p USING (lang, i)")
def balanced_cohort(spark, sf):
    return select.balanced_cohort(table(spark, sf, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.col("n_chars"), F.col("doc_id")], 4).select("lang", "doc_id")


@register("all_cohort", "SELECT doc_id, lang, source, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents")
def all_cohort(spark, sf):
    return select.ranked(table(spark, sf, "documents").select("doc_id", "lang", "source"), [F.col("doc_id")])


@register("latest_checkpoint", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 1")
def latest_checkpoint(spark, sf):
    return select.latest(table(spark, sf, "events").select("event_id", "user_id", "ts"), "ts", "event_id").select("event_id", "user_id")


_ABS = "WITH m AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) SELECT o_orderkey, o_totalprice - m AS d FROM orders JOIN m USING (o_custkey)"


def _price_deltas(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.join(o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m")), "o_custkey").select("o_orderkey", (F.col("o_totalprice") - F.col("m")).alias("d"))


@register("top_abs_delta", f"SELECT o_orderkey, {q6('d')} AS delta FROM ({_ABS}) ORDER BY abs(round(d, 6)) DESC, o_orderkey LIMIT 50")
def top_abs_delta(spark, sf):
    return select.first_few(_price_deltas(spark, sf), [F.abs(F.round("d", 6)).desc(), F.col("o_orderkey")], 50).select("o_orderkey", r6("d").alias("delta"))


@register("noise_filter", f"SELECT o_orderkey FROM ({_ABS}) WHERE d IS NOT NULL AND abs(d) > 0.001")
def noise_filter(spark, sf):
    return _price_deltas(spark, sf).where("d IS NOT NULL AND abs(d) > 0.001").select("o_orderkey")

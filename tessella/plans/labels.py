"""Label sources: fallbacks, tiers, key integrity, pairing with a baseline, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import raster, relate, select, stats
from tessella.registry import register

from .common import q6, r6, table

# ordered fallbacks


@register(
    "source_fallback",
    "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality::BIGINT ELSE d.n_chars % 2 END AS value, CASE WHEN l.doc_id IS NOT NULL THEN 'primary' ELSE 'fallback' END AS source FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
)
def source_fallback(spark, sf):
    primary = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("value"))
    return relate.with_fallback(primary, table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).alias("value")), "doc_id", "value")


@register(
    "source_counts",
    "SELECT s.source, count(x.src) AS n FROM (VALUES ('primary'), ('fallback'), ('missing')) s(source) LEFT JOIN (SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'primary' ELSE 'fallback' END AS src FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id) x ON x.src = s.source GROUP BY s.source",
)
def source_counts(spark, sf):
    return stats.zero_filled_counts(source_fallback(spark, sf), "source", ["primary", "fallback", "missing"])


@register(
    "three_tier_source",
    "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'refined' WHEN l.doc_id IS NOT NULL THEN 'naive' ELSE 'soft' END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def three_tier_source(spark, sf):
    l = table(spark, sf, "labels")
    return relate.choose_source(table(spark, sf, "documents").select("doc_id"), "doc_id", [("refined", l.where("quality = 1")), ("naive", l)], "soft")


@register(
    "two_tier_source",
    "SELECT doc_id, CASE WHEN lang IN ('de', 'fr') OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'refined' ELSE 'soft' END AS source FROM documents",
)
def two_tier_source(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    picked = d.where(F.col("lang").isin("de", "fr")).select("doc_id").union(table(spark, sf, "labels").where("toxic = 1").select("doc_id"))
    return relate.choose_source(d.select("doc_id"), "doc_id", [("refined", picked)], "soft")


@register(
    "fallback_to_converted",
    "SELECT d.doc_id, coalesce(l.quality::DOUBLE, round(d.n_chars / 1000.0, 6)) AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0",
)
def fallback_to_converted(spark, sf):
    l = table(spark, sf, "labels").where("toxic = 0").select("doc_id", F.col("quality").cast("double").alias("q"))
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(l, "doc_id", "left").select("doc_id", F.coalesce("q", F.round(F.col("n_chars") / 1000.0, 6)).alias("label"))


@register(
    "regenerated_labels",
    "WITH best AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations WHERE role = 'assistant'), d AS (SELECT DISTINCT conv_id FROM conversations) SELECT d.conv_id, coalesce(b.turn, -1)::BIGINT AS mask_index, CASE WHEN b.turn IS NULL THEN 'coarse' ELSE 'raw' END AS source FROM d LEFT JOIN best b ON b.conv_id = d.conv_id AND b.k = 1",
)
def regenerated_labels(spark, sf):
    c = table(spark, sf, "conversations")
    best = select.best_per(c.where("role = 'assistant'"), ["conv_id"], [F.length("text").desc(), F.col("turn").asc()]).select("conv_id", "turn")
    return c.select("conv_id").distinct().join(best, "conv_id", "left").select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("mask_index"), F.when(F.col("turn").isNull(), "coarse").otherwise("raw").alias("source"))


# key integrity


@register(
    "missing_extra_keys",
    "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'extra' FROM labels WHERE doc_id % 7 <> 0 AND doc_id NOT IN (SELECT doc_id FROM documents)",
)
def missing_extra_keys(spark, sf):
    return relate.key_differences(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@register("key_union", "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def key_union(spark, sf):
    return table(spark, sf, "documents").select("doc_id").union(table(spark, sf, "labels").select("doc_id")).distinct()


@register("key_intersection", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels")
def key_intersection(spark, sf):
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@register("key_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def key_difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@register(
    "same_keys",
    "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels))::BIGINT AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))::BIGINT AS extra",
)
def same_keys(spark, sf):
    d = missing_extra_keys(spark, sf)
    return d.agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "extra").alias("extra"))


@register("bag_union", "SELECT 'documents' AS dataset, doc_id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels")
def bag_union(spark, sf):
    a = table(spark, sf, "documents").select(F.lit("documents").alias("dataset"), "doc_id")
    return a.unionByName(table(spark, sf, "labels").select(F.lit("labels").alias("dataset"), "doc_id"))


@register("unknown_members", "SELECT * FROM (VALUES ('nowhere'), ('src999')) v(source) WHERE source NOT IN (SELECT source FROM documents)")
def unknown_members(spark, sf):
    names = spark.createDataFrame([("src0",), ("src3",), ("nowhere",), ("src999",)], "source string")
    return relate.unknown_members(names, table(spark, sf, "documents"), "source")


@register("contained_keys", "SELECT count(*)::BIGINT AS outside FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def contained_keys(spark, sf):
    return relate.exclude_keys(table(spark, sf, "labels"), table(spark, sf, "documents"), "doc_id").agg(F.count("*").alias("outside"))


@register(
    "dense_index_gaps",
    "WITH n AS (SELECT count(*) AS n FROM labels) SELECT i::BIGINT AS position FROM n, range(0, n.n) t(i) WHERE i NOT IN (SELECT doc_id FROM labels)",
)
def dense_index_gaps(spark, sf):
    l = table(spark, sf, "labels")
    all_ = l.agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("position")).where("position >= 0")
    return relate.exclude_keys(all_, l.select(F.col("doc_id").alias("position")), "position")


@register(
    "index_drift",
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id FROM (SELECT doc_id, lang FROM documents) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 13 <> 0) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.lang IS DISTINCT FROM b.lang",
)
def index_drift(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    other = d.where("doc_id % 13 <> 0").withColumn("lang", F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")))
    return relate.drifted(d, other, "doc_id", ["lang"])


# filters


@register("include_keys", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def include_keys(spark, sf):
    return relate.include_keys(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").where("quality = 0"), "doc_id")


@register("exclude_cohort", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude_cohort(spark, sf):
    return relate.exclude_keys(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@register("dataset_spec_scan", "SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src4', 'src7') GROUP BY source")
def dataset_spec_scan(spark, sf):
    return table(spark, sf, "documents").where(F.col("source").isin("src1+src4+src7".split("+"))).groupBy("source").agg(F.count("*").alias("n"))


@register(
    "named_paths",
    "SELECT split_part(s, '=', 1) AS name, substr(s, strpos(s, '=') + 1) AS path FROM (VALUES ('gt=/a/b=c'), ('pred=/p')) v(s)",
)
def named_paths(spark, sf):
    rows = spark.createDataFrame([("gt=/a/b=c",), ("pred=/p",)], "s string")
    parts = F.split("s", "=", 2)
    return rows.select(parts[0].alias("name"), parts[1].alias("path"))


@register("skip_listed_files", "SELECT page_id, url FROM pages WHERE url NOT LIKE '%/es/%' AND url NOT LIKE '%utm%'")
def skip_listed_files(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url").where(~F.col("url").contains("/es/") & ~F.col("url").contains("utm"))


# joins


@register("lookup_with_default", "SELECT d.doc_id, coalesce(CASE l.toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'clean' END, 'unknown') AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lookup_with_default(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("state"))
    return relate.lookup(table(spark, sf, "documents").select("doc_id"), l, "doc_id", "state", "unknown")


@register(
    "sample_records",
    "WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_name FROM part), b AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_name FROM supplier), c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_name FROM customer) SELECT a.i AS position, p_name, s_name, c_name FROM a JOIN b USING (i) JOIN c USING (i)",
)
def sample_records(spark, sf):
    parts = [select.ranked(table(spark, sf, t).select(k, n), [F.col(k).asc()]).drop(k) for t, k, n in (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"))]
    return relate.zipped("position", *parts)


@register(
    "prediction_expansion",
    "SELECT l.doc_id, p.prediction, p.v AS value FROM labels l JOIN (SELECT doc_id, 'chars' AS prediction, n_chars AS v FROM documents UNION ALL SELECT doc_id, 'langs', length(lang) FROM documents) p ON l.doc_id = p.doc_id",
)
def prediction_expansion(spark, sf):
    d = table(spark, sf, "documents")
    sets = d.select("doc_id", F.lit("chars").alias("prediction"), F.col("n_chars").alias("value")).unionByName(d.select("doc_id", F.lit("langs").alias("prediction"), F.length("lang").cast("long").alias("value")))
    return relate.expand_predictions(table(spark, sf, "labels").select("doc_id"), sets, "doc_id")


@register("name_to_index", "SELECT n_name, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def name_to_index(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    return n.join(s, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey")


@register("sorted_lookup", "SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def sorted_lookup(spark, sf):
    keys = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"))
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key")).distinct().join(keys, "key")


@register(
    "directory_compare",
    "SELECT a.lang, count(*) AS n, sum(CASE WHEN a.n_chars > b.m THEN 1 ELSE 0 END)::BIGINT AS larger FROM documents a JOIN (SELECT source, avg(n_chars) AS m FROM documents GROUP BY source) b ON a.source = b.source GROUP BY a.lang",
)
def directory_compare(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", "n_chars")
    m = d.groupBy("source").agg(F.avg("n_chars").alias("m"))
    return d.join(m, "source").groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("n_chars") > F.col("m")).cast("long")).alias("larger"))


_CELLS = "SELECT l_partkey AS part, l_linestatus AS member, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1, 2"
_DELTAS = f"WITH f AS ({_CELLS}) SELECT a.part, a.member, a.quantity - b.quantity AS dq, a.discount - b.discount AS dd, a.tax - b.tax AS dt FROM f a JOIN f b ON a.part = b.part AND b.member = 'F' WHERE a.member <> 'F'"


def _deltas(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("member"), "l_quantity", "l_discount", "l_tax")
    facts = l.groupBy("part", "member").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return relate.paired_with_baseline(facts, ["part"], "member", "F", ["quantity", "discount", "tax"])


@register("baseline_paired_delta", f"SELECT part, member, {q6('dq')} AS d_quantity, {q6('dd')} AS d_discount, {q6('dt')} AS d_tax FROM ({_DELTAS})")
def baseline_paired_delta(spark, sf):
    return _deltas(spark, sf).select("part", "member", *(r6(f"d_{m}").alias(f"d_{m}") for m in ("quantity", "discount", "tax")))


@register("paired_delta_means", f"SELECT member, count(*) AS n, {q6('avg(dq)')} AS d_quantity, {q6('avg(dd)')} AS d_discount, {q6('avg(dt)')} AS d_tax FROM ({_DELTAS}) GROUP BY member")
def paired_delta_means(spark, sf):
    return _deltas(spark, sf).groupBy("member").agg(F.count("*").alias("n"), *(r6(F.avg(f"d_{m}")).alias(f"d_{m}") for m in ("quantity", "discount", "tax")))


@register("catastrophic_rate", f"SELECT member, {q6('avg(CASE WHEN dq < -2.0 THEN 1.0 ELSE 0.0 END)')} AS rate, {q6('100.0 * avg(CASE WHEN dq < 0 THEN 1.0 ELSE 0.0 END)')} AS percent_negative FROM ({_DELTAS}) GROUP BY member")
def catastrophic_rate(spark, sf):
    return _deltas(spark, sf).groupBy("member").agg(r6(stats.failure_rate(F.col("d_quantity"), -2.0)).alias("rate"), r6(100.0 * stats.failure_rate(F.col("d_quantity"), 0.0)).alias("percent_negative"))


# candidates: a conversation is an image, its roles are prompts, its turns mask indices

_SIM = "least(length(a.text), length(b.text))::DOUBLE / greatest(length(a.text), length(b.text), 1)"
_STABLE = f"""SELECT c.conv_id, c.role, c.turn, coalesce(s.st, 0.5) AS st FROM conversations c LEFT JOIN (SELECT conv_id, role, turn, avg(best) AS st FROM (
SELECT a.conv_id, a.role, a.turn, b.role AS o, max({_SIM}) AS best FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role <> b.role GROUP BY ALL) GROUP BY ALL) s ON s.conv_id = c.conv_id AND s.role = c.role AND s.turn = c.turn"""


def _stability(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "role", "turn", F.length("text").alias("size"))
    similar = F.least("a.size", "b.size") / F.greatest(F.col("a.size"), F.col("b.size"), F.lit(1))
    return relate.stability(c, "conv_id", "role", "turn", similar)


@register("candidate_stability", f"SELECT conv_id, role, turn, {q6('st')} AS stability FROM ({_STABLE})")
def candidate_stability(spark, sf):
    return _stability(spark, sf).select("conv_id", "role", "turn", r6("stability").alias("stability"))


_QUALITY = "SELECT conv_id, role, turn, least(length(text) / 2000.0, 1.0)::DOUBLE AS quality, length(text) % 7 AS growth, length(text) % 11 AS extra FROM conversations"


def _quality(spark, sf):
    n = F.length("text")
    return table(spark, sf, "conversations").select("conv_id", "role", "turn", F.least(n / 2000.0, F.lit(1.0)).alias("quality"), (n % 7).cast("long").alias("growth"), (n % 11).cast("long").alias("extra"))


@register("select_candidate", f"SELECT conv_id, role, turn, {q6('quality')} AS quality FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY quality DESC, role, turn) AS k FROM ({_QUALITY})) WHERE k = 1")
def select_candidate(spark, sf):
    return select.best_per(_quality(spark, sf), ["conv_id"], [F.col("quality").desc(), F.col("role"), F.col("turn")]).select("conv_id", "role", "turn", r6("quality").alias("quality"))


@register("select_candidate_or_none", f"WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY quality DESC, role, turn) AS k FROM ({_QUALITY})) SELECT conv_id, CASE WHEN quality >= 0.35 THEN role END AS role, CASE WHEN quality >= 0.35 THEN 'candidate' ELSE 'coarse' END AS label FROM b WHERE k = 1")
def select_candidate_or_none(spark, sf):
    best = select.best_per(_quality(spark, sf), ["conv_id"], [F.col("quality").desc(), F.col("role"), F.col("turn")])
    good = F.col("quality") >= 0.35
    return best.select("conv_id", F.when(good, F.col("role")).alias("role"), F.when(good, "candidate").otherwise("coarse").alias("label"))


_ALTERNATIVE = f"""WITH q AS ({_QUALITY}), b AS (SELECT conv_id, quality AS best, growth AS g0 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY quality DESC, role, turn) AS k FROM q) WHERE k = 1),
a AS (SELECT q.*, b.g0, row_number() OVER (PARTITION BY q.conv_id ORDER BY growth, extra, quality DESC, role, turn) AS k FROM q JOIN b USING (conv_id) WHERE quality >= best - 0.1)"""


@register("select_alternative", f"{_ALTERNATIVE} SELECT conv_id, role, turn, growth, extra FROM a WHERE k = 1")
def select_alternative(spark, sf):
    return _alternative(spark, sf).select("conv_id", "role", "turn", "growth", "extra")


def _alternative(spark, sf):
    q = _quality(spark, sf)
    best = select.best_per(q, ["conv_id"], [F.col("quality").desc(), F.col("role"), F.col("turn")]).select("conv_id", F.col("quality").alias("best"), F.col("growth").alias("g0"))
    near = q.join(best, "conv_id").where("quality >= best - 0.1")
    return select.best_per(near, ["conv_id"], [F.col("growth"), F.col("extra"), F.col("quality").desc(), F.col("role"), F.col("turn")])


@register("lower_growth_alternatives", f"{_ALTERNATIVE} SELECT count(*) FILTER (WHERE growth < g0)::BIGINT AS n_lower, count(*)::BIGINT AS n FROM a WHERE k = 1")
def lower_growth_alternatives(spark, sf):
    return _alternative(spark, sf).agg(F.count_if(F.col("growth") < F.col("g0")).alias("n_lower"), F.count("*").alias("n"))


@register("selected_cardinality", "SELECT conv_id, role, turn, count(*) AS n FROM conversations GROUP BY ALL")
def selected_cardinality(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", "role", "turn").agg(F.count("*").alias("n"))


@register("valid_candidates", "SELECT vec_id FROM (SELECT vec_id, len(list_filter(embedding, lambda v: v > 0)) AS a, embedding[1]::DOUBLE + 0.5 AS s FROM embeddings) WHERE a > 0 AND a < 64 AND s >= 0.25")
def valid_candidates(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", raster.area(raster.mask_of(F.col("embedding"))).alias("a"), (F.col("embedding")[0].cast("double") + 0.5).alias("s"))
    return e.where("a > 0 AND a < 64 AND s >= 0.25").select("vec_id")


@register("risk_flags", "SELECT doc_id, (n_chars % 5 > 2 OR n_chars / 40000.0 > 0.05) AS risk FROM documents")
def risk_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 5 > 2) | (F.col("n_chars") / 40000.0 > 0.05)).alias("risk"))


# names and files


@register("safe_names", "SELECT name, (name <> '' AND name NOT IN ('.', '..') AND NOT regexp_matches(name, '[/\\\\]')) AS safe FROM (VALUES ('a'), ('a/b'), ('..'), ('.'), ('x.y'), ('a\\b'), ('')) v(name)")
def safe_names(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ("a", "a/b", "..", ".", "x.y", "a\\b", "")], "name string")
    return rows.select("name", S.is_safe_name(F.col("name")).alias("safe"))


@register("experiment_ids", "SELECT source || '-' || lang AS id, regexp_full_match(source || '-' || lang, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') AS valid, count(*) AS n FROM documents GROUP BY 1, 2")
def experiment_ids(spark, sf):
    i = F.concat_ws("-", "source", "lang")
    return table(spark, sf, "documents").groupBy(i.alias("id"), S.is_experiment_id(i).alias("valid")).agg(F.count("*").alias("n"))


@register("stem_of_path", r"SELECT page_id, regexp_extract(regexp_extract(url, '([^/\\]*)$', 1), '^(.+?)(?:\.[^.]*)?$', 1) AS stem FROM pages")
def stem_of_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.file_stem(F.col("url")).alias("stem"))


@register("content_hash", "SELECT page_id, sha256(html) AS sha256, strlen(html)::BIGINT AS size FROM pages")
def content_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size"))


@register(
    "natural_sort",
    "SELECT name, row_number() OVER (ORDER BY regexp_extract(name, '^(\\D*)', 1), regexp_extract(name, '(\\d+)', 1)::BIGINT, name) - 1 AS position FROM (SELECT 'img' || (p_partkey % 97) || '.png' AS name FROM part GROUP BY 1)",
)
def natural_sort(spark, sf):
    names = table(spark, sf, "part").select(F.concat(F.lit("img"), F.col("p_partkey") % 97, F.lit(".png")).alias("name")).distinct()
    return select.ranked(names, [S.natural_key(F.col("name")).asc(), F.col("name").asc()])


@register("counted_names", "SELECT p_partkey, p_name || '_' || (row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1) AS counted_name FROM part")
def counted_names(spark, sf):
    return select.with_counter(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", [F.col("p_partkey")]).select("p_partkey", "counted_name")

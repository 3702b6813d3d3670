"""URL filters by hashed host-suffix and path-prefix expressions.

A URL is looked up as every combination of its host, shorter suffixes of it, its path with and without the query, and prefixes of the
path, as many as the deepest rule has. Rules carry the SHA-256 of their expression. Expressions meet rules on the digest's first four bytes, then
the whole digest confirms the match, and precedence picks one rule for a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (expression, action, priority). An expression is a host, then a path that ends in "/" for a prefix, else stands for itself.
#: Bad hosts have priority 1, so that no allowed parent or subdomain opens them; what is allowed of them has 2.
RULES = [
    *((f"{name}.example.{top}/", "block", 1) for name in ("casino-win", "free-bets", "cheap-pills", "adult-x") for top in ("com", "net", "org")),
    ("casino-win.example.com/legal/", "allow", 2),
    ("www.cheap-pills.example.com/", "allow", 0),
    ("example.com/", "allow", 0),
    ("example.net/", "allow", 0),
    ("example.org/", "allow", 0),
    ("example.com/casino/", "block", 0),
    ("example.com/adult/", "block", 0),
    ("example.net/casino/", "block", 0),
    ("example.net/adult/", "block", 0),
    ("example.org/casino/", "block", 0),
    ("example.org/adult/", "block", 0),
    ("example.org/casino/history", "allow", 0),
    ("example.org/en/search?q=casino", "block", 0),
]
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]*\]|[^/?#:@\[\]]*)"
_REST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"
_ESCAPED = "^(?:[^%]|%[0-9A-Fa-f][0-9A-Fa-f])*$"
_ADDRESS = r"^([0-9.]+|\[.*)$"


def depth(rules: DataFrame) -> tuple[int, int]:
    """Numbers of host suffixes (of two labels and more) and of path prefixes with which expressions() leaves out nothing that a rule names."""
    e = rules["expression"].cast("string")
    host = F.substring_index(e, "/", 1)
    labels, slashes = rules.agg(F.max(F.size(F.split(host, "[.]"))), F.max(F.length(e) - F.length(F.replace(e, F.lit("/"), F.lit(""))))).first()
    return max(1, (labels or 0) - 1), max(1, slashes or 0)


def canonical_path(path: Column) -> Column:
    """Escapes undone where all are well formed, runs of slashes as one, and segments . and .. resolved; "/" for none."""
    path = F.when(path.contains("%") & path.rlike(_ESCAPED), F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)
    path = F.regexp_replace(path, "/{2,}", "/")
    parts = F.split(path, "/", -1)
    closed = F.when(path.rlike(r"/[.][.]?$"), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    walked = F.aggregate(
        F.slice(closed, F.lit(2), F.greatest(F.size(closed) - 1, F.lit(1))),
        F.array(F.lit("")),
        lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    path = F.when(path.contains("/."), F.array_join(walked, "/")).otherwise(path)
    return F.when(path == "", F.lit("/")).otherwise(path)


def expressions(url: Column, suffixes: int, prefixes: int) -> Column:
    """The distinct lookup expressions of a URL, with at most so many host suffixes and path prefixes; null for null, none for what has
    no scheme or host. Spaces around and tabs and line ends within are left out, as are user, port and fragment."""
    clean = F.trim(F.regexp_replace(url, r"[\t\r\n]", ""))
    host = F.lower(F.regexp_replace(F.regexp_extract(clean, _HOST, 1), r"^[.]+|[.]+$", ""))
    rest = F.regexp_extract(clean, _REST, 1)
    path = canonical_path(F.regexp_extract(rest, r"^([^?]*)", 1))
    query = F.regexp_extract(rest, r"^[^?]*([?].*)$", 1)
    labels, parts = F.split(host, "[.]"), F.split(path, "/")
    shorter = F.filter(
        F.transform(F.sequence(F.lit(2), F.lit(suffixes + 1)), lambda n: F.when(n < F.size(labels), F.array_join(F.slice(labels, -n, n), "."))),
        lambda x: x.isNotNull(),
    )
    hosts = F.concat(F.array(host), F.when(host.rlike(_ADDRESS), F.array().cast("array<string>")).otherwise(shorter))
    prefixes = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(prefixes - 1)), lambda k: F.when(k <= F.size(parts) - 2, F.concat(F.array_join(F.slice(parts, F.lit(1), k + 1), "/"), F.lit("/")))),
        lambda x: x.isNotNull(),
    )
    paths = F.array_distinct(F.concat(F.when(query != "", F.array(F.concat(path, query))).otherwise(F.array().cast("array<string>")), F.array(path), prefixes))
    all_ = F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))
    return F.when(url.isNotNull(), F.when(host != "", all_).otherwise(F.array().cast("array<string>")))


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(f, r, rank) of every rule that an expression of a row (f, r, url) meets. Counted rules that are few enough go to every task, so that
    expressions move nowhere; else both sides shuffle by the short prefix."""
    keyed = rows.select("f", "r", F.explode(expressions(F.col("url"), *depth(rules))).alias("expression")).select("f", "r", F.sha2("expression", 256).alias("digest"))
    keyed = keyed.withColumn("short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
    listed = rules.select(rules["expression"].cast("string").alias("expression"), rules["action"].alias("action"), F.coalesce(rules["priority"], F.lit(0)).alias("priority")).where("expression IS NOT NULL AND action IS NOT NULL").distinct()
    labels = F.size(F.split(F.substring_index("expression", "/", 1), "[.]"))
    order = F.struct((-F.col("priority")).alias("a"), (-labels).alias("b"), (-F.length("expression")).alias("c"), (F.col("action") != "allow").alias("d"), "expression", "action")
    listed = listed.select(F.sha2("expression", 256).alias("whole"), order.alias("rank"))
    listed = common.small_enough(listed.withColumn("key", F.conv(F.substring("whole", 1, 8), 16, 10).cast("long")), 512)
    return keyed.join(listed, F.col("short") == F.col("key")).where("digest = whole").select("f", "r", "rank")


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, verdict, rule) of every row of pages: the action and expression of the rule that decides, or "none" and null.

    Of the rules that match, the highest priority decides, then the more host labels, the longer expression, allow over block, and
    the expression that sorts first. A null priority is 0; rules without an expression or action match nothing, and repeated rules count once. Null and
    malformed URLs match nothing. Repeated rows are judged each on its own; extra columns play no part; very long URLs count whole, and
    rules of any depth. An empty table of pages gives an empty one, of rules "none" throughout.
    """
    known = common.with_row_id(pages)
    rows = known.select("f", "r", F.col("doc.page_id").alias("page_id"), F.col("doc.url").cast("string").alias("url"))
    decided = common.materialise(matches(rows, rules).groupBy("f", "r").agg(F.min("rank").alias("rank")), "decided")
    out = rows.select("f", "r", "page_id").join(common.small_enough(decided, 128), ["f", "r"], "left")
    return out.select("page_id", F.coalesce("rank.action", F.lit("none")).alias("verdict"), F.col("rank.expression").alias("rule"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "expression string, action string, priority int")
    return apply_rules(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def _sql() -> str:
    rules = ", ".join(f"('{e}', '{a}', {p})" for e, a, p in RULES)
    walked = "array_to_string(list_reduce(list_transform(parts, lambda x: [x]), lambda a, x: CASE WHEN x[1] = '..' THEN (CASE WHEN len(a) > 1 THEN a[:len(a) - 1] ELSE a END) WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END), '/')"
    return f"""
WITH p AS (SELECT page_id, trim(regexp_replace(url, '[\t\r\n]', '', 'g')) AS url, row_number() OVER () AS rid FROM pages),
a AS (
  SELECT rid, lower(regexp_replace(regexp_extract(url, '{_HOST}', 1), '^[.]+|[.]+$', '', 'g')) AS host, regexp_extract(url, '{_REST}', 1) AS rest FROM p),
b AS (SELECT rid, host, regexp_extract(rest, '^([^?]*)', 1) AS path, regexp_extract(rest, '^[^?]*([?].*)$', 1) AS query FROM a WHERE host <> ''),
c AS (
  SELECT rid, host, query, regexp_replace(CASE WHEN path LIKE '%\\%%' ESCAPE '\\' AND regexp_matches(path, '{_ESCAPED}') THEN url_decode(replace(path, '+', '%2B')) ELSE path END, '/{{2,}}', '/', 'g') AS path FROM b),
d AS (SELECT *, CASE WHEN regexp_matches(path, '/[.][.]?$') THEN string_split(path || '/', '/') ELSE string_split(path, '/') END AS parts FROM c),
e AS (SELECT rid, host, query, CASE WHEN path = '' THEN '/' WHEN contains(path, '/.') THEN coalesce(nullif({walked}, ''), '/') ELSE path END AS path FROM d),
h AS (
  SELECT rid, host AS h FROM e
  UNION SELECT rid, array_to_string(list_slice(string_split(host, '.'), len(string_split(host, '.')) - n + 1, len(string_split(host, '.'))), '.')
    FROM (SELECT rid, host, unnest(range(2, len(string_split(host, '.')))) AS n FROM e WHERE NOT regexp_matches(host, '{_ADDRESS}'))),
q AS (
  SELECT rid, path || query AS q FROM e
  UNION SELECT rid, path FROM e
  UNION SELECT rid, array_to_string(list_slice(string_split(path, '/'), 1, k + 1), '/') || '/' FROM (SELECT rid, path, unnest(range(0, len(string_split(path, '/')) - 1)) AS k FROM e)),
r(expression, action, priority) AS (VALUES {rules}),
m AS (
  SELECT h.rid, r.*, row_number() OVER (PARTITION BY h.rid ORDER BY priority DESC, len(string_split(split_part(expression, '/', 1), '.')) DESC, length(expression) DESC, action <> 'allow', expression) AS k
  FROM h JOIN q USING (rid) JOIN r ON r.expression = h.h || q.q)
SELECT p.page_id, coalesce(m.action, 'none') AS verdict, m.expression AS rule FROM p LEFT JOIN m ON m.rid = p.rid AND m.k = 1
"""


#: No number in it bounds how deep an expression may be.
SQL = _sql()

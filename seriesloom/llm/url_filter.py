"""URL rules by hashed expressions.

Each URL is expanded into its host suffixes (by label), which meet the rules' hosts in an equi-join on the first four bytes of
a SHA-256; the full digest confirms. For each host found, the path prefixes of the lengths that its rules have give
expressions, which meet the rules in a second such join. The longest rule that fits decides. Rules are a table of any size:
nothing of them is collected but the largest number of labels of a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.shared import checkpointed, lower_ascii

#: Rules of the registered query: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(host), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def hashed(expression: Column) -> tuple[Column, Column]:
    """The short prefix to join on and the full digest to confirm with."""
    digest = F.sha2(expression, 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), digest


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule, verdict for every row of pages.

    A rule fits its host and all subdomains where the path starts with the rule's path. Of several that fit the longest
    (host and path together) wins, then the one with the longer host, then block. Without a fitting rule the verdict is
    default and rule is null. Null urls and urls without :// have empty host and path and fit no rule; rules with a null host
    or path fit nothing. Rows that repeat are judged each, and repeated rules count once. Very long urls give one expression per
    label that some rule's host can have and one per length of such a host's rules. An empty table gives no rows; other
    columns are ignored, whatever they are called.
    """
    host, path = host_and_path(F.col(url_col))
    rows = checkpointed(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), host.alias("host"), path.alias("path")))
    rules = rules.where("host is not null and path is not null").select("verdict", "host", "path")
    most = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0]
    parts = F.split("host", r"\.", -1)
    labels = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most or 1)))
    suffixes = F.when(F.col("host") != "", F.transform(labels, lambda k: F.array_join(F.slice(parts, -k, k), ".")))
    short, full = hashed(F.col("suffix"))
    asked = rows.select("row", "path", F.explode(suffixes).alias("suffix")).select("row", "path", "suffix", short.alias("short"), full.alias("digest"))
    short, full = hashed(F.col("host"))
    hosts = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")).select(short.alias("short"), full.alias("host_digest"), "lengths")
    met = asked.join(hosts, "short").where(F.col("digest") == F.col("host_digest")).select("row", "path", "suffix", F.explode("lengths").alias("length"))
    # a line feed can be in a path but not at the end of a rule's host, so an expression has one reading
    expression = F.concat("suffix", F.lit("\n"), F.substring(F.col("path"), F.lit(1), F.col("length")))
    short, full = hashed(expression)
    expanded = met.where(F.length("path") >= F.col("length")).select("row", short.alias("short"), full.alias("digest"))
    rule = F.concat("host", "path")
    short, full = hashed(F.concat("host", F.lit("\n"), "path"))
    facts = F.struct(F.length(rule).alias("length"), F.length("host").alias("host_length"), (F.col("verdict") == "block").alias("blocks"), rule.alias("rule"), F.col("verdict").alias("verdict"))
    # of rules with one expression the one that wins stays
    known = rules.select(short.alias("short"), full.alias("rule_digest"), facts.alias("found")).groupBy("short", "rule_digest").agg(F.max("found").alias("found"))
    fitting = expanded.join(known, "short").where(F.col("digest") == F.col("rule_digest"))
    best = fitting.groupBy("row").agg(F.max("found").alias("found"))
    return rows.join(best, "row", "left").select(id_col, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
a AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT id, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS (SELECT id, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
best AS (
  SELECT p.id, arg_max({'rule': r.host || r.path, 'verdict': r.verdict}, (length(r.host || r.path), length(r.host), r.verdict = 'block')) AS found
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.id
)
SELECT p.page_id, p.host, p.path, found.rule AS rule, coalesce(found.verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (id)
"""

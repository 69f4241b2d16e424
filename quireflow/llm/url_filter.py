"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Each distinct (host, path) is expanded into the suffixes of its host that have
as many labels as some rule's host, times the prefixes of its path that have the
length of some rule's path; other expressions could fit no rule, and a host of
any number of labels costs no more than those. Expressions and
rules are equi-joined on a prefix of their SHA-256 digests; the full digests
confirm. Of the rules that fit, the longest (host and path together, then host)
wins. Where none fits the verdict is DEFAULT.

A null url, or one without ://, has an empty host and path and fits no rule.
However many rows have none, they meet in no task: their join keys are spread
over the partitions that they were read in. Repeated rows are judged each; an empty table (or no rule) is no special case;
extra columns are kept by the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (action, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEFAULT = "allow"
#: Characters (hexadecimal) of the digest that are joined on.
PREFIX = 8
MAX_BROADCAST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, _UPPER, _LOWER)).otherwise(""), F.when(has, path).otherwise("")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, rule_host string, rule_path string")


def judged(pages: DataFrame, rules: DataFrame, *, url_column: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict."""
    host, path = url_parts(F.col(url_column).cast("string"))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    rules = rules.withColumn("digest", F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)).withColumn("prefix", F.left("digest", F.lit(PREFIX)))
    n_rules, lengths = rules.count(), sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    joined = F.broadcast(rules) if n_rules <= MAX_BROADCAST_RULES else rules
    urls = pages.select("host", "path").where("host != ''").distinct()
    dots = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("."), F.lit("")))
    counts = sorted(r[0] for r in rules.select(dots("rule_host")).distinct().collect())
    suffixes = F.filter(F.array(*[F.when(dots("host") >= n, F.substring_index("host", ".", -n - 1)) for n in counts]), lambda s: s.isNotNull())
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(sizes, lambda n: F.concat(s, F.lit("\n"), F.left(F.col("path"), n)))))
    tried = urls.select("host", "path", F.explode(expressions).alias("expression")).withColumn("full", F.sha2("expression", 256)).withColumn("prefix", F.left("full", F.lit(PREFIX)))
    fits = tried.join(joined, "prefix").where("full = digest")
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), F.col("action").alias("action"))
    best = fits.groupBy("host", "path").agg(F.max(order).alias("best"))
    # A host has no #, so a row without one fits nothing under this key either.
    key = F.when(F.col("host") == "", F.concat(F.lit("#"), F.spark_partition_id().cast("string"))).otherwise(F.col("host"))
    best = best.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "best")
    out = pages.withColumn("__key", key).join(best, (F.col("__key") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    columns = [c for c in pages.columns if c not in ("host", "path")]
    return out.select(*columns, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(DEFAULT)).alias("verdict"))


ORACLE = f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
  CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r(action, rh, rp) AS (VALUES {", ".join(str(r) for r in RULES)}),
f AS (SELECT page_id, p.host AS host, path, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id, p.host, path ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS k
  FROM p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, '{DEFAULT}') AS verdict FROM p LEFT JOIN f ON f.page_id IS NOT DISTINCT FROM p.page_id AND f.host = p.host AND f.path = p.path AND k = 1
"""

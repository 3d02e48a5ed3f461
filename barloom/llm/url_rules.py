"""URL filters as a sort-merge range join of reversed-host keys, in DataFrame functions only.

A host becomes its labels in reverse with a closing dot (``com.example.www.``), so a rule's host and all
its subdomains are one interval of keys: those that start with the rule's key. Rules and urls are sorted
together; the last rule at or before a url carries the stack of rules it is nested in, and those of the
stack that the url's key starts with are the active ones. The same sweep over (rule host, path) then finds
the path prefixes.

Slices of the order are made by range partitioning on key and row, so a host with a third of all urls is
spread over many slices; what is open at the end of a slice is carried on as one row a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import carried, fold_case, slices

#: host and path of the rules of the query; fixed values.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host (A-Z lower-cased) up to / ? # and the path up to ? #; else both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return fold_case(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def with_stacks(prefixes: DataFrame) -> DataFrame:
    """Distinct keys, each with all keys of the set that it starts with, itself included."""
    cut = prefixes.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"))
    inner = cut.select(F.col("key").alias("whole"), F.substring("key", F.lit(1), F.col("n")).alias("key"))
    return inner.join(prefixes, "key").groupBy("whole").agg(F.collect_list("key").alias("stack")).withColumnRenamed("whole", "key")


def active(probes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``probes`` with column ``open``: the keys of ``prefixes`` that column ``key`` starts with.

    ``probes`` needs columns key and row; the result holds row numbers that stay fixed.
    """
    rest = [c for c in probes.columns if c not in ("key", "row")]
    rules = with_stacks(prefixes.filter("key is not null").distinct())
    both = probes.withColumns({"stack": F.lit(None).cast("array<string>"), "is_probe": F.lit(1)}).unionByName(rules.withColumn("is_probe", F.lit(0)), allowMissingColumns=True)
    sliced = slices(both, "key", "is_probe", "row")
    so_far = Window.partitionBy("_slice").orderBy("key", "is_probe", "row").rowsBetween(Window.unboundedPreceding, 0)
    swept = sliced.withColumn("last", F.last("stack", ignorenulls=True).over(so_far)).filter("is_probe = 1")
    top = swept.join(carried(sliced, "stack", "key"), "_slice", "left").withColumn("last", F.coalesce("last", "_carry"))
    return top.select("row", "key", *rest, F.filter("last", lambda p: F.startswith(F.col("key"), p)).alias("open"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains when the url's path starts with
    the rule's path. The longest host wins, then the longest path; of equal rules ``block`` wins. Without a rule
    the verdict is ``default`` and rule is null. A null url, or one without ``://``, has empty host and path.
    Rules with a null in any column fit nothing. Repeated pages are judged row by row; other columns of
    ``pages`` are ignored; an empty table gives an empty result.
    """
    rules = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).alias("v"))
    rules = rules.select(host_key(fold_case(F.col("host"))).alias("host_key"), F.concat(fold_case(F.col("host")), "path").alias("rule"), "path", F.col("v.verdict").alias("verdict"))
    rules = rules.withColumn("key", F.concat("host_key", F.lit("\0"), "path"))
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"key": host_key(F.col("host")), "row": F.monotonically_increasing_id()})
    hosts = active(urls, rules.select(F.col("host_key").alias("key")))
    per_host = hosts.select("row", "page_id", "host", "path", F.explode_outer("open").alias("top")).withColumn("key", F.concat(F.coalesce("top", F.lit("")), F.lit("\0"), "path"))
    fits = active(per_host, rules.select("key")).withColumn("fit", F.explode_outer("open"))
    best = fits.groupBy("row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(F.col("fit").isNotNull(), F.struct(F.length("top"), F.length("fit"), "fit"))).alias("best"),
    )
    named = best.join(rules.select(F.col("key").alias("fit"), "rule", "verdict"), F.col("best.fit") == F.col("fit"), "left")
    return named.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The same in SQL.
SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT row_number() OVER () AS id, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT id, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
fits AS (SELECT p.id, arg_max(r.host || r.path, length(r.host) * 10000 + length(r.path)) AS rule,
  arg_max(r.verdict, length(r.host) * 10000 + length(r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON p.id = f.id
"""

"""URL filters as a sort-merge range join over reversed-host keys.

A host is keyed by its labels in reverse (``www.example.com`` -> ``com.example.www.``), so a rule's
host and all its subdomains are one interval of keys: from ``com.example.`` up to, but without,
``com.example/`` (the byte after the dot). Such intervals nest or are apart. Hosts and interval starts
are range-partitioned and sorted together; a sweep carries the stack of open intervals, one slot for
each depth (number of labels): at one depth only the interval opened last can still be open. The state
at a partition's start comes from the partitions before it. Paths are compared within the open rules.

The sweep runs over distinct hosts, so a host with a third of all pages is one row in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for a null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    before_query = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.regexp_extract(before_query, r"^([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), F.substring(before_query, F.length(host) + 1, F.length(rest))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_intervals(rules: DataFrame) -> DataFrame:
    """One row per rule host: interval of keys, depth, and its rules (path, verdict, rule).

    Rules with a null part are ignored; of repeated rules ``block`` wins.
    """
    clean = rules.select(
        F.translate("rule_host", UPPER, LOWER).alias("h"), F.col("rule_path").alias("p"), F.col("rule_verdict").alias("v"),
    ).where("h IS NOT NULL AND p IS NOT NULL AND v IS NOT NULL").groupBy("h", "p").agg(F.max("v").alias("v"))
    return clean.groupBy("h").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("p").alias("path"), F.col("v").alias("verdict"), F.concat("h", "p").alias("rule"),
        ))).alias("rules"),
    ).select(
        host_key(F.col("h")).alias("key"), F.size(F.split("h", r"\.")).alias("depth"), "rules",
        F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("until"),
    )


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, open): the rules whose interval holds each distinct host; hosts without any are left out.

    ``rules`` must be a list a driver can count the depths of: at most 127, as a name has that many labels.
    """
    intervals = rule_intervals(rules)
    depths = [r[0] for r in intervals.select("depth").distinct().orderBy("depth").collect()]
    if not depths:
        return hosts.select("host", F.array().cast("array<struct<path:string,verdict:string,rule:string>>").alias("open")).limit(0)
    opened = F.struct("until", "rules")
    slot = lambda d: F.when(F.col("depth") == d, opened)
    both = hosts.select("host", host_key(F.col("host")).alias("key"), F.lit(1).alias("is_host"), *[
        F.lit(None).cast(t).alias(c) for c, t in (("until", "string"), ("depth", "int"), ("rules", intervals.schema["rules"].dataType))
    ]).unionByName(intervals.select(F.lit(None).cast("string").alias("host"), "key", F.lit(0).alias("is_host"), "until", "depth", "rules"))
    parts = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges of keys become buckets of the sweep; written, as a second pass could draw other ranges
    ranged = stage(both.repartitionByRange(parts, "key", "is_host").withColumn("bucket", F.spark_partition_id()))
    sweep = Window.partitionBy("bucket").orderBy("key", "is_host").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.select("bucket", "host", "key", "is_host", *[
        F.last(slot(d), ignorenulls=True).over(sweep).alias(f"s{d}") for d in depths
    ]).where("is_host = 1")
    # what a bucket leaves open, handed to all later buckets: one row per bucket with rules
    ends = ranged.where("is_host = 0").groupBy("bucket").agg(*[
        F.max_by(opened, F.when(F.col("depth") == d, F.col("key"))).alias(f"e{d}") for d in depths
    ])
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.select("bucket").distinct().join(ends, "bucket", "left").select("bucket", *[
        F.last(f"e{d}", ignorenulls=True).over(earlier).alias(f"c{d}") for d in depths
    ])
    stack = F.array(*[F.coalesce(f"s{d}", f"c{d}") for d in depths])
    still_open = F.filter(stack, lambda s: s.isNotNull() & (F.col("key") < s["until"]))
    return swept.join(starts, "bucket").select(
        "host", F.flatten(F.transform(still_open, lambda s: s["rules"])).alias("open"),
    ).where(F.size("open") > 0)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; all its columns stay, and the new ones come last.

    Defined cases: a null or unparsable url has empty host and path, no rule and the default verdict; so
    has a host outside all rules. The longest fitting rule wins (host and path together); of two equally
    long ones the longer host, which is the deeper interval. Columns of ``pages`` called host, path, rule
    or verdict are replaced. Repeated rows stay repeated; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    told = pages.withColumns({"host": host, "path": path})
    hosts = told.select("host").distinct()
    found = active_rules(hosts, rules).select(F.col("host").alias("_host"), F.col("open").alias("_open"))
    joined = told.join(found, told["host"] == found["_host"], "left")
    fits = F.filter("_open", lambda r: F.col("path").startswith(r["path"]))
    # open rules stand outermost first, so of equals the last is the deepest
    best = F.reduce(
        fits, F.lit(None).cast("struct<path:string,verdict:string,rule:string>"),
        lambda a, r: F.when(a.isNull() | (F.length(r["rule"]) >= F.length(a["rule"])), r).otherwise(a),
    )
    return joined.withColumn("_best", best).withColumns({
        "rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default)),
    }).drop("_host", "_open", "_best")


def rule_table(spark, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)

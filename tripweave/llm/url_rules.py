"""URL allow and block rules by a sort-merge range join, in DataFrame functions only.

A host's canonical key is its labels in reverse, each followed by a dot: m.example.net is net.example.m. The keys of a
rule's host and of all its subdomains are then the interval from its own key (lo) to that key with the last dot replaced by
the next character, a slash (hi). Such intervals are nested or apart. One sweep over the sorted union of distinct hosts and
interval ends keeps the stack of active intervals: a running sum of opened less closed ones is the stack's height, and
the stack's entry at a level is the last interval that opened there.

The sweep is distributed. Keys are range-partitioned; each range's change of height and last entries per level, one row a
range, give the stack with which the next range starts. Hosts are distinct before the sweep, so a host with a third of all
pages is one row in it; joined back, its pages are a skewed key that adaptive execution can split.

A rule (host, path, verdict) fits a URL of its host or a subdomain whose path starts with the rule's path. The longest host
and path together wins, then the longest host. Without any fit the verdict is the default.

Defined results: a URL that is null or has no :// has an empty host and path and gets the default; so does an empty host.
Repeated pages and null ids are rows like others; other columns are not read. Rules whose host or verdict is null or whose
host is empty are left out; a null path is an empty one, which every path starts with; of equal rules with different
verdicts the alphabetically last (block) counts. An empty rule table gives every page the default. The rules of one host
travel as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripweave.session import write_through

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLOSE, _OPEN, _POINT = 0, 1, 2


def lowered(text: Column) -> Column:
    """A-Z lowered, nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lowered) and path of a URL; both empty without ://."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(tail, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(tail, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(lowered(host), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct host, the array of all rules of hosts that it equals or is a subdomain of.

    hosts has a column host without repeats; rules has host, path and verdict. Returns host and active.
    """
    by_host = (
        rules.select(lowered(F.col("host")).alias("of"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("of != '' AND verdict IS NOT NULL")
        .groupBy("of", "path")
        .agg(F.max("verdict").alias("verdict"))
        .groupBy("of")
        .agg(F.collect_list(F.struct("of", "path", "verdict")).alias("carried"))
        .withColumn("lo", host_key(F.col("of")))
    )
    none = F.lit(None).cast("array<struct<of:string,path:string,verdict:string>>")
    opened = by_host.select(F.col("lo").alias("key"), F.lit(_OPEN).alias("kind"), F.lit(None).cast("string").alias("host"), F.col("carried"))
    closed = by_host.select(F.expr("concat(left(lo, length(lo) - 1), '/')").alias("key"), F.lit(_CLOSE).alias("kind"), F.lit(None).cast("string").alias("host"), none.alias("carried"))
    points = hosts.select(host_key(F.col("host")).alias("key"), F.lit(_POINT).alias("kind"), "host", none.alias("carried"))
    change = F.expr(f"CASE kind WHEN {_OPEN} THEN 1 WHEN {_CLOSE} THEN -1 ELSE 0 END")
    events = opened.unionByName(closed).unionByName(points).withColumn("change", change)
    events = write_through(events.repartitionByRange("key").withColumn("part", F.spark_partition_id()))

    # One row a range from here on: the height at its start, then the stack at its start.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = events.groupBy("part").agg(F.sum("change").alias("change")).select("part", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("height"))
    swept = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    leveled = write_through(
        events.join(F.broadcast(starts), "part").withColumn("level", F.col("height") + F.sum("change").over(swept)).drop("height", "change")
    )
    deepest = leveled.where(F.col("kind") == _OPEN).agg(F.max("level")).first()[0] or 0  # at most the labels of a rule's host
    levels = range(1, deepest + 1)

    def opens(level: int) -> Column:
        return F.when((F.col("kind") == _OPEN) & (F.col("level") == level), F.col("carried"))

    if not deepest:
        return hosts.select("host", F.array().cast("array<struct<of:string,path:string,verdict:string>>").alias("active"))
    ends = leveled.groupBy("part").agg(*[F.max_by(opens(k), F.when(opens(k).isNotNull(), F.col("key"))).alias(f"end{k}") for k in levels])
    carried = ends.select("part", *[F.last(f"end{k}", ignorenulls=True).over(before).alias(f"start{k}") for k in levels])
    stacked = leveled.join(F.broadcast(carried), "part").select(
        "kind", "host", "level", *[F.coalesce(F.last(opens(k), ignorenulls=True).over(swept), f"start{k}").alias(f"at{k}") for k in levels]
    )
    active = F.flatten(F.array_compact(F.array(*[F.when(F.col("level") >= k, F.col(f"at{k}")) for k in levels])))
    return stacked.where(F.col("kind") == _POINT).select("host", active.alias("active"))


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Columns id_col, host, path, rule (host and path of the rule that counts, or null) and verdict."""
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path"))
    hosts = parts.select("host").where("host != ''").distinct()
    active = write_through(active_rules(hosts, rules).where("size(active) > 0"))
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(
        fits,
        lambda r: F.struct(
            (F.length(r["of"]) + F.length(r["path"])).alias("both"), F.length(r["of"]).alias("of"), F.concat(r["of"], r["path"]).alias("rule"), r["verdict"].alias("verdict")
        ),
    )
    best = parts.join(active, "host", "left").withColumn("best", F.array_max(ranked))
    return best.select(
        F.col("page").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )

"""URL filters: a sort-merge range join of urls with rules on reversed hosts, swept with a stack of the rules in force."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
RULE_SCHEMA = "verdict string, host string, path string"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from last to first, each with a dot after it: a host and its subdomains are the keys with one prefix, an interval."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (part, key, rules first): a level of the stack holds the rules of one host key, by path."""
    stack: list[tuple[str, str, dict[str, str], list[int]]] = []
    part = None
    for batch in batches:
        out: dict[str, list] = {"nr": [], "rule": [], "verdict": []}
        for p, key, kind, path, host, verdict, nr in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "kind", "path", "host", "verdict", "nr"))):
            if p != part:
                stack, part = [], p
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, host, {}, []))
                _, _, paths, sizes = stack[-1]
                if path not in paths or verdict == "block":
                    paths[path] = verdict
                if len(path) not in sizes:
                    sizes.append(len(path))
                    sizes.sort(reverse=True)
                continue
            best, of = -1, (None, None)
            for _, over, paths, sizes in reversed(stack):
                for n in sizes:
                    if len(over) + n > best and n <= len(path) and path[:n] in paths:
                        best, of = len(over) + n, (over + path[:n], paths[path[:n]])
                        break
            out["nr"].append(nr)
            out["rule"].append(of[0])
            out["verdict"].append(of[1])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("nr", pa.int64()), ("rule", pa.string()), ("verdict", pa.string())]))


def judged(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``; ``rules`` has verdict, host (lower case) and path.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest (host and path) wins, then the
    longer host, then block. No rule: null and ``default``. A null url, or one without ://, has empty host and path. Rules with a
    null host or path are left out; repeated rows each get a row. Urls and rules are range-partitioned together by (key, path), so
    a hot host spreads over partitions; a partition's first key brings in the rules of its host's ancestors that began before it.
    """
    urls = pages.select(F.col(id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = common.saved(urls.withColumn("nr", F.monotonically_increasing_id()), "urls")
    kept = rules.filter("host is not null and path is not null").select("host", "path", "verdict")
    kept = common.saved(kept.withColumn("key", host_key(F.col("host"))).withColumn("kind", F.lit(0)).withColumn("nr", F.lit(None).cast("long")), "url-rules")
    mine = urls.select("host", "path", F.lit(None).cast("string").alias("verdict"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "nr")
    rows = mine.unionByName(kept).repartitionByRange("key", "kind", "path", "nr").withColumn("part", F.spark_partition_id())
    rows = common.saved(rows, "url-parts")

    labels = F.split(F.col("first"), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))
    firsts = rows.groupBy("part").agg(F.min("key").alias("first")).select("part", F.explode(prefixes).alias("key"))
    swept = (
        rows.unionByName(kept.join(firsts, "key")).repartition("part").sortWithinPartitions("part", "key", "kind", "path")
        .mapInArrow(sweep, "nr long, rule string, verdict string")
    )
    return urls.join(swept, "nr").select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

"""URL filtering by host-suffix and path-prefix expressions, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (action, host, path) of the rules that the registered query applies.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rule tables of up to so many rows are broadcast; beyond, the join shuffles on the short digest.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """Text after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Text from the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules(action, host, path): a rule fits its host and all subdomains of it if the path starts with the rule's; the
    longest fitting rule wins (host and path together; ties: the longer host). Each URL is expanded into the pairs of its
    host suffixes (of as many labels as rules have, at most) and of its path prefixes (of the lengths that rules have); these are joined with the rules on eight
    hex digits of their digest, and whole digests then confirm the match.

    Null, empty and malformed URLs have empty host and path and get `default`. Repeated rows stay; an empty table gives
    an empty result. Columns of pages named host, path, rule or verdict are replaced.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    digest = F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)
    rules = rules.select(F.col("action").alias("r_action"), ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).dropDuplicates(["r_host", "r_path"])
    rules = rules.select("*", digest.alias("r_digest"), F.substring(digest, 1, 8).alias("short"))
    n, lengths, most = rules.agg(F.count("*"), F.sort_array(F.collect_set(F.length("r_path"))), F.max(F.size(F.split("r_host", "\\.")))).first()
    parts = pages.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(c) for c in kept]).alias("__kept"), F.col(url).alias("__url"))
    parts = parts.select("__row", "__kept", host_of(F.col("__url")).alias("__host"), path_of(F.col("__url")).alias("__path"))
    labels = F.length("__host") - F.length(F.replace("__host", F.lit("."), F.lit(""))) + 1
    suffixes = F.transform(F.sequence(F.lit(1), F.least(labels, F.lit(most or 1))), lambda i: F.call_function("substring_index", F.col("__host"), F.lit("."), -i))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths or [0]]), lambda x: x <= F.length("__path")), lambda x: F.substring("__path", 1, x))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\n", h, p), 256))))
    found = parts.select("*", F.explode_outer(pairs).alias("__digest")).withColumn("short", F.substring("__digest", 1, 8))
    found = found.join(F.broadcast(rules) if n <= BROADCAST_RULES else rules, "short", "left")
    fits = F.when(F.col("__digest") == F.col("r_digest"), F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("action")))
    best = found.groupBy("__row").agg(F.first("__kept").alias("k"), F.first("__host").alias("host"), F.first("__path").alias("path"), F.max(fits).alias("b"))
    return best.select(*[F.col("k").getField(c).alias(c) for c in kept], "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.action", F.lit(default)).alias("verdict"))

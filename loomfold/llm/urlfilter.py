"""URL filtering: a blocked Bloom filter of listed canonical URLs, then an exact hash join. DataFrame operations only.

A listed rule is a host and a path prefix. Its canonical form is ``host`` (A-Z lower-cased) followed by the path. A rule
fits its host and all subdomains when the URL's path starts with the rule's path, so a URL can only be hit through the
combinations of host suffix and path prefix whose shape (labels, path length) some rule has. Those combinations are
probed in the filter: each key owns one block of eight 64-bit words and one bit in each word. What passes meets the list
itself in an exact join, which removes the false positives; the longest rule wins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS, BITS_PER_KEY = 8, 12
BROADCAST_BYTES = 32 << 20
#: The rules of the query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def _bits(key: Column) -> list[Column]:
    spread = F.xxhash64(key, F.lit(1))
    return [_bit(spread, i) for i in range(WORDS)]


def _bit(spread: Column, i: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def bloom_blocks(keys: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """The filter as a table: ``block`` and its eight words."""
    k = F.col(key)
    return keys.select(_block(k, blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(k))]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def might_hold(key: Column) -> Column:
    """Whether the joined block has all bits of the key."""
    out = F.lit(True)
    for i, b in enumerate(_bits(key)):
        out = out & (F.col(f"w{i}").bitwiseAND(b) != F.lit(0).cast("long"))
    return out


def canonical_rules(rules: DataFrame) -> DataFrame:
    """``key, rule, verdict, labels, path_len, span, host_len``: one row for each listed host and path; of contradicting rows block wins; rows with a null or an empty host are not rules."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    listed = rules.select(host.alias("host"), F.coalesce(F.col("path"), F.lit("")).alias("path"), "verdict").where("host <> '' and verdict is not null")
    merged = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    key = F.concat("host", "path")
    return merged.select(
        key.alias("key"),
        key.alias("rule"),
        "verdict",
        (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels"),
        F.length("path").alias("path_len"),
        F.length(key).alias("span"),
        F.length("host").alias("host_len"),
    )


def _key(host: Column, path: Column, labels: Column | int, length: Column | int) -> Column:
    """The host's last ``labels`` labels and the path's first ``length`` characters; null if the url has fewer."""
    own = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    labels, length = (F.lit(x) if isinstance(x, int) else x for x in (labels, length))
    parts = F.split(host, r"\.")
    suffix = F.array_join(F.slice(parts, F.greatest(own - labels + 1, F.lit(1)), labels), ".")
    return F.when((host != "") & (own >= labels) & (F.length(path) >= length), F.concat(suffix, F.left(path, length)))


def _in_row(seen: DataFrame, listed: DataFrame, filter_: DataFrame, blocks: int, shapes: list[tuple[int, int]]) -> DataFrame:
    """``best`` beside each row, through broadcast joins of each shape's key with the filter and then with the list: no row is exchanged."""
    out, found = seen, []
    for n, (labels, length) in enumerate(shapes):
        key = _key(F.col("host"), F.col("path"), labels, length)
        out = out.withColumn("key", key).withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(filter_), "block", "left")
        out = out.withColumn("key", F.when(might_hold(F.col("key")), F.col("key"))).drop("block", *[f"w{i}" for i in range(WORDS)])
        own = listed.where((F.col("labels") == labels) & (F.col("path_len") == length)).select("key", F.struct("span", "host_len", "rule", "verdict").alias(f"hit{n}"))
        out = out.join(F.broadcast(own), "key", "left").drop("key")
        found.append(f"hit{n}")
    best = F.greatest(*found) if len(found) > 1 else F.col(found[0])
    return out.withColumn("best", best).drop(*found)


def _by_exchange(seen: DataFrame, listed: DataFrame, filter_: DataFrame, blocks: int, shapes: list[tuple[int, int]]) -> DataFrame:
    """``best`` beside each row for lists of any size: the probes of each url meet the filter and the list in hash joins, and return to the url."""
    every = F.from_json(F.lit(json.dumps([{"m": m, "p": p} for m, p in shapes])), "array<struct<m:int,p:int>>")
    urls = seen.select("url", "host", "path").where("host <> ''").distinct()
    probes = urls.select("url", F.explode(F.array_distinct(F.array_compact(F.transform(every, lambda s: _key(F.col("host"), F.col("path"), s["m"], s["p"]))))).alias("key"))
    possible = probes.withColumn("block", _block(F.col("key"), blocks)).join(filter_, "block").where(might_hold(F.col("key"))).select("url", "key")
    best = possible.join(listed, "key").groupBy("url").agg(F.max(F.struct("span", "host_len", "rule", "verdict")).alias("best"))
    return seen.join(best, "url", "left")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url", most_shapes: int = 16, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` for every row of ``pages``.

    Without a fitting rule the URL isn't listed and gets ``default``. The longest rule (host and path together) wins, of equally
    long ones that with the longer host. Null URLs and URLs without ``://`` have an empty host and path and fit nothing;
    repeated rows keep their number; null ids are kept; an empty list lets all pass; an empty table gives no rows; URLs of
    any length are read whole; further columns are not read.

    A list of at most ``most_shapes`` shapes (labels of the host, length of the path) whose filter and rules stay below
    ``broadcast_bytes`` is broadcast and probed in the row; a longer one is joined by exchanges.
    """
    listed = canonical_rules(rules)
    shapes = sorted((r["labels"], r["path_len"]) for r in listed.select("labels", "path_len").distinct().collect())  # not more than lengths of hosts times paths
    sizes = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(2 * F.col("span") + 100), F.lit(0)).alias("bytes")).first()
    seen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not shapes:
        return seen.select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = max(1, -(-sizes["n"] * BITS_PER_KEY // (64 * WORDS)))
    small = len(shapes) <= most_shapes and len(shapes) * blocks * 8 * (WORDS + 1) + sizes["bytes"] <= broadcast_bytes
    joined = (_in_row if small else _by_exchange)(seen, listed, bloom_blocks(listed, blocks), blocks, shapes)
    return joined.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL against the fixed rules."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in RULES])
    rules = spark.range(1).select(F.inline(rows))
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH rules(verdict, h, p) AS (VALUES ('allow','com','/'),('block','example.com','/en/'),('allow','www.example.com','/en/'),('block','net','/es/'),('block','net','/fr/')),
parts AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, row_number() OVER () AS rid,
  translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fit AS (SELECT rid, h || p AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM seen JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM seen LEFT JOIN (SELECT rid, rule, verdict FROM fit WHERE k = 1) USING (rid)
"""

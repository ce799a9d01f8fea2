"""URL filters: listed canonical addresses behind a blocked Bloom filter, and host-and-path rules.

Rules and listed addresses become keys of one list. A blocked Bloom filter (one 256-bit block per key, one bit
in each of its four words) is a table of blocks; the candidate keys of an address that pass it go to an exact
hash join with the list, which removes false positives. The number of blocks is bounded by a parameter, so the
filter may be broadcast whatever the list's size: a fuller filter only passes more candidates on.

Defined cases: a null url, or one without ``://``, has an empty host and path, and is judged like any other
address. Repeated rows are each returned. A longer rule wins; rules are assumed to be told apart by their key.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BLOCK_BITS, WORDS, BITS_PER_KEY, MOST_BLOCKS = 256, 4, 16, 1 << 18

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(key, rule, verdict) of (verdict, host, path) rules."""
    if not rules:
        return spark.range(0).select(F.lit("").alias("key"), F.lit("").alias("rule"), F.lit("").alias("verdict"))
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")) for v, h, p in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select(
        F.concat(F.lit("rule "), "r.rule").alias("key"), "r.rule", "r.verdict")


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys under which the list may hold an address: itself, and each parent host with each rule-length path start."""
    labels = F.split(host, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.array(F.concat(F.lit("url "), host, path))

    def under(start: Column) -> Column:
        return F.transform(parents, lambda h: F.concat(F.lit("rule "), h, start))

    for n in lengths:
        keys = F.when(F.length(path) >= n, F.concat(keys, under(F.substring(path, 1, n)))).otherwise(keys)
    return keys


def _place(key: Column, blocks: int) -> dict[str, Column]:
    where, bits = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    place = {"block": F.pmod(where, F.lit(blocks))}
    for i in range(WORDS):
        turn = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        place[f"w{i}"] = F.call_function("shiftleft", F.lit(1).cast("long"), turn)
    return place


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w3) of a table with one ``key`` column; at most ``blocks`` rows."""
    place = _place(F.col("key"), blocks)
    return (keys.select(*[c.alias(n) for n, c in place.items()]).groupBy("block")
            .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))


def may_hold(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``candidates`` whose ``key`` may be in the filter."""
    place = _place(F.col("key"), blocks)
    probe = candidates.select("*", *[c.alias(f"_{n}") for n, c in place.items()])
    # at most MOST_BLOCKS rows of 40 bytes
    joined = probe.join(F.broadcast(bloom), F.col("_block") == F.col("block"))
    for i in range(WORDS):
        joined = joined.where(F.col(f"w{i}").bitwiseAND(F.col(f"_w{i}")) != 0)
    return joined.select(*candidates.columns)


def judge_urls(spark: SparkSession, pages: DataFrame, id_column: str, url_column: str, listed: DataFrame,
               rules: list[tuple[str, str, str]], listed_verdict: str = "block", default: str = "allow",
               most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    ``listed`` has one ``url`` column. The longest rule that fits decides; without a rule, a listed address gets
    ``listed_verdict`` and any other ``default``.
    """
    scratch = Scratch(spark, "urls")
    url = F.col(url_column)
    rows = pages.select(F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    entries = listed.select(F.concat(F.lit("url "), host_of(F.col("url")), path_of(F.col("url"))).alias("key")).distinct()
    entries = scratch.keep(entries.select("key", F.lit(None).cast("string").alias("rule"), F.lit(listed_verdict).alias("verdict"))
                           .unionByName(rule_table(spark, rules)), "entries")
    blocks = max(1, min(most_blocks, entries.count() * BITS_PER_KEY // BLOCK_BITS + 1))
    bloom = scratch.keep(bloom_filter(entries, blocks), "bloom")
    lengths = sorted({len(p) for _, _, p in rules})
    addresses = rows.select("host", "path").distinct()
    probes = addresses.select("host", "path", F.explode(F.array_distinct(
        candidate_keys(F.col("host"), F.col("path"), lengths))).alias("key"))
    hits = may_hold(probes, bloom, blocks).join(entries, "key")
    rule_first = F.struct(F.length("rule").alias("size"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    judged = scratch.keep(
        hits.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path"))
        .agg(F.max(F.when(F.col("rule").isNotNull(), rule_first)).alias("best"),
             F.max(F.when(F.col("rule").isNull(), F.col("verdict"))).alias("by_list"))
        .select("_host", "_path", "best.rule", F.coalesce("best.verdict", "by_list").alias("verdict")), "judged")
    # both sides are plain scans, so a hot address is a skewed join that the engine can split
    return (rows.join(judged, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
            .select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Listed: the canonical addresses that occur as campaign links (a ``utm_`` query parameter) anywhere in the table."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    listed = pages.where(F.col("url").rlike(r"[?&]utm_")).select("url")
    return judge_urls(spark, pages, "page_id", "url", listed, RULES).withColumnRenamed("id", "page_id")


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
listed AS (SELECT DISTINCT host, path FROM parts WHERE regexp_matches(url, '[?&]utm_')),
addresses AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM addresses JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT p.page_id, p.host, p.path, b.rule AS rule,
  coalesce(b.verdict, CASE WHEN l.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path LEFT JOIN listed l ON p.host = l.host AND p.path = l.path
"""

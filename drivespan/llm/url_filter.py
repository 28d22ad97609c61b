"""URL filter: a blocked Bloom filter passes possible hits on to an exact join. DataFrame functions only.

The filter is a table of blocks, each four 64-bit words. A URL's hash picks its block, and four more
hashes one bit in each word; a listed URL therefore costs one look into one row. The filter's size is set
by the number of listed URLs, so the probe is a broadcast join while that size is within
MOST_BROADCAST blocks and an ordinary shuffled join beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: 32 bytes a block; 2**17 blocks are 4 MB.
MOST_BROADCAST = 1 << 17
#: Bits of filter for a listed URL.
BITS_PER_URL = 16

#: The rules of the contract, as (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: Words in a host name's first label that mark a page as unwanted; the listed URLs of op4 are the pages on such hosts.
LISTED_HOST_WORDS = ["bet", "bets", "casino", "poker", "pills", "loans", "win", "adult", "xxx"]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., path without .html and trailing slashes; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^(www\.|m\.)", ""), F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), "/+$", ""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, written host/path, and its verdict; nulls if none fits. Of rules equally long the last one counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    return [F.expr(f"shiftleft(1L, cast(pmod(xxhash64({k}, u), 64) as int))") for k in range(1, 5)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3): the filter of the URLs in listed.u. Null URLs are left out."""
    bits = listed.filter("u is not null").select(_block(F.col("u"), blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("u")))))
    return bits.groupBy("block").agg(*(F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(4)))


def listed_hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """urls (u, ...) that are in listed (u), whatever else they hold, each row once: the filter first, then an exact hash join.

    Empty lists give no hits; null URLs never hit; repeated rows in urls stay, repeated listings count once.
    """
    listed = listed.filter("u is not null").select("u").distinct()
    n = listed.count()
    blocks = max(64, 1 << max(0, n * BITS_PER_URL // 256 - 1).bit_length())
    table = bloom_filter(listed, blocks)
    table = F.broadcast(table) if blocks <= MOST_BROADCAST else table
    probe = urls.filter("u is not null").withColumn("__block", _block(F.col("u"), blocks)).join(table.withColumnRenamed("block", "__block"), "__block")
    for i, m in enumerate(_masks(F.col("u"))):
        probe = probe.filter(F.col(f"w{i}").bitwiseAND(m) != 0)
    return probe.select(*urls.columns).join(listed.hint("shuffle_hash"), "u", "left_semi")


def judge(pages: DataFrame, listed: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page.

    A page whose URL fits a rule gets the longest rule's verdict, any other is blocked if its canonical URL
    is listed. listed: (url); by default the URLs of pages on hosts of LISTED_HOST_WORDS. Null URLs have empty
    host and path and are allowed; repeated rows are judged each; other columns are not read.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # a URL without host gets a key of its own that no list holds, so that such pages do not meet in one task
    own = F.concat(F.lit("\0"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    parts = parts.select("*", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))).otherwise(own).alias("u"))
    if listed is None:
        words = "|".join(LISTED_HOST_WORDS)
        names = parts.filter(F.col("host") != "").filter(F.col("host").rlike(rf"(^|[.-])({words})[.-]")).select("u")
    else:
        names = listed.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> ''").select(canonical(F.col("host"), F.col("path")).alias("u"))
    hits = listed_hits(parts.select("u").distinct(), names).select("u", F.lit(True).alias("hit"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.join(hits, "u", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"), F.coalesce("hit", F.lit(False)).alias("listed"))


_ALPHA = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""
WITH p AS (
  SELECT page_id,
    coalesce({_ALPHA.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www\.|m\.)', '') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') END AS u FROM p),
bad AS (SELECT DISTINCT u FROM c WHERE regexp_matches(host, '(^|[.-])({"|".join(LISTED_HOST_WORDS)})[.-]')),
rules(h, r, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
best AS (
  SELECT DISTINCT host, path, arg_max(h || r, length(h || r)) AS rule, arg_max(v, length(h || r)) AS v
  FROM (SELECT DISTINCT host, path FROM c) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r)
  GROUP BY host, path)
SELECT c.page_id, c.host, c.path, best.rule,
  coalesce(best.v, CASE WHEN bad.u IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  bad.u IS NOT NULL AS listed
FROM c LEFT JOIN best ON best.host = c.host AND best.path = c.path LEFT JOIN bad ON bad.u = c.u
"""

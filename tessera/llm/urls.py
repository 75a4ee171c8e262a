"""URL filters: a blocked Bloom filter of listed canonical URLs and rules, then an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules (host, path, verdict) of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: What the registered query's list of canonical URLs is made of, host by host, language by language, page by page.
LISTED_HOSTS = [f"{sub}{name}.example.com" for name in ("ads-track", "casino-win", "free-bets", "spam-farm") for sub in ("", "blog.", "m.", "www.")]
LISTED_LANGUAGES, LISTED_PAGES = ["en", "es"], 12_000
FILTER_BITS_A_KEY, FILTER_BYTES, BROADCAST_BLOCKS, BROADCAST_KEYS = 16, 8 << 10, 250_000, 50_000


def listed_urls(spark: SparkSession, pages: int = LISTED_PAGES) -> DataFrame:
    """(url): the canonical URLs of all pages of the listed hosts, 384,000 with the default."""
    hosts = F.explode(F.array(*map(F.lit, LISTED_HOSTS)))
    languages = F.explode(F.array(*map(F.lit, LISTED_LANGUAGES)))
    return spark.range(0, pages, 1, 4).select("id", hosts.alias("host")).select("id", "host", languages.alias("lang")).select(F.concat("host", F.lit("/"), "lang", F.lit("/"), F.col("id").cast("string")).alias("url"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end. Both empty for null or without ://."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    lower = F.translate(F.regexp_extract(text, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(text, parts, 2)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key), 24), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """Four bits of a 64-bit block."""
    h = F.xxhash64(key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, s).bitwiseAND(F.lit(63)).cast("int")) for s in (0, 6, 12, 18)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def canonical(host: Column, path: Column) -> Column:
    """Host without the ports 80 and 443, path without one trailing slash, percent-escapes in upper case."""
    upper = lambda x, k: F.when((k > 0) & x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.left(x, F.lit(2))), F.substr(x, F.lit(3)))).otherwise(x)
    escaped = F.array_join(F.transform(F.split(path, "%"), upper), "%")
    return F.concat(F.regexp_replace(host, ":(?:80|443)$", ""), F.regexp_replace(escaped, "/$", ""))


def url_verdicts(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each input row: id_col, host, path, rule (null if none fits), verdict.

    rules (host, path, verdict): a rule fits its host and all subdomains if the path starts with the
    rule's; the longest (host and path together, ties to the greater text) wins; of rules with one host
    and path the greater verdict counts (block before allow). listed (url): URLs as canonical() makes
    them; a page that no rule fits is blocked if it is listed and else allowed. Rules and listed URLs are
    keys of one blocked Bloom filter of 64-bit blocks with four bits a key. A page's possible keys are
    made from the pairs of label count and path length that occur among the rules, which are few and
    small; hosts of many labels and long paths cost no more than these. Keys that pass the filter go to a
    hash join on the key, which removes false positives: with the rules, whose keys may be those of a
    third of all rows, and with the list, which has one key an address, each broadcast while it has at
    most 50,000 keys. The filter is sent with the plan while it has at most 8 kB (4,096 keys), broadcast
    while it has at most 250,000 blocks (a million keys; tens of MB as a hash table) and joined by its block number beyond, so
    that up to there no probe is shuffled. Distinct addresses are judged once, so a hot host or URL is aggregated
    before it is joined. Null and empty URLs and those without :// have an empty host and path; null
    rules and URLs of the lists fit nothing, repeated ones count once; rows with equal or null ids are
    judged each; empty tables give no rows; other columns aren't read.
    """
    sep = "\u0000"
    dots = lambda host: F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit("")))
    given = rules.where("host is not null and path is not null").withColumns({"dots": dots(F.col("host")), "path_size": F.char_length("path")})
    keys = given.select(F.concat(F.lit("r"), "host", F.lit(sep), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.char_length(F.concat("host", "path")).alias("size"))
    rule_table = keys.groupBy("key").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"), F.max("size").alias("size"))
    url_table = listed.where("url is not null").select(F.concat(F.lit("u"), "url").alias("key")).distinct()
    n_rules, n_urls = rule_table.count(), url_table.count()
    shapes = [F.struct(F.lit(r["dots"]).alias("dots"), F.lit(r["path_size"]).alias("size")) for r in given.select("dots", "path_size").distinct().collect()]
    n_blocks = max(16, -(-(n_rules + n_urls) * FILTER_BITS_A_KEY // 64))
    every = rule_table.select("key").union(url_table)
    filter_blocks = every.select(_block(F.col("key"), n_blocks).alias("block"), _mask(F.col("key")).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("mask"))
    if n_blocks * 8 <= FILTER_BYTES:
        masks = {r["block"]: r["mask"] for r in filter_blocks.collect()}  # FILTER_BYTES at most
        blocks = F.array(*[F.lit(masks.get(k, 0)).cast("long") for k in range(n_blocks)])
    else:
        blocks = None
        filter_blocks = F.broadcast(filter_blocks) if n_blocks <= BROADCAST_BLOCKS else filter_blocks

    def passing(probes: DataFrame) -> DataFrame:
        placed = probes.withColumn("block", _block(F.col("key"), n_blocks))
        masked = placed.join(filter_blocks, "block") if blocks is None else placed.withColumn("mask", F.element_at(blocks, F.col("block") + 1))
        return masked.where(F.col("mask").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).select("host", "path", "key")

    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    addresses = parsed.select("host", "path").distinct()
    none = F.array().cast("array<struct<dots:int,size:int>>")
    fitting = F.filter(F.array(*shapes) if shapes else none, lambda s: (s["dots"] <= dots(F.col("host"))) & (s["size"] <= F.char_length("path")))
    rule_key = F.concat(F.lit("r"), F.expr("substring_index(host, '.', -(shape.dots + 1))"), F.lit(sep), F.expr("substring(path, 1, shape.size)"))
    by_rule = passing(addresses.select("host", "path", F.explode(fitting).alias("shape")).select("host", "path", rule_key.alias("key")))
    by_url = passing(addresses.select("host", "path", F.concat(F.lit("u"), canonical(F.col("host"), F.col("path"))).alias("key")))
    sent = lambda table, n: F.broadcast(table) if n <= BROADCAST_KEYS else table
    best_rule = by_rule.join(sent(rule_table, n_rules), "key").groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict")).alias("best"))
    on_list = by_url.join(sent(url_table, n_urls), "key", "left_semi").select("host", "path", F.lit("block").alias("listed"))
    judged = parsed.join(best_rule.join(on_list, ["host", "path"], "full"), ["host", "path"], "left")
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "listed", F.lit("allow")).alias("verdict"))

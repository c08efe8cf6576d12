"""Exact URL blocking with a cascade of Bloom filters, in DataFrame operations only.

Level 0 encodes the listed keys. Level 1 encodes the keys of the corpus that are not listed but pass level 0, level 2
the listed keys that pass level 1, and so on until a level lets nothing wrong through. Over the complete key universe of
the corpus the first level that rejects a key then decides exactly: odd levels mean listed. The levels are bit arrays
made by grouped bit_or and read through scalar subqueries, so pages are judged by an expression without a join.
The bits grow with the list, not with the corpus. A list that needs more than MAX_BITS is split by a hash of the key
into parts with a cascade each; pages are then read once for each part, and a task holds the bits of one part only.

Null urls, and those without "://", have an empty host and path, fit no rule and are allowed. Null keys in the list are
ignored, repeated ones count once. Repeated pages give a row each. Of rules that fit, the longest wins; two rules of one
length that fit the same url would be equal. Urls may have any length: only their hosts are hashed. Other columns of
pages are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

BITS_PER_KEY, PROBES, MAX_BITS, MAX_LEVELS = 10, 5, 1 << 27, 40
#: (host, path, verdict) of the rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The default blocklist: these labels under these prefixes and domains.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_PREFIXES, LISTED_DOMAINS = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def default_blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{p}{label}.{d}",) for label in LISTED_LABELS for p in LISTED_PREFIXES for d in LISTED_DOMAINS], "key string")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(PROBES)]


class Level:
    """One Bloom filter of the cascade: keys (key) checkpointed, count known."""

    def __init__(self, keys: DataFrame, count: int, number: int):
        self.number = number
        self.bits = max(64, 1 << (max(1, count * BITS_PER_KEY) - 1).bit_length())
        spark = keys.sparkSession
        at = keys.select(F.explode(F.array(*positions(F.col("key"), number, self.bits))).alias("p"))
        words = at.select((F.col("p") / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int")).alias("v"))
        every = spark.range(0, self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("v"))
        dense = every.unionAll(words).groupBy("word").agg(F.bit_or("v").alias("v"))
        self.array = checkpointed(dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "v"))), lambda x: x["v"]).alias("bits")))

    def has(self, key: Column) -> Column:
        bits, out = self.array.scalar(), F.lit(True)
        for p in positions(key, self.number, self.bits):
            word = F.get(bits, (p / 64).cast("int"))
            out = out & (F.call_function("shiftright", word, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


def levels(listed: DataFrame, count: int, universe: DataFrame) -> list[Level]:
    """The levels of one cascade for count distinct listed keys over a universe of distinct keys; none for an empty list."""
    out: list[Level] = []
    if not count:
        return out
    encode, other = listed, checkpointed(universe.join(F.broadcast(listed) if count <= 50_000 else listed, "key", "left_anti"))
    while count:
        if len(out) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        level = Level(encode, count, len(out))
        out.append(level)
        wrong = checkpointed(other.where(level.has(F.col("key"))))
        encode, other, count = wrong, encode, wrong.count()
    return out


def contains(cascade: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(cascade) % 2 == 1)
    for level in reversed(cascade):
        out = F.when(level.has(key), out).otherwise(F.lit(level.number % 2 == 1))
    return out


class Cascade:
    """Exact membership of listed keys over a universe of keys, in as many parts as keep each below MAX_BITS."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        """listed, universe: DataFrames of one column key; nulls and repeats are dropped."""
        listed = checkpointed(listed.where("key IS NOT NULL").distinct())
        universe, bits = universe.where("key IS NOT NULL").distinct(), listed.count() * BITS_PER_KEY
        if bits <= MAX_BITS:
            self.parts = [levels(listed, bits // BITS_PER_KEY, universe)]
            return
        self.parts, universe = [None] * -(-2 * bits // MAX_BITS), checkpointed(universe)  # parts half full, as hashing deals unevenly
        for i in range(len(self.parts)):
            mine = listed.where(self.part(F.col("key")) == i)
            self.parts[i] = levels(mine, mine.count(), universe.where(self.part(F.col("key")) == i))

    def part(self, key: Column) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(F.lit(-1), key), F.lit(len(self.parts))), F.lit(0))

    def mark(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """df with a boolean column that says whether its key is listed; a null key is not."""
        hit = lambda rows, cascade: rows.withColumn(out, F.col(key).isNotNull() & contains(cascade, F.col(key)))
        if len(self.parts) == 1:
            return hit(df, self.parts[0])
        return reduce(DataFrame.unionAll, [hit(df.where(self.part(F.col(key)) == i), cascade) for i, cascade in enumerate(self.parts)])


def fitting_rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, blocklist: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    cascade = Cascade(blocklist, parts.select(F.col("host").alias("key")))
    marked = cascade.mark(parts, "host", "listed").withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return marked.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


_LISTED = ", ".join(f"'{p}{label}.{d}'" for label in LISTED_LABELS for p in LISTED_PREFIXES for d in LISTED_DOMAINS)
_FITS = {h + p: (f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))", v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))}
ORACLE = f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE {" ".join(f"WHEN {f} THEN '{r}'" for r, (f, _) in _FITS.items())} END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, (_, v) in _FITS.items())} WHEN host IN ({_LISTED}) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

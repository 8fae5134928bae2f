"""Verdicts on urls: rules by host and path first, then a list of urls behind a blocked Bloom filter.

The filter has blocks of eight 64-bit words; a listed url sets one bit of each word of its block. Pages look their block up
in a copied table of at most MOST_BLOCKS rows; what has all eight bits goes on to an exact join with the list, which removes
false positives. So only the listed urls and one in about a thousand others are shuffled. Longer lists than the
filter has room for raise the share of false positives and change no verdict.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the block (one bit in each of WORDS words), of the whole filter (64 MiB), and how much of it a listed url gets.
WORDS, MOST_BLOCKS, BITS_PER_URL, SEED = 8, 1 << 20, 16, 20240613
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LISTED_EVERY = 20
#: Query parameters that say where a reader came from.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
PARTS, HOST, TAIL = "://([^/?#]*)([^?#]*)", r"(?s)^(?:[^@]*@)?(?:www\.)?(.*?)(?::(?:80|443))?\z", r"/+(?:index\.html?)?\z"


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """The form that spellings of one address share, null where there is no host.

    Scheme, user, `www.`, the usual ports, fragment, tracking parameters, a closing slash and a closing
    index page go; the other parameters are sorted.
    """
    host = F.regexp_replace(host_of(url), HOST, "$1")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), TAIL, ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(the rule that decides, written host and path together; its verdict), null where none fits.

    A rule fits its host and all subdomains, where the path starts with its path. The longest wins, of equally long ones that of the longer host, and then the first given.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    out = []
    for value in (lambda r: r[0] + r[1], lambda r: r[2]):
        fits = [F.when(((host == r[0]) | host.endswith(f".{r[0]}")) & path.startswith(r[1]), F.lit(value(r))) for r in ranked]
        out.append(F.coalesce(*fits) if fits else F.lit(None).cast("string"))
    return out[0], out[1]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(SEED)), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    """The bit of each word: six bits of a second hash for each."""
    bits = F.xxhash64(F.lit(SEED), url)
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def blocked_bloom(urls: DataFrame, column: str, blocks: int) -> DataFrame:
    """block and its words for the urls of a column; made where the urls are, a row for each block and task is shuffled."""
    words = [F.bit_or(mask).alias(f"word{i}") for i, mask in enumerate(_masks(F.col(column)))]
    return urls.groupBy(_block(F.col(column), blocks).alias("block")).agg(*words)


def blocks_for(n: int, bits_per_url: int = BITS_PER_URL, most: int = MOST_BLOCKS) -> int:
    return min(most, max(1, math.ceil(n * bits_per_url / (64 * WORDS))))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, bits_per_url: int = BITS_PER_URL, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """host, path, rule and verdict (allow or block) for every row of pages (page_id, url): its rule's, else block for a listed url, else allow.

    listed has a column url; urls are compared in canonical form. A null or empty url and one without `://` have an
    empty host and path, fit no rule and are never listed, so they are allowed; nulls in the list do nothing. Repeated rows are judged each.
    Urls of any length are read whole; other columns are ignored; no pages give no rows, an empty list blocks nothing.
    A url that very many pages share makes one large key of the exact join, which Spark splits (skew join): the list has it once.
    """
    known = materialise(listed.select(canonical(F.col("url").cast("string")).alias("canonical")).filter("canonical is not null").distinct())
    blocks = blocks_for(known.count(), bits_per_url, most_blocks)
    bloom = F.broadcast(blocked_bloom(known, "canonical", blocks))  # at most most_blocks rows of nine numbers

    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), *(c.alias(n) for c, n in zip(rule_of(host, path, rules), ("rule", "ruled"))), canonical(url).alias("canonical"))
    rows = rows.withColumn("block", F.when(F.col("ruled").isNull(), _block(F.col("canonical"), blocks))).join(bloom, "block", "left")
    possible = F.coalesce(reduce(Column.__and__, (F.col(f"word{i}").bitwiseAND(mask) != 0 for i, mask in enumerate(_masks(F.col("canonical"))))), F.lit(False))
    rows = rows.withColumn("possible", possible)
    out = ["page_id", "host", "path", "rule"]
    decided = rows.filter("not possible").select(*out, F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    exact = rows.filter("possible").select(*out, "canonical").join(known.withColumn("listed", F.lit(True)), "canonical", "left")
    return decided.unionByName(exact.select(*out, F.when(F.col("listed"), "block").otherwise("allow").alias("verdict")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, judged by the rules and by the list of all pages whose page_id is divisible by 20."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, pages.filter(F.col("page_id") % LISTED_EVERY == 0).select("url"))


def _case(value: int) -> str:
    ranked = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    return "CASE " + " ".join(f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{r[2] if value else r[0] + r[1]}'" for r in ranked) + " END"


ORACLE_SQL = rf"""
WITH parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path, regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1) AS query FROM pages),
cut AS (SELECT *, regexp_replace(host, '{HOST}', '\1') AS h, regexp_replace(path, '{TAIL}', '') AS p, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&') AS q FROM parts),
named AS (SELECT *, CASE WHEN h <> '' THEN h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM cut),
listed AS (SELECT DISTINCT canonical FROM named WHERE page_id % {LISTED_EVERY} = 0 AND canonical IS NOT NULL)
SELECT page_id, host, path, {_case(0)} AS rule, coalesce({_case(1)}, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN listed ON named.canonical = listed.canonical"""

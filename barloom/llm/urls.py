"""URL filters (operator 8): a blocked Bloom filter of listed URLs, then an exact hash join.

A list holds rules (host, path, verdict); a rule fits its host and all subdomains where the URL's path starts with the
rule's path. Each URL gives candidate keys, one for every host suffix and every length that some listed path has. The
Bloom filter (256-bit blocks, one bit in each of four 64-bit words) is itself a table of at most ``blocks`` rows, so its
broadcast has a fixed bound and grows with the list below it; keys that pass go to an exact join with the list, which removes
false positives. The longest rule (host and path together, then the longer host) decides; URLs without one get
``default``.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule; repeated URLs are judged once
and joined back; URLs of any length are read whole; an empty list leaves every URL with ``default``, an empty table of pages
gives no rows; where rules repeat, ``block`` wins over ``allow``; columns host, path, rule and verdict of the input are
replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the registered query's list: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 4
#: A block of 256 bits for so many rules passes about one in a thousand others; and the most blocks, of 36 bytes.
RULES_A_BLOCK, MOST_BLOCKS = 8, 1 << 20


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _bits(key: Column) -> list[Column]:
    """One bit of each of a block's words, from six hash bits each."""
    h = F.xxhash64(key, F.lit(2))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i + 1).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter of the column ``key``: (block, w0..w3), at most ``blocks`` rows."""
    return (
        keys.select(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", blocks: int | None = None) -> DataFrame:
    """``urls`` with host, path, rule (null where none fits) and verdict.

    ``rules`` has host, path, verdict. The filter has ``blocks``, or else one for every ``RULES_A_BLOCK`` rules and
    ``MOST_BLOCKS`` at most: 36 bytes each bound the broadcast; of a longer list it only lets more pass to the join.
    """
    rules = rules.select("host", "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    blocks = blocks or max(64, min(MOST_BLOCKS, rules.count() // RULES_A_BLOCK))
    listed = rules.withColumn("key", _key(F.col("host"), F.col("path")))
    bloom = bloom_filter(listed.select("key"), blocks)
    lengths = listed.agg(F.collect_set(F.length("path")).alias("lengths"))  # one row; at most as long as a URL
    parts = urls.select(F.col(url).alias("_url")).where(F.locate("://", F.col(url)) > 0).distinct()
    parts = parts.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    candidates = (
        parts.crossJoin(F.broadcast(lengths))
        .select("_url", "path", "lengths", F.explode(suffixes).alias("suffix"))
        .select("_url", "path", "suffix", F.explode("lengths").alias("n"))
        .where(F.length("path") >= F.col("n"))
        .select("_url", _key(F.col("suffix"), F.substring("path", F.lit(1), F.col("n"))).alias("key"))
    )
    candidates = candidates.withColumns({"block": F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int"), **{f"b{i}": b for i, b in enumerate(_bits(F.col("key")))}})
    passed = candidates.join(F.broadcast(bloom), "block").where(" AND ".join(f"w{i} & b{i} = b{i}" for i in range(WORDS))).select("_url", "key")
    hits = passed.join(listed, "key").groupBy("_url").agg(
        F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct(F.length("host") + F.length("path"), F.length("host"))).alias("best")
    )
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return urls.select(*keep).join(hits, F.col(url) == F.col("_url"), "left").select(
        *keep,
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def page_verdicts(pages: DataFrame) -> DataFrame:
    """The query: page_id, host, path, rule, verdict of every page."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_CASES = "\n".join(
    f"    WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{}}" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
)
ORACLE = f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path,
  CASE
{_CASES.format(*[f"'{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))])}
    ELSE NULL END AS rule,
  CASE
{_CASES.format(*[f"'{v}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))])}
    ELSE 'allow' END AS verdict
FROM parts
"""

"""URL verdicts: prefix rules first, then a blocked Bloom filter of listed URLs in front of an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.shared import fresh, small_side

#: (verdict, host, path prefix); a rule fits its host and all subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words of host names whose URLs the registered query lists. Fixed values.
LISTED_WORDS = ("cheap", "pills", "casino", "betting", "lottery", "jackpot", "viagra", "loan", "free", "win", "xxx")
#: 64-bit words in a block, and filter bits for each listed URL.
WORDS, BITS_EACH = 4, 16


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for a null or without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without `www.` or `m.`, path without trailing slashes, query parameters sorted and without tracking ones."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), F.rtrim(path_of(url), F.lit("/")), tail)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Longest: host and path together, then the host."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def _place(url: Column, blocks: int) -> dict[str, Column]:
    """The block of a URL, and in each of its words the one bit that the URL sets."""
    bits = {f"w{i}": F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(url, F.lit(i + 1)), F.lit(64)).cast("int")) for i in range(WORDS)}
    return {"block": F.pmod(F.xxhash64(url), F.lit(blocks)), **bits}


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """listed(listed_url) -> (block, f0..f3): each block is `WORDS` 64-bit words, one bit of each set by a URL."""
    bits = listed.withColumns(_place(F.col("listed_url"), blocks))
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"f{i}") for i in range(WORDS)])


def possible(asked: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """asked(listed_url) -> those whose bits are all set: every listed one, and a few others."""
    passed = asked.withColumns(_place(F.col("listed_url"), blocks)).join(bloom, "block")
    return passed.where(" AND ".join(f"(w{i} & f{i}) = w{i}" for i in range(WORDS))).select("listed_url")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """`pages` with host, path, rule and verdict: the longest fitting rule's, else block if the URL is listed, else allow.

    listed(url): URLs of any spelling; they and the pages' are compared in canonical form. Only pages that no rule
    fits and whose bits are all set in the filter reach the exact join, which removes false positives. Null and
    malformed URLs have an empty host and path and are never listed. Repeated pages and listed URLs do no harm, and
    without pages or listed URLs there is nothing to block. Columns of `pages` named host, path, rule or verdict are replaced.
    """
    listed = listed.select(canonical_url(F.col("url")).alias("listed_url"), host_of(F.col("url")).alias("h")).where("h <> ''").select("listed_url").distinct()
    blocks = max(1, listed.count() * BITS_EACH // (64 * WORDS))
    bloom = small_side(bloom_blocks(listed, blocks))
    own, key, hit = fresh(pages, "own_rule"), fresh(pages, "url_key"), fresh(pages, "listed_key")
    seen = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    seen = seen.withColumn(own, rule_of(F.col("host"), F.col("path"), rules))
    seen = seen.withColumn(key, F.when(F.col(own).isNull() & (F.col("host") != ""), canonical_url(F.col(url_col))))
    asked = seen.select(F.col(key).alias("listed_url")).where("listed_url IS NOT NULL").distinct()
    blocked = possible(asked, bloom, blocks).join(small_side(listed), "listed_url", "left_semi")
    out = seen.join(small_side(blocked).withColumnRenamed("listed_url", hit), F.col(key) == F.col(hit), "left")
    verdict = F.coalesce(F.col(own)["verdict"], F.when(F.col(hit).isNotNull(), "block").otherwise("allow"))
    return out.withColumns({"rule": F.col(own)["rule"], "verdict": verdict}).drop(own, key, hit)


def listed_from(pages: DataFrame) -> DataFrame:
    """The query's list. URLs of `pages` whose host has one of LISTED_WORDS as a part between dots and hyphens, and as many
    that no page has: for each tenth page by a hash, a sibling of its URL. Those fill the filter with bits of other hosts,
    so that pages pass it which the exact join has to remove.
    """
    urls = pages.select("url").where("url IS NOT NULL")
    spam = urls.where(host_of(F.col("url")).rlike(f"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)"))
    absent = urls.where(F.pmod(F.xxhash64("url"), F.lit(10)) == 0).select(F.concat(F.lit("http://"), host_of(F.col("url")), path_of(F.col("url")), F.lit("~withdrawn")).alias("url"))
    return spam.union(absent)

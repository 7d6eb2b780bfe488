"""URL filter: host and path rules, then a blocked Bloom filter of listed canonical URLs before an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.tables import written

#: Bits of filter for each listed URL, and the largest filter that is broadcast; a longer list is probed part by part.
BITS_PER_URL, MOST_FILTER_BYTES = 16, 16 << 20
#: The eight odd multipliers of the split-block Bloom filter in the public Parquet format.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest (verdict, host, path) rule that fits, as host + path, and its verdict; null if none fits."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found, verdict = F.when(fits, F.lit(h + p)).otherwise(found), F.when(fits, F.lit(what)).otherwise(verdict)
    return found, verdict


def canonical(host: Column, path: Column) -> Column:
    """host/path without a port, a leading www., repeated slashes or a slash at the end of the path."""
    bare = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^www\.", "")
    return F.concat(bare, F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/"), "(.)/$", "$1"))


def keys_of(url: Column) -> Column:
    """The canonical URL and the root of its host and of each parent domain of two labels or more."""
    host = F.substring_index(url, "/", 1)
    labels = F.split(host, r"\.")
    roots = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    return F.array_distinct(F.concat(F.array(url), roots))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 32), F.lit(blocks)).cast("int")


def _bit(key: Column, salt: int) -> Column:
    """Which of 32 bits the key sets in the word of this salt."""
    return F.shiftright((F.xxhash64(key).bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(salt)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")


def bloom_words(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row: the filter's words as array<long>, block after block, eight words of 32 bits each."""
    one = F.lit(1).cast("long")
    bits = listed.select(_block(F.col(key), blocks).alias("block"), *(F.call_function("shiftleft", one, _bit(F.col(key), s)).alias(f"w{i}") for i, s in enumerate(SALTS)))
    empty = listed.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), *(F.lit(0).cast("long").alias(f"w{i}") for i in range(8)))
    used = bits.unionByName(empty).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)))
    # every block is there, so in their order a probe finds its words by position
    packed = used.agg(F.array_sort(F.collect_list(F.struct("block", F.array(*(f"w{i}" for i in range(8))).alias("own")))).alias("all"))
    return packed.select(F.flatten(F.transform("all", lambda b: b["own"])).alias("words"))


def may_hold(words: Column, key: Column, blocks: int) -> Column:
    """False only if the filter surely lacks the key."""
    at = _block(key, blocks) * 8
    hit = F.lit(True)
    for i, salt in enumerate(SALTS):
        hit = hit & (F.call_function("shiftrightunsigned", F.get(words, at + i), _bit(key, salt)).bitwiseAND(F.lit(1)) == 1)
    return hit


def possible(judged: DataFrame, entries: DataFrame, blocks: int, part: int, parts: int) -> DataFrame:
    """judged with hits: the keys of each row that this part of the list may hold, by the part's filter."""
    own = entries.where(_part(F.col("entry"), parts) == part) if parts > 1 else entries
    words = bloom_words(own, "entry", blocks).scalar()
    keys = F.when(F.col("rule").isNull() & (F.col("host") != ""), keys_of(canonical(F.col("host"), F.col("path")))).otherwise(F.array().cast("array<string>"))
    if parts > 1:
        keys = F.filter(keys, lambda k: _part(k, parts) == part)
    return judged.withColumn("words", words).withColumn("hits", F.filter(keys, lambda k: may_hold(F.col("words"), k, blocks))).drop("words")


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(parts))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", listed_url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Host, path, rule and verdict (allow or block) of every row's URL.

    A rule decides where one fits. Elsewhere a row is blocked if its canonical URL, or the root of its host or of a
    parent domain, is in listed. The Bloom filter lets through what may be listed; the exact join removes its false
    positives, and no listed URL is missed. Null URLs and those without :// have an empty host and path and are
    allowed; so are all that no rule fits if listed is empty. Null or repeated list entries change nothing. Repeated
    rows are judged one by one; other columns of pages than keep are dropped. A filter has at most MOST_FILTER_BYTES; a
    longer list is dealt into parts, each with a filter of its own, and the rows are probed part by part. rules are few:
    each is a branch of the plan.
    """
    h, p = host_of(F.col(url)), path_of(F.col(url))
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    parts = pages.select(*kept, h.alias("host"), p.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.select("*", rule.alias("rule"), verdict.alias("verdict"))
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    told = lambda blocked: F.when(blocked, "block").otherwise(F.coalesce("verdict", F.lit("allow"))).alias("verdict")
    found = F.regexp_extract(F.col(listed_url), SPLIT, 0)
    plain = F.when(F.length(found) > 0, canonical(host_of(F.col(listed_url)), path_of(F.col(listed_url))))
    entries = written(listed.select(plain.alias("entry")).where("entry is not null and entry not like '/%'").distinct(), "listed")
    n = entries.count()
    if not n:
        return judged.select(*names, "host", "path", "rule", told(F.lit(False)))
    split = max(1, -(-n * BITS_PER_URL // (8 * MOST_FILTER_BYTES)))
    blocks = max(1, -(-n * BITS_PER_URL // (256 * split)))

    def sure(rows: DataFrame, by: list[str]) -> DataFrame:
        """(by, n): how many listed keys each of these rows has; distinct keys meet the list first, so no key is hot there."""
        keys = rows.select(F.explode("hits").alias("entry")).distinct()
        real = written(keys.join(entries, "entry", "left_semi").withColumn("is_listed", F.lit(True)), "sure")
        return rows.select(*by, F.explode("hits").alias("entry")).join(real, "entry", "left").groupBy("row").agg(*(F.first(c).alias(c) for c in by[1:]), F.count("is_listed").alias("n"))

    if split == 1:
        marked = possible(judged, entries, blocks, 0, 1)
        clear = marked.where(F.size("hits") == 0).select(*names, "host", "path", "rule", told(F.lit(False)))
        hit = marked.withColumn("row", F.monotonically_increasing_id()).where(F.size("hits") > 0)
        met = sure(hit, ["row", *(f"k{i}" for i in range(len(keep))), "host", "path", "rule", "verdict"])
        return clear.unionByName(met.select(*names, "host", "path", "rule", told(F.col("n") > 0)))
    judged = written(judged.withColumn("row", F.monotonically_increasing_id()), "judged")
    blocked = None
    for part in range(split):
        hits = possible(judged, entries, blocks, part, split).select("row", F.explode("hits").alias("entry"))
        own = written(hits.join(entries, "entry", "left_semi").select("row").distinct(), "blocked")
        blocked = own if blocked is None else blocked.unionByName(own)
    marks = blocked.distinct().withColumn("is_listed", F.lit(True))
    return judged.join(marks, "row", "left").select(*names, "host", "path", "rule", told(F.col("is_listed").isNotNull()))

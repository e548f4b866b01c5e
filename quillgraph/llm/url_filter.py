"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed rule is a (host, path, verdict). It fits a url whose host is the rule's host
or a subdomain of it, if the url's path starts with the rule's path; of several the
longest wins. The canonical form of a rule is host + path (``example.com/en/``).

For each url, the candidate keys are its host's trailing labels joined with the
starts of its path, for the label counts and path lengths that occur in the list.
Each key probes one block of the Bloom filter. Only keys that pass go on to the exact
join with the rules, which removes the false positives.

Everything runs on DataFrame functions. The filter and the rules are broadcast only
where their counted size is under ``broadcast_rows``; beyond that both steps are
shuffled joins whose large side has rows for possible hits only.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits
no rule; an empty rule list gives the default verdict everywhere; repeated rows and
ids are judged one by one; rules listed twice count once (of two verdicts for one key,
"allow" wins); columns other than the id and the url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_az

#: Bits of a block (eight longs) and bits set in it for a key.
BLOCK_WORDS, PROBES = 8, 6
BITS_A_KEY = 16


def host_of(url: Column) -> Column:
    return F.coalesce(lower_az(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule DataFrame (host, path, verdict) from (verdict, host, path) tuples."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in rules]
    empty = F.array().cast("array<struct<host:string,path:string,verdict:string>>")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def block_count(n_keys: int) -> int:
    return max(1, -(-n_keys * BITS_A_KEY // (64 * BLOCK_WORDS)))


def block_of(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n_blocks).cast("bigint"))


def bits_of(key: Column) -> list[Column]:
    """The PROBES bit positions of a key within its block."""
    h = F.xxhash64(key, F.lit(2))
    return [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(64 * BLOCK_WORDS - 1)).cast("int") for i in range(PROBES)]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter of a ``key`` column: a row (block, words array<bigint>) for each block that has a bit set."""
    bits = keys.select(block_of(F.col("key"), n_blocks).alias("block"), F.explode(F.array(*bits_of(F.col("key")))).alias("bit"))
    words = [F.bit_or(F.when(F.shiftright(F.col("bit"), 6) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("bigint"))) for w in range(BLOCK_WORDS)]
    return bits.groupBy("block").agg(F.array(*words).alias("words"))


def passes(words: Column, key: Column) -> Column:
    """True if every bit of the key is set in the words of its block."""
    hits = [F.call_function("shiftrightunsigned", F.element_at(words, F.shiftright(b, 6) + 1), b.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint")) == 1 for b in bits_of(key)]
    out = hits[0]
    for hit in hits[1:]:
        out = out & hit
    return out


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The keys under which a listed rule for this url would stand."""
    n_labels = F.when(host == "", F.lit(0)).otherwise(F.size(F.split(host, r"\.", -1)))
    keys = [F.when((n_labels >= k) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -k), F.lit("\0"), F.substring(path, 1, m))) for k in labels for m in lengths]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rows: int = 200_000) -> DataFrame:
    """Returns the id column, host, path, rule and verdict for every row of ``urls``.

    rules: host, path, verdict; one row per rule, of any number.
    """
    shape = rules.select("host", "path").where("host is not null and path is not null")
    shape = shape.groupBy(F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("length")).count().collect()  # a row for each shape of rule
    n_rules = sum(r["count"] for r in shape)
    labels, lengths = sorted({r["labels"] for r in shape}), sorted({r["length"] for r in shape})
    n_blocks = block_count(n_rules)
    listed = (
        rules.where("host is not null and path is not null")
        .groupBy(F.concat("host", F.lit("\0"), "path").alias("key"))
        .agg(F.min("verdict").alias("verdict"), F.min(F.concat("host", "path")).alias("rule"))
    )
    blocks = bloom_blocks(listed.select("key"), n_blocks)
    if n_rules <= broadcast_rows:  # counted above; a filter has no more blocks than keys
        listed, blocks = F.broadcast(listed), F.broadcast(blocks)

    parts = urls.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not n_rules:
        return parts.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # A verdict belongs to (host, path): each distinct pair is probed once, however often a url repeats.
    probes = (
        parts.where("host <> ''").select("host", "path").distinct()
        .select("host", "path", F.explode(candidate_keys(F.col("host"), F.col("path"), labels, lengths)).alias("key"))
        .withColumn("block", block_of(F.col("key"), n_blocks))
    )
    possible = probes.join(blocks, "block").where(passes(F.col("words"), F.col("key"))).select("host", "path", "key")
    best = (
        possible.join(listed, "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict"))).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    # Rows without a host take no part in the join, so that they don't meet under one key.
    with_host = parts.where("host <> ''").join(best, ["host", "path"], "left").select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    without = parts.where("host = ''").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return with_host.unionByName(without).withColumnRenamed("id", id_col)

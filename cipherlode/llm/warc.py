"""Merkle fixity audit of WARC replicas: trees over ordered offset ranges, compared from the root down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from cipherlode.llm.text import settle

#: Keys in one WARC file, and children of one tree node.
SLOTS, FAN = 1024, 16
#: The file of records whose key is null.
NO_FILE = -(2**53)


def record(key: Column, url: Column, body: Column) -> Column:
    """The bytes of one response record."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """(file, node, key, byte_offset, n_bytes, hash) by key of records (key, record).

    A key's records, however many, sum into one multiset hash; so copies pre-aggregate
    before the shuffle and a file's window holds SLOTS rows at most.
    """
    sha = F.sha2("record", 256)
    parts = [F.sum(F.conv(F.substring(sha, 16 * k + 1, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]
    file = F.coalesce(F.floor(F.col("key") / SLOTS), F.lit(NO_FILE)).cast("long")
    records = records.withColumn("key", F.col("key").try_cast("bigint"))
    by_key = records.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("record").cast("long")).alias("n_bytes"), *parts)
    slots = by_key.select(file.alias("file"), (F.coalesce("key", F.lit(0)) - F.floor(F.coalesce("key", F.lit(0)) / SLOTS) * SLOTS).cast("long").alias("node"), "key", "n_bytes", F.sha2(F.concat_ws("|", "n", "s0", "s1", "s2", "s3"), 256).alias("hash"))
    before = W.Window.partitionBy("file").orderBy("node").rowsBetween(W.Window.unboundedPreceding, -1)
    return slots.withColumn("byte_offset", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).cast("long"))


def _parents(level: DataFrame, over_files: bool) -> DataFrame:
    """The next level: FAN neighbours, in order, hashed into one node. Within files first, then over files."""
    up = F.floor(F.col("file" if over_files else "node") / FAN).cast("long")
    keys = [up.alias("file"), F.lit(0).cast("long").alias("node")] if over_files else [F.col("file"), up.alias("node")]
    return level.groupBy(*keys).agg(F.sha2(F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct("file", "node", "hash"))), lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["file"].cast("string"), F.lit(":"), c["hash"]))), 256).alias("hash"))


def tree(leaf: DataFrame) -> list[tuple[DataFrame, bool]]:
    """Levels from the leaves to one root, each with whether its children are other files' nodes. Each level, FAN times smaller than the last, is stored."""
    levels = [(leaf.select("file", "node", "hash"), False)]
    width = SLOTS
    while width > 1:
        levels.append((settle(_parents(levels[-1][0], False)), False))
        width = -(-width // FAN)
    span = leaf.agg(F.min("file"), F.max("file")).first()
    low, high = span[0] or 0, span[1] or 0
    while low != high:
        levels.append((settle(_parents(levels[-1][0], True)), True))
        low, high = low // FAN, high // FAN
        if (low, high) == (-1, 0):  # rows on both sides of zero never share a parent: the driver's two roots are compared
            break
    return levels


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """(key, status, file_no, byte_offset, n_bytes) of records that differ, from (key, record) of two replicas.

    status: changed, missing (in the replica) or extra (only there); the place is
    the original's, for extra records the replica's. Roots are compared first and
    only children of mismatching nodes are joined further down. Repeated keys are
    one leaf; null keys, and text that is no number, have a leaf in a file of their own; equal or empty replicas give no rows.
    """
    left, right = settle(leaves(original)), settle(leaves(replica))
    ours, theirs = tree(left), tree(right)
    tall = max(ours, theirs, key=len)
    for levels in (ours, theirs):
        while len(levels) < len(tall):
            levels.append((settle(_parents(levels[-1][0], True)), True))
    spoiled: DataFrame | None = None
    for k in range(len(ours) - 1, -1, -1):
        a, b = (levels[k][0].select("file", "node", F.col("hash").alias(h)) for levels, h in ((ours, "a"), (theirs, "b")))
        if spoiled is not None:
            over = ours[k + 1][1]
            near = [F.floor(F.col("file") / FAN).cast("long").alias("up_file") if over else F.col("file").alias("up_file"), (F.lit(0) if over else F.floor(F.col("node") / FAN)).cast("long").alias("up_node")]
            a, b = (x.select("*", *near).join(spoiled, ["up_file", "up_node"], "left_semi").drop("up_file", "up_node") for x in (a, b))
        spoiled = settle(a.join(b, ["file", "node"], "full").where("NOT a <=> b").select(F.col("file").alias("up_file"), F.col("node").alias("up_node")))
    both = spoiled.select(F.col("up_file").alias("file"), F.col("up_node").alias("node"))
    mine = both.join(left, ["file", "node"], "left").select("file", "node", F.struct("key", "byte_offset", "n_bytes").alias("l"), F.col("hash").alias("a"))
    found = mine.join(right.select("file", "node", F.struct("key", "byte_offset", "n_bytes").alias("r"), F.col("hash").alias("b")), ["file", "node"], "left")
    at = F.when(F.col("a").isNull(), F.col("r")).otherwise(F.col("l"))
    status = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("changed")
    return found.select(at["key"].alias("key"), status.alias("status"), F.col("file").alias("file_no"), at["byte_offset"].alias("byte_offset"), at["n_bytes"].alias("n_bytes"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all pages against a replica with planted damage: of page ids, every 101st (from 7) has a changed byte and every 211th (from 3) is lost."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    good = pages.select(F.col("page_id").cast(T.LongType()).alias("key"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    kept = good.where(~F.coalesce(F.col("key") % 211 == 3, F.lit(False)))
    bad = kept.withColumn("record", F.when(F.col("key") % 101 == 7, F.concat(F.lit("X"), F.substring("record", 2, 2**31 - 1))).otherwise(F.col("record")))
    return audit(good, bad).withColumnRenamed("key", "page_id")


ORACLE = f"""
WITH r AS (SELECT page_id, 57 + strlen(CAST(page_id AS VARCHAR)) + 20 + strlen(coalesce(url, '')) + 18 + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + 8 + strlen(coalesce(html, '')) AS n FROM pages),
s AS (SELECT page_id, CAST(sum(n) AS BIGINT) AS n_bytes FROM r GROUP BY 1),
o AS (SELECT page_id, page_id // {SLOTS} AS file_no, n_bytes, CAST(coalesce(sum(n_bytes) OVER (PARTITION BY page_id // {SLOTS} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM s)
SELECT page_id, CASE WHEN page_id % 211 = 3 THEN 'missing' ELSE 'changed' END AS status, file_no, byte_offset, n_bytes FROM o WHERE page_id % 211 = 3 OR page_id % 101 = 7"""

"""Rendezvous (highest random weight) hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagedrift.llm.common import heavy_keys

#: Rows that share a leading part of their key digest are numbered together; about this many to a group.
RUN_ROWS = 50_000


def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) drawn from the key and the shard: 52 bits of their MD5."""
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the largest score -weight / ln(u); of equal scores the lowest shard.

    A further shard only adds a candidate, so a key either stays or moves to the new shard. Each shard gets a share of
    keys in proportion to its weight.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [F.struct((F.lit(-float(w)) / F.log(uniform(key, j))).alias("score"), F.lit(-j).alias("low")) for j, w in enumerate(weights)]
    return (-F.array_max(F.array(*scores))["low"]).cast("int")


def key_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _run(rows: DataFrame, digits: int, n: int) -> Column:
    """The run of a row, in the order of rows: the leading digits of its digest, the last hot digest up to it with those
    digits, and, for rows of that digest, size and leading byte of the checksum."""
    lead = F.substring("_digest", 1, digits)
    busy = heavy_keys(rows, ["_digest"], n)
    hot = F.array(*[F.lit(r["_digest"]) for r in busy.collect()] if busy is not None else [F.lit("")])
    last = F.array_max(F.filter(hot, lambda d: (d <= F.col("_digest")) & F.startswith(d, lead)))
    own = F.coalesce(last == F.col("_digest"), F.lit(False))
    apart = lambda c: F.when(own, c).otherwise(F.lit(0).cast("long"))
    return F.struct(lead, F.coalesce(last, F.lit("")), ~own, apart(F.col("size")), apart(F.shiftright("text_crc32", 24)))


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Shard every row of docs(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1, a null text counting as none. slot numbers the rows of a shard from 0 without
    gaps, by the MD5 of the key, then size and checksum. A null doc_id is the empty key; rows with equal ids share a
    shard and get slots of their own. grown_shard is the shard under the weights `grown`. Other columns play no part; an empty
    table gives an empty result. Only ids and sizes are shuffled.

    No task numbers a whole shard: rows are numbered in runs that share a leading part of the digest, and each run starts
    where the counts of the runs before it end. An id of over a thousandth of the rows has runs of its own, for each size
    and leading byte of the checksum.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = key_text(F.col("doc_id"))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.md5(key.cast("binary")).alias("_digest"),
    )
    n = docs.count()
    digits = 1
    while len(weights) * 16**digits * RUN_ROWS < n:
        digits += 1
    rows = rows.withColumn("_run", _run(rows, digits, n))
    counts = rows.groupBy("shard", "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_run").orderBy("_digest", "doc_id", "size", "text_crc32")
    return (
        rows.withColumn("_at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "_run"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot"), "grown_shard")
    )

"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Bytes of rows that cross to Python at once.
BATCH_BYTES = 8 << 20
#: Keys that count as hot, at most: those with more than this share of all rows.
HEAVY_KEYS = 1000
#: Rows of a table below which no key of it is hot.
HEAVY_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Leave the cluster's shared checkpoint folder alone. Only a local master, as in tests, may do without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and return what was written, without its lineage."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared checkpoint folder, which goes when the application ends."""
    with_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/{kind}/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def saved(df: DataFrame) -> DataFrame:
    """As cut(), but as a Parquet table in that folder: for many narrow rows, which a checkpoint writes uncompressed."""
    at = folder(df.sparkSession, "tables")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def heavy_keys(rows: DataFrame, on: list[str], total: int, most: int = HEAVY_KEYS) -> DataFrame | None:
    """The keys that more than total / most of at most `total` rows bear, fewer than `most` by arithmetic; None if there are none."""
    if total < HEAVY_ROWS:
        return None
    found = rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") * most > total).select(*on)
    keys = found.collect()
    return rows.sparkSession.createDataFrame(keys, found.schema) if keys else None


def joined(rows: DataFrame, facts: DataFrame, on: list[str], heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with facts, which has a row for a key at most. Rows of heavy keys meet a broadcast of the heavy facts, fewer
    than HEAVY_KEYS rows, where they are; only the others are shuffled, so no task gets all rows of a hot key."""
    if heavy is None:
        return rows.join(facts, on, how)
    keys = F.broadcast(heavy)
    hot = rows.join(keys, on, "left_semi").join(F.broadcast(facts.join(keys, on, "left_semi")), on, how)
    return hot.unionByName(rows.join(keys, on, "left_anti").join(facts, on, how))


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lean(spark: SparkSession) -> None:
    """Let what crosses to Python at once be BATCH_BYTES, however long texts are, where the session has Spark's own default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(name)).rstrip("bB") == str(64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))


def released() -> None:
    """Give memory that Arrow and numpy have freed back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of batches in smaller ones, so that few of them are Python objects at once; memory is released at the end."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)
    released()


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; one empty text for a text without words or null."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r")), SPACE_CLASS)


def bound(value: Column, use) -> Column:
    """use(value), with value computed once for a row however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows."""
    return df.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0


def parts_for(n_bytes: int, each: int, least: int = 8) -> int:
    """How many parts of about `each` bytes hold n_bytes."""
    return max(least, math.ceil(n_bytes / each))


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels no model sees: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def label_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` labelled rows that aren't held out, chosen by the digest of doc_id: (doc_id, y, fold).

    The bound is what makes a broadcast of this sample safe at any size of `labels`. fold is crc32 mod 5, 1 to 4.
    Rows with a null id or label are left out; of repeated ids the larger label counts.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label)
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .withColumn("fold", (crc % 5).cast("int"))
        .where("fold <> 0")
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
        .limit(most)
    )

"""Configuration, stored bytes, robots rules and published documents."""

from __future__ import annotations

import json
import os
import re
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTLET = T.StructType([T.StructField(c, T.StringType()) for c in ("slug", "name", "language", "base_url", "tier")] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("rss_urls", "sitemap_urls", "limitations")] + [T.StructField("rate", T.DoubleType())])


def outlets(spark: SparkSession, text: str) -> DataFrame:
    """Outlets of a YAML configuration; a missing field or a repeated slug is an error."""
    import yaml

    rows = []
    for slug, o in (yaml.safe_load(text) or {}).get("outlets", {}).items():
        missing = [k for k in ("name", "language", "base_url", "tier") if not o.get(k)]
        if missing or not re.fullmatch(r"[a-z0-9_-]+", slug):
            raise ValueError(f"{slug}: {', '.join(missing) or 'bad slug'}")
        rows.append((slug, o["name"], o["language"], o["base_url"], o["tier"], *(list(o.get(k) or []) for k in ("rss_urls", "sitemap_urls", "limitations")), float(o["rate"]) if o.get("rate") else None))
    return spark.createDataFrame(rows, OUTLET)


def blobs(content: DataFrame) -> DataFrame:
    """Each distinct content once, under its digest: digest, size, content."""
    return content.select(F.sha2("content", 256).alias("digest"), F.length("content").alias("size"), "content").dropDuplicates(["digest"])


@F.pandas_udf(T.BooleanType())
def _allowed(status: pd.Series, body: pd.Series, agent: pd.Series, url: pd.Series) -> pd.Series:
    out, known = [], {}
    for s, b, a, u in zip(status, body, agent, url, strict=True):
        if pd.isna(s):
            out.append(False)
        elif not 200 <= s < 300:
            out.append(400 <= s < 500)
        else:
            if b not in known:
                known[b] = RobotFileParser()
                known[b].parse((b or "").splitlines())
            out.append(known[b].can_fetch(a, u))
    return pd.Series(out)


def allowed(rows: DataFrame) -> DataFrame:
    """rows(status, body, agent, url) with allowed: by robots.txt's rules, all for a 4xx, nothing if it can't be had."""
    return rows.withColumn("allowed", _allowed("status", "body", "agent", "url"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """robots(outlet_id, base_url, status, body, agent) with sitemaps, the URLs that the file declares, and disallows_homepage."""
    declared = F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), 1)
    told = robots.withColumn("sitemaps", F.when(F.col("status").between(200, 299), declared).otherwise(F.array().cast("array<string>")))
    return told.withColumn("disallows_homepage", ~_allowed("status", "body", "agent", "base_url"))


def internal_document(rows: DataFrame, version: str, generated_at: str) -> dict:
    """One document of the rows of a triage document, of which there are few: schema_version, generated_at, events."""
    return {"schema_version": version, "generated_at": generated_at, "events": [json.loads(x) for x in rows.toJSON().collect()]}


def write_document(path: str, document: dict) -> None:
    """One JSON document with sorted keys, put in place at once. For results of a few rows."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.write("\n")
    os.replace(f"{path}.new", path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType, version: str | None = None) -> DataFrame:
    """JSON lines that must fit the schema, hold no other field and, if a version is named, have it as schema_version."""
    raw = spark.read.text(path)
    names = sorted(f.name for f in schema.fields)
    extra = raw.where(F.size(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, names)))) > 0).limit(1).count()
    if extra:
        raise ValueError(f"{path}: fields beyond {', '.join(names)}")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if version is not None and not rows.where(~F.col("schema_version").eqNullSafe(F.lit(version))).isEmpty():
        raise ValueError(f"{path}: schema_version is not {version}")
    return rows

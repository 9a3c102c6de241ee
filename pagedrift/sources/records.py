"""Rows that fetches leave behind, and reports in plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed value: the columns of the report of outlets.
OUTLET_LINE = "%-17s %-4s %8d %8d %6d %8d %6s %8s %-9s %5d %4d  %s"


def attempts(fetches: DataFrame) -> DataFrame:
    """A row for each attempt of each fetch, whatever came of it.

    fetches: outlet_id, article_id, kind, vantage, tries: array of (url, final_url, started_at, elapsed_ms, outcome, http_status,
    content_type, response_bytes, error). attempt counts from 1.
    """
    rows = fetches.select("outlet_id", "article_id", "kind", "vantage", F.posexplode("tries").alias("_at", "_t"))
    return rows.select("outlet_id", "article_id", "kind", "vantage", (F.col("_at") + 1).alias("attempt"), "_t.*")


def robots_bodies(fetches: DataFrame) -> DataFrame:
    """The body of each robots.txt that was had: outlet_id, fetched_at (of the last attempt), body_hash, body_text. fetches also has content."""
    last = F.element_at("tries", -1)
    return fetches.where("kind = 'robots'").where(last["outcome"] == "ok").select("outlet_id", last["started_at"].alias("fetched_at"), F.sha2("content", 256).alias("body_hash"), F.col("content").cast("string").alias("body_text"))


def declined(asked: DataFrame) -> DataFrame:
    """Fetches that robots rules forbid, as attempts of their own, so that the gap is seen: asked(outlet_id, article_id, kind, vantage, url, at, allowed)."""
    return asked.where("NOT allowed").select("outlet_id", "article_id", "kind", "vantage", F.lit(1).alias("attempt"), "url", F.col("at").alias("started_at"), F.lit("robots_blocked").alias("outcome"), F.lit(None).cast("int").alias("http_status"))


def outlet_report(stats: DataFrame) -> DataFrame:
    """A line of text for each outlet, by slug: slug, line. stats: slug, language, articles, captured, snapshots, archived, median_length, health, short, errors, fetches (map of outcome to count)."""
    rate = F.when(F.col("snapshots") > 0, F.format_string("%.0f%%", F.col("archived") * 100 / F.col("snapshots"))).otherwise("-")
    median = F.when(F.col("median_length").isNotNull(), F.format_string("%.0f", F.col("median_length").cast("double"))).otherwise("-")
    told = F.array_join(F.transform(F.array_sort(F.map_entries("fetches")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    line = F.format_string(OUTLET_LINE, "slug", "language", "articles", "captured", "snapshots", "archived", rate, median, "health", "short", "errors", F.when(told == "", "-").otherwise(told))
    return stats.select("slug", line.alias("line")).orderBy("slug")


def candidate_report(chosen: DataFrame) -> DataFrame:
    """A line of text for each candidate of discovery.selected(): outlet_id, place, line."""
    detail = F.concat(F.coalesce("kind", F.lit("-")), F.lit(" n="), F.col("entries").cast("string"))
    share = F.when(F.col("on_site_share").isNotNull(), F.concat(F.lit(" on-site="), F.format_string("%.0f%%", F.col("on_site_share") * 100))).otherwise("")
    newest = F.when(F.col("newest").isNotNull(), F.concat(F.lit(" newest="), F.date_format("newest", "yyyy-MM-dd'T'HH:mm"))).otherwise("")
    why = F.when(F.col("reason").isNotNull(), F.concat(F.lit("  "), F.col("reason"))).otherwise("")
    mark = F.when(F.col("selected"), "+").otherwise(" ")
    return chosen.select("outlet_id", "place", F.concat(mark, F.lit(" ["), F.rpad("source", 13, " "), F.lit("] "), F.col("url"), F.lit("  "), detail, share, newest, why).alias("line")).orderBy("outlet_id", "place")

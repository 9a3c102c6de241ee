"""Typed change events from snapshots, attempts and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagedrift.functions.fetching import age_band, gone_kind

# The base severity of each event type, and of any other type.
BASE_SEVERITY = {"BYLINE_REMOVED": 9, "GONE_404": 8, "GONE_410": 8, "GONE_SOFT": 8, "ROBOTS_BLOCKED": 6, "BODY_CHANGED": 5, "DEINDEXED": 5, "UNPUBLISHED": 4, "BYLINE_CHANGED": 4, "HEADLINE_CHANGED": 3, "REDIRECTED": 3, "DATE_CHANGED": 2, "RESTORED": 1}
OTHER_SEVERITY = 3
#: A document is gone after so many like failures in a row that span so many hours.
STREAK, SPAN_HOURS = 3, 6
#: Where a publication date comes from if the page itself doesn't name one.
FALLBACK_DATE = "trafilatura_normalised"


def age_hours(first_seen: Column, at: Column) -> Column:
    return F.greatest((F.unix_micros(at) - F.unix_micros(first_seen)) / F.lit(3.6e9), F.lit(0.0))


def severity(kind: Column, hours: Column) -> Column:
    """A sort key, never a filter: the type's base times the band of the document's age."""
    base = F.create_map(*[F.lit(x) for pair in BASE_SEVERITY.items() for x in pair])
    return F.coalesce(F.try_element_at(base, kind), F.lit(OTHER_SEVERITY)) * age_band(hours)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def snapshot_changes(snapshots: DataFrame, same_version: bool = False, carried: list[str] | None = None) -> DataFrame:
    """A row for each observed change between consecutive snapshots of an article.

    snapshots: article_id, id, fetched_at, headline_hash, byline, byline_hash, body_hash, published_at, date_source,
    final_url, and extractor_version if same_version asks for pairs of one version only; carried names columns of the later
    snapshot to keep. One shuffle, by article; bodies don't take part in it.
    """
    kept = carried or []
    cols = ["id", "headline_hash", "byline", "byline_hash", "body_hash", "published_at", "date_source", "final_url"] + ["extractor_version"] * same_version
    w = Window.partitionBy("article_id").orderBy("fetched_at", "id")
    pairs = snapshots.select("article_id", "fetched_at", *kept, F.struct(*cols).alias("now"), F.lag(F.struct(*cols)).over(w).alias("was")).where("was IS NOT NULL")
    if same_version:
        pairs = pairs.where(F.col("now.extractor_version").eqNullSafe(F.col("was.extractor_version")))
    differs = lambda c: ~F.col(f"now.{c}").eqNullSafe(F.col(f"was.{c}"))
    date = lambda side: F.coalesce(F.col(f"{side}.published_at"), F.lit(""))
    weak = F.coalesce(F.col("now.date_source") == FALLBACK_DATE, F.lit(False)) | F.coalesce(F.col("was.date_source") == FALLBACK_DATE, F.lit(False))
    event = lambda when, kind, sure=F.lit("confirmed"): F.when(when, F.struct(kind.alias("type"), sure.alias("confidence")))
    found = F.array(
        event(differs("headline_hash"), F.lit("HEADLINE_CHANGED")),
        event(differs("byline_hash"), F.when(_blank(F.col("now.byline")) & ~_blank(F.col("was.byline")), "BYLINE_REMOVED").otherwise("BYLINE_CHANGED")),
        event(differs("body_hash"), F.lit("BODY_CHANGED")),
        event(date("now") != date("was"), F.lit("DATE_CHANGED"), F.when(weak, "unverified").otherwise("confirmed")),
        event(differs("final_url"), F.lit("REDIRECTED")),
    )
    return pairs.select("article_id", F.col("fetched_at").alias("detected_at"), F.col("was.id").alias("from_snapshot_id"), F.col("now.id").alias("to_snapshot_id"), *kept, F.explode(F.array_compact(found)).alias("e")).select("article_id", "detected_at", "from_snapshot_id", "to_snapshot_id", "e.type", "e.confidence", *kept)


def snapshot_pairs(snapshots: DataFrame) -> DataFrame:
    """snapshots(article_id, id, fetched_at, ...) that have one before them, with its id as from_snapshot_id."""
    before = F.lag("id").over(Window.partitionBy("article_id").orderBy("fetched_at", "id"))
    return snapshots.withColumn("from_snapshot_id", before).where("from_snapshot_id IS NOT NULL")


def gone_events(attempts: DataFrame, first_of_streak: bool = False) -> DataFrame:
    """Events for documents that keep failing alike: article_id, fetch_attempt_id, detected_at, type, confidence.

    attempts: article_id, id, started_at, outcome, http_status; an ok attempt is a snapshot and ends a streak. Each attempt
    that is the third in a row of one kind, over six hours or more, gives an event; with first_of_streak only the first.
    """
    w = Window.partitionBy("article_id").orderBy("started_at", "id")
    told = attempts.select("article_id", "id", "started_at", gone_kind(F.col("outcome"), F.col("http_status")).alias("kind"), F.count(F.when(F.col("outcome") == "ok", 1)).over(w).alias("run"), (F.col("outcome") == "ok").alias("ok")).where("NOT ok")
    s = Window.partitionBy("article_id", "run").orderBy("started_at", "id")
    back = STREAK - 1
    alike = F.lit(True)
    for i in range(1, STREAK):
        alike = alike & F.coalesce(F.lag("kind", i).over(s) == F.col("kind"), F.lit(False))
    long = F.unix_micros("started_at") - F.unix_micros(F.lag("started_at", back).over(s)) >= SPAN_HOURS * 3_600_000_000
    found = told.withColumn("gone", alike & F.coalesce(long, F.lit(False)) & F.col("kind").isNotNull())
    if first_of_streak:
        found = found.withColumn("gone", F.col("gone") & ~F.coalesce(F.lag("gone").over(s), F.lit(False)))
    sure = F.when(F.col("kind") == "ROBOTS_BLOCKED", "probable").otherwise("confirmed")
    return found.where("gone").select("article_id", F.col("id").alias("fetch_attempt_id"), F.col("started_at").alias("detected_at"), F.col("kind").alias("type"), sure.alias("confidence"))


def restored_events(snapshots: DataFrame, absences: DataFrame) -> DataFrame:
    """Snapshots after an event of absence: article_id, from_snapshot_id, to_snapshot_id, detected_at, type, confidence, first_restored.

    snapshots: article_id, fetched_at, id. absences: article_id, detected_at of any event without a snapshot of its own, be it
    gone, blocked or out of the listings. A document's first snapshot is no return. The last absence is never cleared, so each
    further snapshot gives an event; first_restored marks the first one after an absence. from_snapshot_id, that of the
    absence, is always null.
    """
    log = snapshots.select("article_id", F.col("fetched_at").alias("at"), "id", F.lit(None).cast("timestamp").alias("gone_at")).union(absences.select("article_id", F.col("detected_at").alias("at"), F.lit(None).cast("long").alias("id"), F.col("detected_at").alias("gone_at")))
    w = Window.partitionBy("article_id").orderBy("at", F.col("id").asc_nulls_first())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    told = log.withColumn("since", F.last("gone_at", ignorenulls=True).over(before)).withColumn("prev", F.lag("id").over(w)).withColumn("seen", F.max("id").over(before))
    back = told.where("id IS NOT NULL AND since IS NOT NULL AND seen IS NOT NULL")
    return back.select("article_id", F.lit(None).cast("long").alias("from_snapshot_id"), F.col("id").alias("to_snapshot_id"), F.col("at").alias("detected_at"), F.lit("RESTORED").alias("type"), F.lit("confirmed").alias("confidence"), F.col("prev").isNull().alias("first_restored"))


def latest_listings(listings: DataFrame, n: int = 2) -> DataFrame:
    """The latest n fetches of each listing: listings' columns and age, 1 the latest."""
    w = Window.partitionBy("outlet_id", "source_url").orderBy(F.desc("fetched_at"), F.desc("id"))
    return listings.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def presence_changes(entries: DataFrame, aliases: DataFrame, by: tuple[str, ...] = ("article_id",)) -> DataFrame:
    """Documents that left the listings between the previous and the latest fetch: article_id, type, confidence.

    entries: outlet_id, kind (rss or sitemap), age (1 latest, 2 previous), url_hash; aliases: article_id, outlet_id,
    url_hash. Out of all listings is DEINDEXED, out of the sitemap but still in a feed UNPUBLISHED; a feed moving on is
    nothing. An outlet without a previous fetch is silent. by: what a document is told by, returned first; with outlet_id,
    documents of two outlets that share an id are two.
    """
    seen = entries.select("outlet_id", "kind", "age", "url_hash").distinct()
    ready = entries.where("age = 2").select("outlet_id").distinct()
    flag = lambda kind, age: F.max((F.col("kind") == kind) & (F.col("age") == age))
    flags = aliases.join(seen, ["outlet_id", "url_hash"]).join(ready, "outlet_id", "left_semi").groupBy(*by).agg(flag("rss", 2).alias("prev_rss"), flag("sitemap", 2).alias("prev_sm"), flag("rss", 1).alias("cur_rss"), flag("sitemap", 1).alias("cur_sm"))
    left = (F.col("prev_rss") | F.col("prev_sm")) & ~F.col("cur_rss") & ~F.col("cur_sm")
    return flags.select(*by, F.when(left, "DEINDEXED").when(F.col("prev_sm") & ~F.col("cur_sm") & F.col("cur_rss"), "UNPUBLISHED").alias("type"), F.lit("unverified").alias("confidence")).where("type IS NOT NULL")


def delistings(listings: DataFrame, entries: DataFrame, outlets: DataFrame, articles: DataFrame, aliases: DataFrame) -> DataFrame:
    """Documents that left an outlet's listings between the last two fetches of each: article_id, outlet_id, type, confidence, detected_at.

    listings: id, outlet_id, source_url, fetched_at; entries: listing_id, url_hash; outlets: outlet_id, rss_urls, sitemap_urls;
    articles: id, outlet_id, status, merged_into_id; aliases: article_id, url_hash. Only configured listings count, an
    outlet's feeds together and its sitemaps together. Only captured documents are judged, by all URLs of theirs and of those
    merged into them. An id that several outlets have is judged in each, once. detected_at is the outlet's latest fetch, so a
    run whose fetches failed dates its finding as before.
    """
    rss, maps = (outlets.select("outlet_id", F.explode(c).alias("source_url"), F.lit(kind).alias("kind")) for c, kind in (("rss_urls", "rss"), ("sitemap_urls", "sitemap")))
    configured = listings.join(rss.union(maps).distinct(), ["outlet_id", "source_url"])
    latest = latest_listings(configured).select(F.col("id").alias("listing_id"), "outlet_id", "kind", "age", "fetched_at")
    seen = entries.join(latest, "listing_id").select("outlet_id", "kind", "age", "url_hash")
    root = articles.select(F.col("id").alias("article_id"), F.coalesce("merged_into_id", "id").alias("root"))
    live = articles.where("status = 'captured' AND merged_into_id IS NULL").select(F.col("id").alias("root"), "outlet_id")
    own = aliases.join(root, "article_id").join(live, "root").select(F.col("root").alias("article_id"), "outlet_id", "url_hash").distinct()
    found = presence_changes(seen, own, ("article_id", "outlet_id"))
    at = latest.groupBy("outlet_id").agg(F.max("fetched_at").alias("detected_at"))
    return found.join(at, "outlet_id").select("article_id", "outlet_id", "type", "confidence", "detected_at")


def self_corrected(events: DataFrame) -> DataFrame:
    """events with self_corrected: a withdrawal that the very next event undoes marks both."""
    w = Window.partitionBy("article_id").orderBy("detected_at", "id")
    away = lambda c: c.isin("DEINDEXED", "UNPUBLISHED")
    undone = away(F.col("type")) & (F.lead("type").over(w) == "RESTORED")
    undoes = (F.col("type") == "RESTORED") & away(F.lag("type").over(w))
    return events.withColumn("self_corrected", F.coalesce(undone, F.lit(False)) | F.coalesce(undoes, F.lit(False)))


def aged(events: DataFrame) -> DataFrame:
    """events(type, detected_at, first_seen, ...) with age_hours and severity instead of first_seen."""
    return events.withColumn("age_hours", age_hours(F.col("first_seen"), F.col("detected_at"))).withColumn("severity", severity(F.col("type"), F.col("age_hours"))).drop("first_seen")


def scored(events: DataFrame, articles: DataFrame) -> DataFrame:
    """events with age_hours and severity, from articles(article_id, first_seen)."""
    return aged(events.join(articles, "article_id"))

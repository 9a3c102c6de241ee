"""The ordered view that reviewers work from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagedrift.functions.differences import change_snippet
from pagedrift.functions.urls import lists_others, same_site
from pagedrift.operators.events import self_corrected
from pagedrift.operators.review import by_event
from pagedrift.sources.staging import staged

#: Events shown, candidates taken for each of them, versions listed of an article.
SHOWN, TAKEN, VERSIONS = 2000, 3, 20


def top(events: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The gravest events of events(id, url, severity, detected_at, ...): candidates first, then those whose URL is no listing."""
    order = [F.desc("severity"), F.desc("detected_at"), F.asc("id")]
    return events.orderBy(*order).limit(shown * TAKEN).where(~lists_others(F.col("url"))).orderBy(*order).limit(shown)


def oldest_versions(snapshots: DataFrame, n: int = VERSIONS) -> DataFrame:
    """Each article's oldest n snapshots as one ordered list: article_id, n_versions (of all), versions.

    One shuffle: the window that numbers the snapshots also counts them.
    """
    w = Window.partitionBy("article_id")
    told = snapshots.withColumn("_n", F.row_number().over(w.orderBy("fetched_at", "id"))).withColumn("_all", F.count("*").over(w)).where(F.col("_n") <= n)
    shown = [c for c in ("fetched_at", "id", "headline", "body", "archive_url") if c in snapshots.columns]
    return told.groupBy("article_id").agg(F.first("_all").alias("n_versions"), F.array_sort(F.collect_list(F.struct(*shown))).alias("versions"))


FIELDS = ["headline", "byline", "published_at", "final_url", "fetched_at", "body", "archive_url"]


def archive_urls(archives: DataFrame) -> DataFrame:
    """The latest good copy of each snapshot: snapshot_id, archive_url. archives: id, snapshot_id, outcome, archive_url, requested_at."""
    good = archives.where("outcome = 'ok' AND archive_url <> ''")
    return good.groupBy("snapshot_id").agg(F.max_by("archive_url", F.struct("requested_at", "id")).alias("archive_url"))


def document(events: DataFrame, articles: DataFrame, outlets: DataFrame, snapshots: DataFrame, archives: DataFrame, annotations: DataFrame, shown: int = SHOWN) -> DataFrame:
    """What reviewers work from, a row for each of the gravest events, in the order of top().

    events: id, article_id, type, detected_at, confidence, severity, age_hours, from_snapshot_id, to_snapshot_id, review columns;
    articles: id, outlet_id, canonical_url; outlets: outlet_id, slug, name; snapshots: id, article_id and the FIELDS but
    archive_url. Each row has the fields of both snapshots, a short difference of their bodies, the annotations, how many
    events its article has, the article's oldest versions, and whether the event corrected itself.

    Only the ranking looks at all events. Everything else is reduced to the articles and snapshots of at most `shown` rows
    before it is joined; these are broadcast, being that many at most.
    """
    told = events.join(articles.select(F.col("id").alias("article_id"), "outlet_id", F.col("canonical_url").alias("url")), "article_id").join(outlets.select("outlet_id", F.col("slug").alias("outlet_slug"), F.col("name").alias("outlet_name")), "outlet_id")
    rows = staged(top(told, shown))
    wanted = F.broadcast(rows.select("article_id").distinct())
    of_articles = events.join(wanted, "article_id", "left_semi")
    flags = self_corrected(of_articles.select("article_id", "id", "type", "detected_at")).select("id", "self_corrected")
    counts = of_articles.groupBy("article_id").agg(F.count("*").alias("article_change_count"))
    shots = snapshots.join(wanted, "article_id", "left_semi")
    shots = shots.join(archive_urls(archives).withColumnRenamed("snapshot_id", "id"), "id", "left")
    side = lambda which: shots.select(F.col("id").alias(f"{which}_snapshot_id"), *[F.col(c).alias(f"{which}_{c}") for c in FIELDS])
    out = rows.join(side("from"), "from_snapshot_id", "left").join(side("to"), "to_snapshot_id", "left")
    out = out.join(by_event(annotations.join(F.broadcast(rows.select(F.col("id").alias("event_id"))), "event_id", "left_semi")).withColumnRenamed("event_id", "id"), "id", "left")
    out = out.join(counts, "article_id").join(oldest_versions(shots), "article_id", "left").join(flags, "id")
    return out.withColumn("body_diff", change_snippet(F.col("from_body"), F.col("to_body"))).orderBy(F.desc("severity"), F.desc("detected_at"), F.asc("id"))


def kept_pages(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose body their article hadn't had before: only their pages are kept."""
    w = Window.partitionBy("article_id", "body_hash").orderBy("fetched_at", "id")
    return snapshots.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ingested(entries: DataFrame, known: DataFrame, cutoff) -> DataFrame:
    """entries(outlet_id, root, kind, url, url_hash, date) with label: off_site, non_article, outside_window, known or new."""
    old = known.select("url_hash").distinct().withColumn("_known", F.lit(True))
    inside = F.coalesce(F.col("date") >= cutoff, F.col("kind").isin("rss", "atom", "news_sitemap"))
    label = F.when(~same_site(F.col("url"), F.col("root")), "off_site").when(lists_others(F.col("url")), "non_article").when(~inside, "outside_window").when(F.col("_known"), "known").otherwise("new")
    return entries.join(old, "url_hash", "left").withColumn("label", label).drop("_known")

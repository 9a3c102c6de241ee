"""Queries of the published tables and of what reviewers see, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagedrift.functions import fetching
from pagedrift.operators import discovery, events, export, queue, review, triage
from pagedrift.plans import standins as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _figures(r: dict[str, DataFrame]) -> DataFrame:
    return export.outlet_figures(r["outlets"], r["articles"], r["attempts"], r["snapshots"], r["archives"])


def _plan(r: dict[str, DataFrame]):
    figures = _figures(r)
    return figures, export.suppression(figures, t.FAMILIES)


@query(f"WITH RECURSIVE {t.EXPORT} SELECT outlet_id, language, tier, discovered, attempted, captured, snapshots, archived FROM figures")
def outlet_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _figures(t.export(spark, sf_dir))


@query(f"WITH RECURSIVE {t.EXPORT} SELECT count(*) AS outlets, sum(discovered)::BIGINT AS discovered, sum(attempted)::BIGINT AS attempted, sum(captured)::BIGINT AS captured, sum(snapshots)::BIGINT AS snapshots, sum(archived)::BIGINT AS archived, round_even(sum(archived) / sum(snapshots), 4) AS archive_rate FROM figures")
def cohort_totals(spark, sf_dir):
    return export.totals(_figures(t.export(spark, sf_dir)))


COVERAGE = f"""{t.EXPORT}, {t.SUPPRESSION},
 summed AS (SELECT grp, key, count(outlet_id) AS outlets, count(*) FILTER (contributes) AS contributing, coalesce(sum(discovered), 0)::BIGINT AS discovered, coalesce(sum(attempted), 0)::BIGINT AS attempted, coalesce(sum(captured), 0)::BIGINT AS captured, coalesce(sum(snapshots), 0)::BIGINT AS snapshots, coalesce(sum(archived), 0)::BIGINT AS archived
  FROM grp_key LEFT JOIN member USING (place, grp, key) LEFT JOIN figures USING (outlet_id) GROUP BY 1, 2),
 coverage AS (SELECT grp, key, outlets, reason IS NOT NULL AS suppressed, reason, CASE WHEN reason IS NULL THEN contributing END AS contributing, CASE WHEN reason IS NULL THEN discovered END AS discovered, CASE WHEN reason IS NULL THEN captured END AS captured, CASE WHEN reason IS NULL THEN snapshots END AS snapshots,
  CASE WHEN reason IS NULL THEN archived END AS archived, CASE WHEN reason IS NULL AND attempted > 0 THEN round_even(captured / attempted, 4) END AS capture_rate, CASE WHEN reason IS NULL AND snapshots > 0 THEN round_even(archived / snapshots, 4) END AS archive_rate FROM summed JOIN plan USING (grp, key))"""


@query(f"WITH RECURSIVE {COVERAGE} SELECT * FROM coverage")
def published_coverage(spark, sf_dir):
    figures, plan = _plan(t.export(spark, sf_dir))
    return export.coverage(figures, t.FAMILIES, plan)


HEALTH = f"""{COVERAGE}, newest AS (SELECT outlet_id, body_length, failed FROM own QUALIFY row_number() OVER (PARTITION BY outlet_id ORDER BY fetched_at DESC, id DESC) <= 50),
 judged AS (SELECT *, body_length < greatest(200.0, 0.3 * median(body_length) OVER (PARTITION BY outlet_id)) AS short FROM newest),
 pooled AS (SELECT grp, key, count(DISTINCT j.outlet_id) AS contributing, count(j.outlet_id) AS sample, median(body_length) AS median_length, count(*) FILTER (short) AS short, count(*) FILTER (failed) AS errors FROM grp_key LEFT JOIN member USING (place, grp, key) LEFT JOIN judged j USING (outlet_id) GROUP BY 1, 2),
 health AS (SELECT grp, key, reason IS NOT NULL AS suppressed, reason, CASE WHEN reason IS NULL THEN contributing END AS contributing, CASE WHEN reason IS NULL THEN CASE WHEN sample = 0 THEN 'no_data' WHEN (short + errors) / sample < 0.1 THEN 'ok' WHEN (short + errors) / sample < 0.4 THEN 'degraded' ELSE 'failing' END END AS status,
  CASE WHEN reason IS NULL THEN sample END AS sample, CASE WHEN reason IS NULL THEN median_length END AS median_length, CASE WHEN reason IS NULL THEN short END AS short, CASE WHEN reason IS NULL THEN errors END AS errors FROM pooled JOIN plan USING (grp, key))"""


@query(f"WITH RECURSIVE {HEALTH} SELECT * FROM health")
def published_health(spark, sf_dir):
    r = t.export(spark, sf_dir)
    return export.health(r["outlets"], r["articles"], r["snapshots"], t.FAMILIES, _plan(r)[1])


EVENTS = f"""{HEALTH}, counted AS (SELECT outlet_id, CASE l_linenumber % 3 WHEN 0 THEN 'BODY_CHANGED' WHEN 1 THEN 'GONE_404' ELSE 'BYLINE_REMOVED' END AS type FROM own WHERE l_discount > 0.015 AND l_tax < 0.065 AND l_quantity > 5),
 typed AS (SELECT grp, key, type, count(*) AS n FROM member JOIN counted USING (outlet_id) GROUP BY ALL),
 event_summary AS (SELECT grp, key, reason IS NOT NULL AS suppressed, reason, CASE WHEN reason IS NULL THEN s.c END AS contributing, CASE WHEN reason IS NULL THEN coalesce(k.total, 0)::BIGINT END AS published_events, CASE WHEN reason IS NULL THEN coalesce(by_type, '') END AS by_type
  FROM plan JOIN sized s USING (grp, key) LEFT JOIN (SELECT grp, key, sum(n) AS total, string_agg(type || '=' || n, ',' ORDER BY type) AS by_type FROM typed GROUP BY 1, 2) k USING (grp, key))"""


def _events(r: dict[str, DataFrame]) -> DataFrame:
    figures, plan = _plan(r)
    return export.event_summary(r["outlets"], r["articles"], r["events"], r["annotations"], figures, t.FAMILIES, plan)


@query(f"WITH RECURSIVE {EVENTS} SELECT * FROM event_summary")
def published_events(spark, sf_dir):
    told = F.array_join(F.transform(F.array_sort(F.map_entries("by_type")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return _events(t.export(spark, sf_dir)).withColumn("by_type", told)


VOLUME = """moment AS (SELECT fetched_at AS stamp, 1 AS s, 0 AS f FROM own UNION ALL SELECT first_seen, 0, 1 FROM live),
 by_day AS (SELECT CAST(stamp + INTERVAL 6 HOUR AS DATE) AS day, sum(s) AS s, sum(f) AS f FROM moment GROUP BY 1),
 volume AS (SELECT CAST(x.day AS DATE) AS day, coalesce(s, 0)::BIGINT AS snapshots, coalesce(f, 0)::BIGINT AS articles_first_seen FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM by_day) x LEFT JOIN by_day b ON b.day = CAST(x.day AS DATE) WHERE (SELECT count_if(snapshots > 0) >= 3 FROM figures))"""


def _volume(r: dict[str, DataFrame], plan) -> DataFrame:
    return export.volume(r["outlets"], r["articles"], r["snapshots"], ("all", "all") in plan)


@query(f"WITH RECURSIVE {t.EXPORT}, {VOLUME} SELECT * FROM volume")
def published_volume(spark, sf_dir):
    r = t.export(spark, sf_dir)
    return _volume(r, _plan(r)[1])


@query(f"WITH RECURSIVE {t.EXPORT} SELECT min(fetched_at) AS first_capture_at, max(fetched_at) AS last_capture_at, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT vantage AS v FROM shot)) AS vantages, (SELECT max(ts) FROM events) AS last_listing_at FROM shot")
def published_meta(spark, sf_dir):
    r = t.export(spark, sf_dir)
    return export.meta(r["snapshots"], r["listings"]).withColumn("vantages", F.array_join("vantages", ","))


@query(f"WITH RECURSIVE {EVENTS} SELECT grp, key, outlets, c.contributing, snapshots, status, median_length, published_events, c.reason FROM coverage c JOIN health USING (grp, key) JOIN event_summary USING (grp, key)")
def group_table(spark, sf_dir):
    r = t.export(spark, sf_dir)
    figures, plan = _plan(r)
    return export.group_table(export.coverage(figures, t.FAMILIES, plan), export.health(r["outlets"], r["articles"], r["snapshots"], t.FAMILIES, plan), _events(r))


CALENDAR = f"""{t.EXPORT}, {VOLUME}, told AS (SELECT min(day) FILTER (snapshots > 0) AS started, max(day) AS last FROM volume),
 days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1997-10-01', TIMESTAMP '1998-09-30', INTERVAL 1 DAY)) AS DATE) AS day),
 placed AS (SELECT day, (dayofweek(date_trunc('month', day)) + 1) % 7 + dayofmonth(day) - 1 AS place FROM days)
SELECT day, (place % 7)::INT AS week_column, (place // 7)::INT AS week_row, CASE WHEN day > last THEN 'future' WHEN started IS NULL OR day < started THEN 'before' WHEN coalesce(snapshots, 0) > 0 THEN 'capture' ELSE 'zero' END AS kind, coalesce(snapshots, 0) AS snapshots
FROM placed LEFT JOIN volume USING (day), told"""


@query(f"WITH RECURSIVE {CALENDAR}")
def capture_calendar(spark, sf_dir):
    r = t.export(spark, sf_dir)
    return export.calendar(_volume(r, _plan(r)[1]), F.lit("1998-09-12").cast("date"))


#: Errors that are put into the published tables, each of which breaks rules.
BROKEN = """covered AS (SELECT grp, key, CASE WHEN key = 'ASIA' THEN outlets + 1 ELSE outlets END AS outlets, suppressed, CASE WHEN key = 'EUROPE' THEN 'small_group' ELSE reason END AS reason, CASE WHEN key = 'AMERICA' THEN 2 ELSE contributing END AS contributing, discovered, captured,
  CASE WHEN grp = 'all' THEN snapshots + 1 ELSE snapshots END AS snapshots, CASE WHEN key = 'tier1' THEN snapshots + 5 ELSE archived END AS archived, capture_rate, archive_rate FROM coverage),
 healthy AS (SELECT grp, key, CASE WHEN key = 'tier2' THEN NULL ELSE status END AS status, suppressed, reason, contributing, sample, median_length, short, errors FROM health WHERE key <> 'tier5'),
 broken AS (
  SELECT grp || ':' || key AS place, unnest([
   CASE WHEN CASE WHEN suppressed THEN coalesce(contributing, discovered, captured, snapshots, archived, capture_rate, archive_rate) IS NOT NULL ELSE contributing IS NULL OR discovered IS NULL OR captured IS NULL OR snapshots IS NULL OR archived IS NULL END THEN 'coverage: figures are null exactly when suppressed' END,
   CASE WHEN suppressed <> (reason IS NOT NULL) THEN 'coverage: a reason is set exactly when suppressed' END, CASE WHEN NOT suppressed AND contributing < 3 THEN 'coverage: published with too few contributing' END,
   CASE WHEN outlets <> s.n THEN 'coverage: outlets are its members' END, CASE WHEN NOT suppressed AND captured > discovered THEN 'coverage: captured within discovered' END, CASE WHEN NOT suppressed AND archived > snapshots THEN 'coverage: archived within snapshots' END]) AS rule FROM covered JOIN sized s USING (grp, key)
  UNION ALL SELECT grp || ':' || key, unnest([CASE WHEN CASE WHEN suppressed THEN coalesce(contributing::VARCHAR, status, sample::VARCHAR, median_length::VARCHAR, short::VARCHAR, errors::VARCHAR) IS NOT NULL ELSE contributing IS NULL OR status IS NULL END THEN 'health: figures are null exactly when suppressed' END,
   CASE WHEN NOT suppressed AND contributing < 3 THEN 'health: published with too few contributing' END]) FROM healthy
  UNION ALL SELECT grp || ':' || key, 'health: groups and reasons are those of coverage' FROM covered c LEFT JOIN healthy h USING (grp, key) WHERE h.suppressed IS NULL OR h.reason IS DISTINCT FROM c.reason
  UNION ALL SELECT grp || ':' || key, 'events: groups and reasons are those of coverage' FROM covered c JOIN event_summary e USING (grp, key) WHERE e.reason IS DISTINCT FROM c.reason
  UNION ALL SELECT grp, unnest([CASE WHEN sum(outlets) <> (SELECT count(*) FROM figures) THEN 'coverage: the groups of a family are all outlets' END, CASE WHEN NOT bool_or(suppressed) AND sum(snapshots) <> (SELECT snapshots FROM covered WHERE grp = 'all') THEN 'coverage: the snapshots of a family are all snapshots' END]) FROM covered WHERE grp <> 'all' GROUP BY grp
  UNION ALL SELECT 'volume', 'volume: the series is that of all outlets' FROM (SELECT sum(snapshots) AS s FROM volume) WHERE s <> (SELECT snapshots FROM covered WHERE grp = 'all'))"""


@query(f"WITH RECURSIVE {EVENTS}, {VOLUME}, {BROKEN} SELECT place, rule FROM broken WHERE rule IS NOT NULL")
def dataset_violations(spark, sf_dir):
    r = t.export(spark, sf_dir)
    figures, plan = _plan(r)
    when = lambda key, x, c: F.when(F.col("key") == key, x).otherwise(F.col(c)).alias(c)
    covered = export.coverage(figures, t.FAMILIES, plan)
    covered = covered.select("grp", "key", when("ASIA", F.col("outlets") + 1, "outlets"), "suppressed", when("EUROPE", F.lit("small_group"), "reason"), when("AMERICA", F.lit(2).cast("long"), "contributing"), "discovered", "captured", when("all", F.col("snapshots") + 1, "snapshots"), when("tier1", F.col("snapshots") + 5, "archived"), "capture_rate", "archive_rate")
    healthy = export.health(r["outlets"], r["articles"], r["snapshots"], t.FAMILIES, plan).where("key <> 'tier5'").withColumn("status", F.when(F.col("key") != "tier2", F.col("status")))
    return export.dataset_violations(r["outlets"].where("active"), covered, healthy, _events(r), _volume(r, plan))


# Listings: the orders of a customer are an outlet's; a fetch a year and a listing of one clerk or another.
LISTED = """run AS (SELECT DISTINCT l_suppkey AS outlet_id, CASE WHEN l_returnflag = 'N' THEN 'sitemap' ELSE 'feed-' || l_returnflag END AS source_url, date_trunc('year', l_shipdate) AS fetched_at FROM lineitem),
 fetched AS (SELECT outlet_id, source_url, fetched_at, row_number() OVER (PARTITION BY outlet_id, source_url ORDER BY fetched_at DESC) AS age FROM run WHERE source_url <> 'feed-R' OR outlet_id % 2 = 0),
 entry AS (SELECT DISTINCT l_suppkey AS outlet_id, CASE WHEN l_returnflag = 'N' THEN 'sitemap' ELSE 'feed-' || l_returnflag END AS source_url, date_trunc('year', l_shipdate) AS fetched_at, sha256(CAST(l_partkey AS VARCHAR)) AS url_hash FROM lineitem),
 seen AS (SELECT DISTINCT outlet_id, CASE WHEN source_url = 'sitemap' THEN 'sitemap' ELSE 'rss' END AS kind, age, url_hash FROM entry JOIN fetched USING (outlet_id, source_url, fetched_at) WHERE age <= 2),
 article AS (SELECT DISTINCT l_suppkey * 1000000 + l_partkey AS id, l_suppkey AS outlet_id, l_partkey FROM lineitem),
 captured AS (SELECT id, outlet_id, l_partkey FROM article WHERE id % 4 <> 0),
 alias AS (SELECT CASE WHEN id % 9 = 1 AND (id - 1) % 4 <> 0 AND id - 1 IN (SELECT id FROM article) THEN id - 1 ELSE id END AS root, id, outlet_id, sha256(CAST(l_partkey AS VARCHAR)) AS url_hash FROM article),
 live AS (SELECT id AS root, outlet_id FROM captured WHERE id NOT IN (SELECT id FROM alias WHERE root <> id)),
 flag AS (SELECT root AS article_id, outlet_id, bool_or(kind = 'rss' AND age = 2) AS pr, bool_or(kind = 'sitemap' AND age = 2) AS ps, bool_or(kind = 'rss' AND age = 1) AS cr, bool_or(kind = 'sitemap' AND age = 1) AS cs
  FROM (SELECT DISTINCT root, l.outlet_id, url_hash FROM alias JOIN live l USING (root)) JOIN seen USING (outlet_id, url_hash) GROUP BY 1, 2)"""


@query(f"""WITH {LISTED} SELECT article_id, outlet_id, CASE WHEN NOT cr AND NOT cs THEN 'DEINDEXED' ELSE 'UNPUBLISHED' END AS type, 'unverified' AS confidence, (SELECT max(fetched_at) FROM fetched f WHERE f.outlet_id = flag.outlet_id AND age <= 2) AS detected_at
 FROM flag WHERE (pr OR ps) AND ((NOT cr AND NOT cs) OR (ps AND NOT cs AND cr))""")
def delistings(spark, sf_dir):
    line = t.read(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_returnflag") == "N", "sitemap").otherwise(F.concat(F.lit("feed-"), F.col("l_returnflag")))
    rows = line.select(F.col("l_suppkey").alias("outlet_id"), source.alias("source_url"), F.date_trunc("year", "l_shipdate").alias("fetched_at"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("url_hash"), "l_partkey")
    rows = rows.withColumn("id", F.xxhash64("outlet_id", "source_url", "fetched_at"))
    outlets = rows.select("outlet_id").distinct().select("outlet_id", F.when(F.col("outlet_id") % 2 == 0, F.array(F.lit("feed-A"), F.lit("feed-R"))).otherwise(F.array(F.lit("feed-A"))).alias("rss_urls"), F.array(F.lit("sitemap")).alias("sitemap_urls"))
    ids = rows.select((F.col("outlet_id") * 1_000_000 + F.col("l_partkey")).alias("id"), "outlet_id", "url_hash").distinct()
    older = ids.select((F.col("id") + 1).alias("id"), F.lit(True).alias("older"))
    articles = ids.join(older, "id", "left").select("id", "outlet_id", F.when(F.col("id") % 4 != 0, "captured").otherwise("discovered").alias("status"), F.when((F.col("id") % 9 == 1) & ((F.col("id") - 1) % 4 != 0) & F.col("older"), F.col("id") - 1).alias("merged_into_id"))
    return events.delistings(rows.select("id", "outlet_id", "source_url", "fetched_at").distinct(), rows.select(F.col("id").alias("listing_id"), "url_hash"), outlets, articles, ids.select(F.col("id").alias("article_id"), "url_hash"))


# Triage: turns of conversations are snapshots, and each change between two of them an event.
TRIAGE = f"""{t.VERSIONS.replace("turn AS id", "conv_id * 100 + turn AS id")},
 pair AS (SELECT *, lag(id) OVER w AS from_id FROM versions WINDOW w AS (PARTITION BY article_id ORDER BY fetched_at, id)),
 e AS (SELECT id, article_id, fetched_at AS detected_at, from_id AS from_snapshot_id, id AS to_snapshot_id, CASE id % 5 WHEN 0 THEN 'DEINDEXED' WHEN 1 THEN 'RESTORED' ELSE 'BODY_CHANGED' END AS type, CAST(1 + id % 7 AS INT) AS severity FROM pair WHERE from_id IS NOT NULL),
 a AS (SELECT DISTINCT conv_id AS id, 'https://a.example/' || CASE WHEN conv_id % 6 = 0 THEN 'Tag/x' ELSE 'story/' || conv_id END AS url, conv_id % 5 AS outlet_id FROM conversations),
 candidate AS (SELECT e.*, url, 'outlet-' || outlet_id AS outlet_slug FROM e JOIN a ON a.id = e.article_id ORDER BY severity DESC, detected_at DESC, e.id LIMIT 600),
 shown AS (SELECT * FROM candidate WHERE url NOT LIKE '%/Tag/%' ORDER BY severity DESC, detected_at DESC, id LIMIT 200),
 flagged AS (SELECT id, coalesce(type = 'DEINDEXED' AND lead(type) OVER w = 'RESTORED', false) OR coalesce(type = 'RESTORED' AND lag(type) OVER w = 'DEINDEXED', false) AS self_corrected, count(*) OVER (PARTITION BY article_id) AS article_change_count FROM e WINDOW w AS (PARTITION BY article_id ORDER BY detected_at, id)),
 copied AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'https://web.archive.org/web/' || id % 3 || '/' || id END AS archive_url FROM versions),
 noted AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'ann:first|bob:' || id WHEN id % 3 = 1 THEN 'ann:first' END AS annotations FROM e),
 listed AS (SELECT article_id, max(n_versions) AS n_versions, string_agg(v.id || ':' || coalesce(archive_url, '-'), '|' ORDER BY fetched_at, v.id) AS versions FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY article_id) AS n_versions FROM versions WINDOW w AS (PARTITION BY article_id ORDER BY fetched_at, id)) v JOIN copied USING (id) WHERE r <= 20 GROUP BY 1)"""


@query(f"""WITH {TRIAGE} SELECT s.id, s.type, s.severity, s.detected_at, s.outlet_slug, s.url, f.headline AS from_headline, g.headline AS to_headline, f.byline AS from_byline, g.byline AS to_byline, md5(f.body) AS from_body, md5(g.body) AS to_body, f.fetched_at AS from_fetched_at, cf.archive_url AS from_archive_url, cg.archive_url AS to_archive_url,
 annotations, article_change_count, n_versions, listed.versions, self_corrected, f.body IS DISTINCT FROM g.body AS differs
 FROM shown s LEFT JOIN versions f ON f.id = s.from_snapshot_id LEFT JOIN versions g ON g.id = s.to_snapshot_id LEFT JOIN copied cf ON cf.id = f.id LEFT JOIN copied cg ON cg.id = g.id JOIN flagged ON flagged.id = s.id JOIN noted ON noted.id = s.id JOIN listed ON listed.article_id = s.article_id""")
def triage_document(spark, sf_dir):
    v = t.versions(spark, sf_dir).withColumn("id", F.col("article_id") * 100 + F.col("id")).withColumn("archive_url", F.lit(None).cast("string"))
    changes = events.snapshot_pairs(v).select("id", "article_id", F.col("fetched_at").alias("detected_at"), "from_snapshot_id", F.col("id").alias("to_snapshot_id"), F.when(F.col("id") % 5 == 0, "DEINDEXED").when(F.col("id") % 5 == 1, "RESTORED").otherwise("BODY_CHANGED").alias("type"), (F.col("id") % 7 + 1).cast("int").alias("severity"))
    ids = v.select("article_id").distinct()
    tag = F.when(F.col("article_id") % 6 == 0, F.lit("Tag/x")).otherwise(F.concat(F.lit("story/"), F.col("article_id").cast("string")))
    articles = ids.select(F.col("article_id").alias("id"), (F.col("article_id") % 5).alias("outlet_id"), F.concat(F.lit("https://a.example/"), tag).alias("canonical_url"))
    outlets = spark.range(5).select(F.col("id").alias("outlet_id"), F.concat(F.lit("outlet-"), F.col("id").cast("string")).alias("slug"), F.lit("name").alias("name"))
    url = F.concat(F.lit("https://web.archive.org/web/"), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string"))
    good = v.where("id % 4 = 0").select("id", F.col("id").alias("snapshot_id"), F.lit("ok").alias("outcome"), url.alias("archive_url"), F.col("fetched_at").alias("requested_at"))
    earlier = good.withColumn("archive_url", F.lit("https://web.archive.org/old")).withColumn("requested_at", F.col("requested_at") - F.expr("INTERVAL 1 DAY"))
    failed = v.select("id", F.col("id").alias("snapshot_id"), F.lit("error").alias("outcome"), F.lit("x").alias("archive_url"), F.current_timestamp().alias("requested_at"))
    note = lambda rows, at, who, what: rows.select(F.col("id").alias("event_id"), F.lit(at).cast("timestamp").alias("written_at"), F.lit(who).alias("author"), what.alias("body"), F.lit("draft").alias("review_state"))
    notes = note(changes.where("id % 3 = 0"), "2024-02-02", "bob", F.col("id").cast("string")).union(note(changes.where("id % 3 < 2"), "2024-01-01", "ann", F.lit("first")))
    out = triage.document(changes, articles, outlets, v.drop("archive_url"), good.union(earlier).union(failed), notes, 200)
    told = F.array_join(F.transform("annotations", lambda x: F.concat(x["author"], F.lit(":"), x["body"])), "|")
    shown = F.array_join(F.transform("versions", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.coalesce(x["archive_url"], F.lit("-")))), "|")
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return out.select("id", "type", "severity", "detected_at", "outlet_slug", "url", "from_headline", "to_headline", "from_byline", "to_byline", digest("from_body"), digest("to_body"), "from_fetched_at", "from_archive_url", "to_archive_url", told.alias("annotations"), "article_change_count", "n_versions", shown.alias("versions"), "self_corrected", F.col("body_diff").isNotNull().alias("differs"))


CANDIDATES = """c AS (SELECT page_id, page_id % 20 AS outlet_id, page_id // 20 AS place, 'https://site.example/' || CASE WHEN page_id % 3 = 0 THEN 'news-2026-09-' || page_id ELSE 'map/' || page_id END AS url, CASE page_id % 6 WHEN 0 THEN 'rss' WHEN 1 THEN 'sitemap' WHEN 2 THEN 'sitemap_index' WHEN 3 THEN CASE WHEN page_id % 20 < 10 THEN 'news_sitemap' ELSE 'atom' END WHEN 4 THEN 'sitemap' END AS kind,
  CASE WHEN page_id % 4 = 0 THEN 'robots' ELSE 'guess' END AS source, CASE WHEN page_id % 3 = 0 AND page_id % 5 = 0 THEN 'https://site.example/map/' || (page_id % 20 + 20 * (page_id // 20 - 1)) END AS parent FROM pages),
 e AS (SELECT outlet_id, place, CASE WHEN page_id % 7 = 0 THEN 'https://other.example/' ELSE 'https://site.example/' END || page_id % 11 || '/' || i AS url, CASE WHEN page_id % 9 <> 4 THEN TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 50 - i AS INT)) END AS date FROM c, range(4) t(i) WHERE kind IS NOT NULL AND i < page_id % 5),
 m AS (SELECT c.*, coalesce(n, 0) AS entries, share AS on_site_share, newest, urls FROM c LEFT JOIN (SELECT outlet_id, place, count(*) AS n, round(avg(CASE WHEN url LIKE 'https://site.example/%' THEN 1 ELSE 0 END), 3) AS share, max(date) AS newest, string_agg(DISTINCT url, ' ' ORDER BY url) AS urls FROM e GROUP BY 1, 2) USING (outlet_id, place)),
 s AS (SELECT *, CASE WHEN kind <> 'sitemap_index' AND entries > 0 THEN row_number() OVER w END AS r, first_value(url) OVER w AS original FROM m WINDOW w AS (PARTITION BY outlet_id, kind <> 'sitemap_index' AND entries > 0, urls ORDER BY place)),
 b AS (SELECT *, CASE WHEN kind IS NULL THEN 'not RSS/Atom/sitemap' WHEN entries <= 0 THEN 'parsed but empty' WHEN r > 1 THEN 'same entries as ' || original WHEN on_site_share < 0.5 THEN 'only ' || CAST(on_site_share * 100 AS INT) || '% of entries on site.example'
  WHEN kind <> 'sitemap_index' AND newest < TIMESTAMP '2024-02-20' - INTERVAL 30 DAY THEN 'stale: newest entry ' || date_diff('day', newest, TIMESTAMP '2024-02-20') || ' days old' END AS bad FROM s),
 g AS (SELECT *, bool_or(bad IS NULL AND kind = 'news_sitemap') OVER (PARTITION BY outlet_id) AS news, bad IS NULL AND kind IN ('rss', 'atom', 'news_sitemap') AS feed FROM b),
 h AS (SELECT *, coalesce(feed AND parent IS NOT NULL AND regexp_matches(url, '/[^?]*(19|20)[0-9]{2}[-_/]?(0[1-9]|1[0-2])'), false) AS dated, coalesce(NOT news AND kind IN ('sitemap', 'sitemap_index') AND bad IS NULL AND newest IS NOT NULL, false) AS usable FROM g),
 k AS (SELECT *, (outlet_id, url) IN (SELECT (outlet_id, parent) FROM h WHERE dated) AS head, bool_or(usable AND source = 'robots') OVER w AS declared, min(place) FILTER (usable) OVER w AS least FROM h WINDOW w AS (PARTITION BY outlet_id)),
 f AS (SELECT *, CASE WHEN declared THEN usable AND source = 'robots' ELSE usable AND place = least END AS fallback FROM k),
 chosen AS (SELECT outlet_id, place, url, kind, entries, coalesce(head OR (feed AND NOT dated) OR fallback, false) AS selected, CASE WHEN fallback THEN 'no news sitemap; general sitemap selected' WHEN head THEN 'index of dated news sitemaps' WHEN dated THEN 'dated child; parent index selected' WHEN bad IS NOT NULL THEN bad
  WHEN NOT news AND kind IN ('sitemap', 'sitemap_index') AND newest IS NULL THEN 'no dated entries; likely sections, not articles' WHEN NOT coalesce(head OR (feed AND NOT dated) OR fallback, false) THEN 'verified, not needed' END AS reason FROM f)"""


def _candidates(spark, sf_dir):
    p = F.col("page_id")
    at = lambda c: F.concat(F.lit("https://site.example/"), c)
    c = t.read(spark, sf_dir, "pages").select("page_id", (p % 20).alias("outlet_id"), F.floor(p / 20).alias("place"), at(F.when(p % 3 == 0, F.concat(F.lit("news-2026-09-"), p.cast("string"))).otherwise(F.concat(F.lit("map/"), p.cast("string")))).alias("url"), F.lit("site.example").alias("root"), F.when(p % 4 == 0, "robots").otherwise("guess").alias("source"))
    kind = F.when(p % 6 == 0, "rss").when(p % 6 == 1, "sitemap").when(p % 6 == 2, "sitemap_index").when(p % 6 == 3, F.when(p % 20 < 10, "news_sitemap").otherwise("atom")).when(p % 6 == 4, "sitemap")
    c = c.withColumn("kind", kind).withColumn("parent", F.when((p % 3 == 0) & (p % 5 == 0), at(F.concat(F.lit("map/"), (p % 20 + 20 * (F.col("place") - 1)).cast("string")))))
    i = F.col("i")
    e = c.where("kind IS NOT NULL").select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("i")).where("i < page_id % 5")
    e = e.select("outlet_id", "place", F.concat(F.when(p % 7 == 0, "https://other.example/").otherwise("https://site.example/"), (p % 11).cast("string"), F.lit("/"), i.cast("string")).alias("url"), F.when(p % 9 != 4, F.timestamp_add("DAY", (p % 50 - i).cast("int"), F.lit("2024-01-01").cast("timestamp"))).alias("date"))
    return discovery.measured(c.drop("page_id"), e)


@query(f"WITH {CANDIDATES} SELECT * FROM chosen")
def feed_selection(spark, sf_dir):
    return discovery.selected(_candidates(spark, sf_dir), F.lit("2024-02-20").cast("timestamp")).select("outlet_id", "place", "url", "kind", "entries", "selected", "reason")


@query("""WITH x AS (SELECT user_id AS listing_id, event_id AS position, 'https://' || CASE WHEN event_id % 5 = 0 THEN 'b.example' ELSE 'www.a.example' END || CASE WHEN event_id % 2 = 0 THEN '/News/' ELSE '/map/' END || event_id AS url, CASE WHEN user_id % 3 <> 0 AND event_id % 4 <> 0 THEN ts END AS date FROM events),
 h AS (SELECT *, bool_or(date IS NOT NULL) OVER (PARTITION BY listing_id) AS dated FROM x WHERE url LIKE 'https://www.a.example/%'),
 r AS (SELECT listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY date DESC, url DESC) AS rank, url, date FROM h WHERE dated AND date >= TIMESTAMP '2024-01-02'),
 n AS (SELECT listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY position) AS rank, url, date FROM h WHERE NOT dated AND url LIKE '%/News/%')
 SELECT * FROM r WHERE rank <= 10 UNION ALL SELECT * FROM n WHERE rank <= 5""")
def sitemap_children(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    url = F.concat(F.lit("https://"), F.when(e % 5 == 0, "b.example").otherwise("www.a.example"), F.when(e % 2 == 0, "/News/").otherwise("/map/"), e.cast("string"))
    rows = t.read(spark, sf_dir, "events").select(u.alias("listing_id"), e.alias("position"), F.lit("a.example").alias("root"), url.alias("url"), F.when((u % 3 != 0) & (e % 4 != 0), F.col("ts")).alias("date"))
    return discovery.children(rows, F.lit("2024-01-02").cast("timestamp"))


@query(f"""WITH {t.JOBS}, r AS (SELECT *, CASE id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' WHEN 2 THEN 'release' END AS action FROM jobs)
 SELECT id, CASE WHEN action = 'complete' THEN 'done' WHEN action = 'fail' AND attempts + 1 >= 5 THEN 'failed' WHEN action IN ('fail', 'release') THEN 'pending' ELSE status END AS status, (attempts + CASE WHEN action IN ('complete', 'fail') THEN 1 ELSE 0 END)::BIGINT AS attempts,
 CASE WHEN action = 'fail' AND attempts + 1 < 5 THEN TIMESTAMP '1998-01-01' + to_seconds(60 * pow(2, attempts)) ELSE run_after END AS run_after, CASE WHEN action IS NULL THEN locked_at END AS locked_at, CASE WHEN action = 'fail' THEN left(repeat('e' || id, 500), 2000) END AS last_error FROM r""")
def job_transitions(spark, sf_dir):
    j = t.jobs(spark, sf_dir).withColumn("max_attempts", F.lit(5)).withColumn("locked_by", F.lit("w")).withColumn("last_error", F.lit(None).cast("string"))
    m = F.col("id") % 4
    results = j.where("id % 4 < 3").select("id", F.when(m == 0, "complete").when(m == 1, "fail").otherwise("release").alias("action"), F.lit("1998-01-01").cast("timestamp").alias("at"), F.repeat(F.concat(F.lit("e"), F.col("id").cast("string")), 500).alias("error"), F.lit(60).alias("backoff_seconds"))
    return queue.transition(j, results).select("id", "status", "attempts", "run_after", "locked_at", "last_error")


@query("""WITH alias AS (SELECT DISTINCT o_custkey AS article_id, sha256(CAST(o_orderkey // 12 AS VARCHAR)) AS url_hash FROM orders), up AS (SELECT article_id, min(oldest) AS up FROM alias JOIN (SELECT url_hash, min(article_id) AS oldest FROM alias GROUP BY 1) USING (url_hash) GROUP BY 1)
 SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN 1 WHEN up < c_custkey THEN up END AS merged_into_id FROM customer LEFT JOIN up ON article_id = c_custkey""")
def alias_merges(spark, sf_dir):
    k = F.col("c_custkey")
    articles = t.read(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 50 == 0, F.lit(1)).cast("long").alias("merged_into_id"))
    aliases = t.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("article_id"), F.sha2(F.floor(F.col("o_orderkey") / 12).cast("string"), 256).alias("url_hash")).distinct()
    return queue.merged(articles, aliases)


@query("""WITH d AS (SELECT event_id % 500 AS event_id, CASE user_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'escalated' ELSE 'maybe' END AS decision, 'r' || user_id % 7 AS reviewed_by, ts AS reviewed_at FROM events),
 l AS (SELECT * FROM d WHERE decision <> 'maybe' QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY reviewed_at DESC, reviewed_by, decision) = 1)
 SELECT x.id, decision AS review_decision, reviewed_by, reviewed_at FROM range(400) x(id) LEFT JOIN l ON event_id = id""")
def latest_reviews(spark, sf_dir):
    u = F.col("user_id") % 4
    d = t.read(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("event_id"), F.when(u == 0, "confirmed").when(u == 1, "dismissed").when(u == 2, "escalated").otherwise("maybe").alias("decision"), F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string")).alias("reviewed_by"), F.col("ts").alias("reviewed_at"))
    e = spark.range(400).select("id", F.lit(None).cast("string").alias("review_decision"), F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("timestamp").alias("reviewed_at"))
    return review.reviewed(e, d)[0]


@query(f"WITH RECURSIVE {t.EXPORT} SELECT (SELECT count(*) FROM shot) AS snapshots, (SELECT count_if(l_quantity > 25) FROM shot) AS archived")
def archive_coverage(spark, sf_dir):
    r = t.export(spark, sf_dir)
    return export.archive_coverage(r["snapshots"], r["archives"])


@query(f"WITH RECURSIVE {t.EXPORT} SELECT slug, name, language, tier FROM outlet WHERE active ORDER BY slug")
def monitored_outlets(spark, sf_dir):
    return export.monitored(t.export(spark, sf_dir)["outlets"])


@query(f"""WITH {t.ATTEMPTS} SELECT CASE WHEN outcome = 'ok' THEN CASE WHEN id % 3 = 0 THEN 'non_html' ELSE 'captured' END WHEN outcome = 'timeout' THEN 'retry_timeout' WHEN http_status IS NOT NULL THEN outcome || '_' || http_status ELSE outcome END AS label, count(*) AS n FROM attempts GROUP BY 1""")
def capture_counters(spark, sf_dir):
    label = fetching.capture_label(F.col("outcome"), F.col("http_status"), F.col("id") % 3 != 0)
    return t.attempts(spark, sf_dir).select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'BODY_CHANGED' END AS type, CASE event_id % 8 WHEN 0 THEN 'sure' WHEN 1 THEN NULL ELSE 'confirmed' END AS confidence, CAST(value AS INT) - 2 AS age, CASE WHEN event_id % 12 = 0 THEN 'no url' ELSE 'https://a.example/' || event_id END AS url, event_id % 9 AS state FROM events)
 SELECT id, unnest([CASE WHEN id <= 0 THEN 'id is positive' END, CASE WHEN type = '' THEN 'type is named' END, CASE WHEN confidence IS NULL OR confidence <> 'confirmed' THEN 'confidence is known' END, CASE WHEN age < 0 THEN 'age is not negative' END, CASE WHEN url = 'no url' THEN 'url is a URL' END,
  CASE WHEN state = 1 THEN 'annotations are signed and in a known state' END]) AS rule FROM e""".replace("SELECT id, unnest", "SELECT * FROM (SELECT id, unnest").replace(" AS rule FROM e", " AS rule FROM e) WHERE rule IS NOT NULL"))
def triage_violations(spark, sf_dir):
    e = F.col("event_id")
    note = lambda state: F.array(F.struct(F.lit("ann").alias("author"), F.lit(state).alias("review_state")))
    rows = t.read(spark, sf_dir, "events").select(
        e.alias("id"), F.when(e % 10 == 0, "").otherwise("BODY_CHANGED").alias("type"), F.col("ts").alias("detected_at"), F.when(e % 8 == 0, "sure").when(e % 8 > 1, "confirmed").alias("confidence"), F.lit(3).alias("severity"),
        (F.round("value").cast("int") - 2).alias("age_hours"), F.lit("o").alias("outlet_slug"), F.lit("O").alias("outlet_name"), F.when(e % 12 == 0, "no url").otherwise(F.concat(F.lit("https://a.example/"), e.cast("string"))).alias("url"),
        F.when(e % 9 == 1, note("secret")).when(e % 9 == 2, note("draft")).alias("annotations"), F.lit(1).alias("article_change_count"), F.lit(False).alias("self_corrected"),
    )
    return export.triage_violations(rows)

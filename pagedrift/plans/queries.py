"""Queries over the test tables, one for each operator family, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagedrift.functions import differences, fetching, text, urls
from pagedrift.operators import coverage, events, export, queue, triage
from pagedrift.plans import exports, scalars
from pagedrift.plans import standins as t
from pagedrift.sources import pages as page_source

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = text.with_hashes(t.versions(spark, sf_dir), {"headline_hash": "headline", "byline_hash": "byline", "body_hash": "body"})
    first = F.min("fetched_at").over(Window.partitionBy("article_id"))
    hashed = v.select("article_id", "id", "fetched_at", "headline_hash", "byline", "byline_hash", "body_hash", "published_at", "date_source", "final_url").withColumn("first_seen", first)
    return events.aged(events.snapshot_changes(hashed, carried=["first_seen"]))


BANDS = " + ".join(f"CAST({{age}} > {h} AS INT)" for h in fetching.SCHEDULE_HOURS)
BASE = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in events.BASE_SEVERITY.items()) + " ELSE 3 END"
TRIMMED = "trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[ ]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
CHANGES = f"""WITH {t.VERSIONS}, h AS (SELECT *, sha256({TRIMMED.format(x="headline")}) AS hh, sha256({TRIMMED.format(x="byline")}) AS bh, sha256({TRIMMED.format(x="body")}) AS th FROM versions),
 p AS (SELECT *, lag(id) OVER w AS from_id, lag(hh) OVER w AS hh0, lag(bh) OVER w AS bh0, lag(th) OVER w AS th0, lag(byline) OVER w AS byline0, lag(published_at) OVER w AS pub0, lag(date_source) OVER w AS src0, lag(final_url) OVER w AS url0,
  first_value(fetched_at) OVER w AS first_seen FROM h WINDOW w AS (PARTITION BY article_id ORDER BY fetched_at, id)),
 e AS (SELECT *, unnest([CASE WHEN hh <> hh0 THEN 'HEADLINE_CHANGED' END, CASE WHEN bh <> bh0 THEN CASE WHEN coalesce(trim(byline), '') = '' AND coalesce(trim(byline0), '') <> '' THEN 'BYLINE_REMOVED' ELSE 'BYLINE_CHANGED' END END,
  CASE WHEN th <> th0 THEN 'BODY_CHANGED' END, CASE WHEN coalesce(published_at, '') <> coalesce(pub0, '') THEN 'DATE_CHANGED' END, CASE WHEN final_url <> url0 THEN 'REDIRECTED' END]) AS type FROM p WHERE from_id IS NOT NULL),
 found AS (SELECT article_id, fetched_at AS detected_at, from_id AS from_snapshot_id, id AS to_snapshot_id, type, CASE WHEN type = 'DATE_CHANGED' AND 'trafilatura_normalised' IN (date_source, src0) THEN 'unverified' ELSE 'confirmed' END AS confidence,
  greatest(epoch_us(fetched_at) - epoch_us(first_seen), 0) / 3.6e9 AS age_hours FROM e WHERE type IS NOT NULL),
 scored AS (SELECT *, {BASE} * (1 + {BANDS.format(age="age_hours")}) AS severity FROM found)"""


@query(f"{CHANGES} SELECT * FROM scored")
def snapshot_diff(spark, sf_dir):
    return _changes(spark, sf_dir)


@query(f"{CHANGES} SELECT type, count(*) AS n, sum(severity)::BIGINT AS severity, max(severity) AS worst FROM scored GROUP BY 1")
def severity_by_type(spark, sf_dir):
    return _changes(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.sum("severity").alias("severity"), F.max("severity").alias("worst"))


@query(f"WITH {t.GONE} SELECT * FROM gone")
def gone_streaks(spark, sf_dir):
    return events.gone_events(t.attempts(spark, sf_dir))


@query(f"""WITH {t.GONE}, absent AS (SELECT article_id, detected_at FROM gone UNION ALL SELECT user_id, ts FROM events WHERE event_type = 'signup' AND event_id % 3 = 0),
 log AS (SELECT article_id, started_at AS seen, id, NULL AS gone_at FROM attempts WHERE outcome = 'ok' UNION ALL SELECT article_id, detected_at, NULL, detected_at FROM absent),
 r AS (SELECT *, last_value(gone_at IGNORE NULLS) OVER b AS since, lag(id) OVER w AS before, max(id) OVER b AS earlier FROM log WINDOW w AS (PARTITION BY article_id ORDER BY seen, id NULLS FIRST), b AS (PARTITION BY article_id ORDER BY seen, id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT article_id, NULL::BIGINT AS from_snapshot_id, id AS to_snapshot_id, seen AS detected_at, 'RESTORED' AS type, 'confirmed' AS confidence, before IS NULL AS first_restored FROM r WHERE id IS NOT NULL AND since IS NOT NULL AND earlier IS NOT NULL""")
def restored(spark, sf_dir):
    a = t.attempts(spark, sf_dir)
    delisted = t.read(spark, sf_dir, "events").where("event_type = 'signup' AND event_id % 3 = 0").select(F.col("user_id").alias("article_id"), F.col("ts").alias("detected_at"))
    absences = events.gone_events(a).select("article_id", "detected_at").union(delisted)
    return events.restored_events(a.where("outcome = 'ok'").select("article_id", F.col("started_at").alias("fetched_at"), "id"), absences)


@query(f"""WITH {t.ENTRIES}, f AS (SELECT page_id AS article_id, bool_or(kind = 'rss' AND age = 2) AS pr, bool_or(kind = 'sitemap' AND age = 2) AS ps, bool_or(kind = 'rss' AND age = 1) AS cr, bool_or(kind = 'sitemap' AND age = 1) AS cs
  FROM (SELECT DISTINCT a.page_id, e.kind, e.age FROM entries e JOIN (SELECT page_id, sha256(url) AS url_hash, regexp_extract(url, '^https?://[^/]*\\.(\\w+)/', 1) AS outlet_id FROM pages) a USING (outlet_id, url_hash)) GROUP BY 1)
 SELECT article_id, CASE WHEN NOT cr AND NOT cs THEN 'DEINDEXED' ELSE 'UNPUBLISHED' END AS type, 'unverified' AS confidence FROM f WHERE (pr OR ps) AND ((NOT cr AND NOT cs) OR (ps AND NOT cs AND cr))""")
def listing_transition(spark, sf_dir):
    e = t.entries(spark, sf_dir)
    p = t.read(spark, sf_dir, "pages").select(F.col("page_id").alias("article_id"), F.regexp_extract("url", r"^https?://[^/]*\.(\w+)/", 1).alias("outlet_id"), F.sha2("url", 256).alias("url_hash"))
    return events.presence_changes(e, p)


@query("""WITH e AS (SELECT user_id AS article_id, event_id AS id, CASE event_type WHEN 'error' THEN 'DEINDEXED' WHEN 'signup' THEN 'UNPUBLISHED' WHEN 'view' THEN 'RESTORED' ELSE 'BODY_CHANGED' END AS type, ts AS detected_at FROM events),
 n AS (SELECT *, lead(type) OVER w AS next, lag(type) OVER w AS prev FROM e WINDOW w AS (PARTITION BY article_id ORDER BY detected_at, id))
 SELECT article_id, id, type, detected_at, coalesce(type IN ('DEINDEXED', 'UNPUBLISHED') AND next = 'RESTORED', false) OR coalesce(type = 'RESTORED' AND prev IN ('DEINDEXED', 'UNPUBLISHED'), false) AS self_corrected FROM n""")
def self_corrected(spark, sf_dir):
    kind = F.col("event_type")
    e = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("article_id"), F.col("event_id").alias("id"), F.when(kind == "error", "DEINDEXED").when(kind == "signup", "UNPUBLISHED").when(kind == "view", "RESTORED").otherwise("BODY_CHANGED").alias("type"), F.col("ts").alias("detected_at"))
    return events.self_corrected(e)


@query(f"""WITH {t.ATTEMPTS} SELECT outcome, http_status, count(*) AS n, count(DISTINCT article_id) AS articles, coalesce(outcome IN ('timeout', 'conn_error', 'rate_limited') OR (outcome = 'http_error' AND http_status >= 500), false) AS retryable FROM attempts GROUP BY 1, 2""")
def attempt_outcomes(spark, sf_dir):
    a = t.attempts(spark, sf_dir).groupBy("outcome", "http_status").agg(F.count("*").alias("n"), F.countDistinct("article_id").alias("articles"))
    return a.withColumn("retryable", fetching.retryable(F.col("outcome"), F.col("http_status")))


@query("""WITH s AS (SELECT source AS outlet_id, n_chars AS body_length, doc_id % 17 = 0 AS failed FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 50),
 m AS (SELECT *, median(body_length) OVER (PARTITION BY outlet_id) AS med FROM s),
 g AS (SELECT outlet_id, count(*) AS sample, max(med) AS median_length, count_if(body_length < greatest(200.0, 0.3 * med)) AS short, count_if(med <> 0 AND body_length > 3 * med) AS long, count_if(body_length = 0) AS empty, count_if(failed) AS errors FROM m GROUP BY 1)
 SELECT *, CASE WHEN (short + errors) / sample < 0.1 THEN 'ok' WHEN (short + errors) / sample < 0.4 THEN 'degraded' ELSE 'failing' END AS health FROM g""")
def extraction_health(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").select(F.col("source").alias("outlet_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("fetched_at"), F.col("n_chars").alias("body_length"), (F.col("doc_id") % 17 == 0).alias("failed"))
    return coverage.extraction_health(d)


FIGURES = f"""WITH {t.OUTLETS}, g AS (SELECT grouping(language) AS gl, grouping(tier) AS gt, language, tier, count(*) AS outlets, count_if(snapshots > 0) AS contributing, sum(discovered)::BIGINT AS discovered, sum(attempted)::BIGINT AS attempted, sum(captured)::BIGINT AS captured, sum(snapshots)::BIGINT AS snapshots, sum(archived)::BIGINT AS archived
 FROM outlets GROUP BY GROUPING SETS ((), (language), (tier))),
 figures AS (SELECT CASE WHEN gl + gt = 2 THEN 'all' WHEN gl = 0 THEN 'language' ELSE 'tier' END AS grp, CASE WHEN gl + gt = 2 THEN 'all' WHEN gl = 0 THEN language ELSE tier END AS key, outlets, contributing, discovered, attempted, captured, snapshots, archived FROM g)"""


RATES = "CASE WHEN attempted > 0 THEN round_even(captured / attempted, 4) END AS capture_rate, CASE WHEN snapshots > 0 THEN round_even(archived / snapshots, 4) END AS archive_rate"


@query(f"{FIGURES} SELECT *, {RATES} FROM figures")
def coverage_groups(spark, sf_dir):
    return coverage.group_figures(t.outlets(spark, sf_dir))


HELD = ["contributing", "discovered", "attempted", "captured", "snapshots", "archived", "capture_rate", "archive_rate"]


@query(f"{FIGURES}, rated AS (SELECT *, {RATES} FROM figures) SELECT grp, key, outlets, " + ", ".join(f"CASE WHEN contributing >= 3 THEN {c} END AS {c}" for c in HELD) + ", contributing < 3 AS suppressed, CASE WHEN contributing < 3 THEN 'small_group' END AS reason FROM rated")
def small_group_suppression(spark, sf_dir):
    return coverage.withhold_small(coverage.group_figures(t.outlets(spark, sf_dir)), HELD)


@query(f"WITH RECURSIVE {t.OUTLETS.replace('outlets AS', 'figures AS')}, {t.SUPPRESSION} SELECT grp, key, sized.n AS outlets, reason IS NOT NULL AS suppressed, reason FROM plan JOIN sized USING (place, grp, key)")
def complementary_suppression(spark, sf_dir):
    rows = t.outlets(spark, sf_dir)
    groups = export.group_keys(spark, t.FAMILIES).select("grp", "key").join(export.by_group(rows).groupBy("grp", "key").agg(F.count("*").alias("n")), ["grp", "key"], "left")
    return export.withheld(groups.select("grp", "key", F.coalesce("n", F.lit(0)).alias("outlets")), export.suppression(rows, t.FAMILIES), [])


@query("""WITH d AS (SELECT CAST(o_orderdate + INTERVAL 6 HOUR AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
 SELECT CAST(x.day AS DATE) AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM d) x LEFT JOIN d ON d.day = CAST(x.day AS DATE)""")
def capture_volume_daily(spark, sf_dir):
    return coverage.daily(t.read(spark, sf_dir, "orders"), "o_orderdate")


@query("""SELECT lang, source, count(*) AS total, count_if(n_chars >= 2000) AS long_total FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 GROUP BY 1, 2""")
def event_summary_gate(spark, sf_dir):
    labels = t.read(spark, sf_dir, "labels")
    e = t.read(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars", F.lit("confirmed").alias("confidence"), F.when(F.col("quality") == 1, "confirmed").alias("review_decision"))
    signed = labels.select(F.col("doc_id").alias("event_id"), F.when(F.col("toxic") == 0, "published").otherwise("draft").alias("review_state"))
    return coverage.published(e, signed).groupBy("lang", "source").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") >= 2000).alias("long_total"))


@query("""WITH c AS (SELECT event_id AS id, 'https://a.example/' || CASE WHEN event_id % 7 = 0 THEN 'Tag/x' ELSE 'story/' || CAST(event_id AS VARCHAR) END AS url, CAST(floor(value) AS BIGINT) AS severity, ts AS detected_at FROM events ORDER BY severity DESC, detected_at DESC, id LIMIT 6000)
 SELECT * FROM c WHERE url NOT LIKE '%/Tag/%' ORDER BY severity DESC, detected_at DESC, id LIMIT 2000""")
def triage_top(spark, sf_dir):
    tag = F.when(F.col("event_id") % 7 == 0, F.lit("Tag/x")).otherwise(F.concat(F.lit("story/"), F.col("event_id").cast("string")))
    return triage.top(t.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("https://a.example/"), tag).alias("url"), F.floor("value").alias("severity"), F.col("ts").alias("detected_at")))


@query(f"""WITH {t.VERSIONS}, n AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY article_id) AS n_versions FROM versions WINDOW w AS (PARTITION BY article_id ORDER BY fetched_at, id))
 SELECT article_id, max(n_versions) AS n_versions, string_agg(CAST(id AS VARCHAR) || ':' || coalesce(headline, ''), '|' ORDER BY fetched_at, id) AS shown FROM n WHERE r <= 20 GROUP BY 1""")
def article_versions_nested(spark, sf_dir):
    v = triage.oldest_versions(t.versions(spark, sf_dir))
    return v.select("article_id", "n_versions", F.array_join(F.transform("versions", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.coalesce(x["headline"], F.lit("")))), "|").alias("shown"))


@query("""SELECT l_suppkey AS outlet_id, l_returnflag AS source_url, l_shipdate AS fetched_at, l_orderkey * 10 + l_linenumber AS id, row_number() OVER w AS age FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) QUALIFY age <= 2""")
def latest_two_per_source(spark, sf_dir):
    return events.latest_listings(t.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("outlet_id"), F.col("l_returnflag").alias("source_url"), F.col("l_shipdate").alias("fetched_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")))


@query(f"WITH {t.JOBS} SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey NOT IN (SELECT ref_id FROM jobs WHERE kind = 'recheck_article')")
def backfill_anti(spark, sf_dir):
    a = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("captured").alias("status"), F.when(F.col("c_custkey") % 10 == 0, F.lit(0)).cast("long").alias("merged_into_id"))
    return queue.without_recheck(a, t.jobs(spark, sf_dir)).select("id")


@query("""WITH RECURSIVE m AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey - c_custkey % 3 - 1 END AS up FROM customer), a AS (SELECT id, CASE WHEN up >= 1 THEN up END AS up FROM m),
 r AS (SELECT id, id AS node FROM a UNION ALL SELECT r.id, a.up FROM r JOIN a ON a.id = r.node WHERE a.up IS NOT NULL)
 SELECT id, min(node) AS root FROM r GROUP BY 1""")
def alias_roots(spark, sf_dir):
    c = F.col("c_custkey")
    up = F.when((c % 5 != 0) & (c - c % 3 - 1 >= 1), c - c % 3 - 1)
    return queue.roots(t.read(spark, sf_dir, "customer").select(c.alias("id"), up.alias("merged_into_id")))


@query(f"""WITH {t.JOBS} SELECT id, kind, ref_id, status, run_after FROM jobs WHERE (status = 'pending' AND run_after <= TIMESTAMP '1998-01-01') OR (status = 'running' AND locked_at < TIMESTAMP '1998-01-01' - INTERVAL 1 HOUR) ORDER BY run_after, id LIMIT 500""")
def due_jobs(spark, sf_dir):
    return queue.due(t.jobs(spark, sf_dir), F.lit("1998-01-01 00:00:00").cast("timestamp"), 500).select("id", "kind", "ref_id", "status", "run_after")


@query(f"""WITH {t.JOBS} SELECT attempts, CASE WHEN attempts >= 5 THEN 'parked' ELSE 'pending' END AS status, CASE WHEN attempts < 5 THEN 60.0 * pow(2.0, attempts - 1) END AS delay, count(*) AS n FROM jobs GROUP BY 1, 2, 3""")
def job_backoff(spark, sf_dir):
    status, delay = fetching.queue_state(F.col("attempts"), F.lit(5), 60.0)
    return t.jobs(spark, sf_dir).select("attempts", status.alias("status"), delay.alias("delay")).groupBy("attempts", "status", "delay").agg(F.count("*").alias("n"))


CANONICAL = r"""u AS (SELECT page_id, url, split_part(url, '#', 1) AS bare FROM pages), q AS (SELECT page_id, url, split_part(bare, '?', 1) AS base, list_sort(list_filter(string_split(CASE WHEN strpos(bare, '?') > 0 THEN split_part(bare, '?', 2) ELSE '' END, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_|pk_|mtm_|hsa_|fbclid=|gclid=|ref_src=)'))) AS ps FROM u),
 c AS (SELECT page_id, url, base || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS canonical FROM q)"""


@query(f"WITH {CANONICAL} SELECT page_id, canonical FROM c")
def url_canonical(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query(f"WITH {CANONICAL} SELECT sha256(canonical) AS url_hash, count(*) AS n, min(page_id) AS first_page FROM c GROUP BY 1")
def url_hash(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", urls.url_hash(urls.canonical(F.col("url"))).alias("url_hash")).groupBy("url_hash").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("""SELECT page_id, lower(split_part(regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1), '/', 2)) IN ('tag', 'tags', 'topic', 'topics', 'category', 'categories', 'author', 'authors', 'search', 'page', 'pages', 'archive', 'archives', 'articlelist') AS lists_others FROM pages""")
def non_article_paths(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", urls.lists_others(F.col("url")).alias("lists_others"))


@query("""WITH h AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/:?#]*)', 1), '^www\\.', '') AS host FROM pages) SELECT host, host = 'example.com' OR host LIKE '%.example.com' AS on_site, count(*) AS n FROM h GROUP BY 1, 2""")
def same_site(spark, sf_dir):
    u = F.col("url")
    return t.read(spark, sf_dir, "pages").select(urls.site(urls.host(u)).alias("host"), urls.same_site(u, F.lit("example.com")).alias("on_site")).groupBy("host", "on_site").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, sha256({TRIMMED.format(x='text')}) AS text_hash FROM documents")
def text_normal_hash(spark, sf_dir):
    return text.with_hashes(t.spread(t.read(spark, sf_dir, "documents").select("doc_id", "text")), {"text_hash": "text"}).select("doc_id", "text_hash")


@query(f"SELECT sha256({TRIMMED.format(x='text')}) AS text_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_bodies(spark, sf_dir):
    return text_normal_hash(spark, sf_dir).groupBy("text_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""SELECT page_id, regexp_extract(html, '<html[^>]*lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def html_title_lang(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", page_source.html_language(F.col("html")).alias("lang"), page_source.html_title(F.col("html")).alias("title"))


@query("""WITH a AS (SELECT event_type AS host, event_id AS id, ts AS started_at, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 1e6 AS gap FROM events) SELECT * FROM a WHERE gap < 120.0""")
def rate_limit_audit(spark, sf_dir):
    return queue.spacing(t.read(spark, sf_dir, "events").select(F.col("event_type").alias("host"), F.col("event_id").alias("id"), F.col("ts").alias("started_at")), 120.0)


def _pairs(spark, sf_dir):
    w = Window.partitionBy("article_id").orderBy("id")
    return t.versions(spark, sf_dir).select("article_id", "id", F.lag("body").over(w).alias("was"), "body").where("was IS NOT NULL")


@query()
def body_diff_snippet(spark, sf_dir):
    return _pairs(spark, sf_dir).select("article_id", "id", differences.change_snippet(F.col("was"), F.col("body")).alias("snippet"))


@query()
def word_diff(spark, sf_dir):
    return _pairs(spark, sf_dir).select("article_id", "id", differences.word_diff(F.col("was"), F.col("body")).alias("changes"))


TAG_FREE = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))"


@query(f"""WITH f AS (SELECT page_id, regexp_extract(html, '<h1[^>]*>((?s:.*?))</h1>', 1) AS h, regexp_extract(html, '<title[^>]*>((?s:.*?))</title>', 1) AS t, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang FROM pages),
 g AS (SELECT page_id, {TAG_FREE.format(x="h")} AS h, {TAG_FREE.format(x="t")} AS t, lang FROM f)
 SELECT page_id, CASE WHEN h <> '' THEN h WHEN t <> '' THEN t END AS headline, CASE WHEN h <> '' THEN 'h1' WHEN t <> '' THEN 'title' END AS headline_source, CASE WHEN lang <> '' THEN lang END AS lang, CASE WHEN t <> '' THEN t END AS title FROM g""")
def page_fields(spark, sf_dir):
    told = t.spread(t.read(spark, sf_dir, "pages")).select("page_id", page_source.page_fields(F.col("html")).alias("f"))
    return told.select("page_id", "f.headline", "f.headline_source", "f.lang", "f.title")


@query("""SELECT (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS step, [1, 6, 24, 72, 168, 720, 2160, 8760][(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT] AS after_hours, event_id FROM events""")
def recheck_schedule(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.read(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) - 1).alias("step"))
    return e.select("step", fetching.recheck_after_hours(F.col("step")).alias("after_hours"), "event_id")


@query("""WITH k AS (SELECT DISTINCT sha256(url) AS url_hash FROM pages WHERE page_id % 4 = 0), e AS (SELECT page_id, url, sha256(url) AS url_hash, regexp_replace(regexp_extract(url, '^https?://([^/:?#]*)', 1), '^www\\.', '') AS host, page_id % 3 AS m FROM pages)
 SELECT CASE WHEN NOT (host = 'example.com' OR host LIKE '%.example.com') THEN 'off_site' WHEN m = 1 THEN 'outside_window' WHEN k.url_hash IS NOT NULL THEN 'known' ELSE 'new' END AS label, count(*) AS n FROM e LEFT JOIN k USING (url_hash) GROUP BY 1""")
def ingest_counters(spark, sf_dir):
    p = t.read(spark, sf_dir, "pages")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    m = F.col("page_id") % 3
    e = p.select("url", F.sha2("url", 256).alias("url_hash"), F.lit("example.com").alias("root"), F.when(m == 2, "rss").otherwise("sitemap").alias("kind"), F.when(m == 0, start).alias("date"))
    known = p.where("page_id % 4 = 0").select(F.sha2("url", 256).alias("url_hash"))
    return triage.ingested(e, known, start).groupBy("label").agg(F.count("*").alias("n"))


QUERIES |= exports.QUERIES | scalars.QUERIES
SQL |= exports.SQL | scalars.SQL

"""Queries of scalar functions, sources and queue views over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagedrift.functions import differences, display, fetching, urls
from pagedrift.operators import queue, triage
from pagedrift.plans import standins as t
from pagedrift.sources import documents, listings, records

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH x AS (SELECT DISTINCT l_discount AS share FROM lineitem UNION SELECT DISTINCT l_quantity / 100 FROM lineitem) SELECT share, CASE WHEN share > 0 AND share < 0.1::DOUBLE THEN printf('%.1f', share * 100) ELSE printf('%.0f', share * 100) END || '%' AS label FROM x""")
def percent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = t.read(spark, sf_dir, "lineitem")
    shares = line.select(F.col("l_discount").alias("share")).union(line.select(F.col("l_quantity") / 100)).distinct()
    return shares.withColumn("label", display.percent(F.col("share")))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1), m AS (SELECT *, max(n) OVER () AS most FROM d)
 SELECT day, n, round(2.2 + 4.6 * sqrt(n / most), 6) AS radius, CASE WHEN n <= 10 THEN greatest(1.0, floor(n + 0.5)) ELSE floor(n / pow(10.0, floor(log10(n))) + 0.5) * pow(10.0, floor(log10(n))) END AS nice FROM m""")
def day_marks(spark, sf_dir):
    days = t.read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    most = F.broadcast(days.agg(F.max("n").alias("most")))  # one row
    return days.crossJoin(most).select("day", "n", F.round(display.radius(F.col("n"), F.col("most")), 6).alias("radius"), display.nice(F.col("n")).alias("nice"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://web.archive.org/web/' || (20240101000000 + page_id) || '/' || url END AS copy, CASE WHEN page_id % 4 = 0 THEN 'spn2-' || lower(printf('%020x', page_id)) END AS job, CASE WHEN page_id % 5 < 2 THEN 'rate_limited' ELSE 'error' END AS failure FROM pages""")
def archive_answers(spark, sf_dir):
    p = F.col("page_id")
    rows = t.read(spark, sf_dir, "pages").select(
        "page_id",
        F.when(p % 3 == 0, F.concat(F.lit("/web/"), (p + 20240101000000).cast("string"), F.lit("/"), F.col("url"))).when(p % 3 == 1, F.concat(F.lit("/save/"), F.col("url"))).alias("location"),
        F.concat(F.lit("job "), F.when(p % 4 == 0, F.format_string("spn2-%020x", p)).otherwise("spn2-none"), F.lit(" queued")).alias("answer"),
        F.concat(F.lit("Error: "), F.when(p % 5 == 0, "Too-Many requests").when(p % 5 == 1, "user session-limit").otherwise("not found")).alias("error"),
    )
    return rows.select("page_id", display.archive_url(F.col("location")).alias("copy"), display.archive_job(F.col("answer")).alias("job"), display.archive_failure(F.col("error")).alias("failure"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate - INTERVAL 6 HOUR WHEN 2 THEN o_orderdate + INTERVAL 5 HOUR WHEN 3 THEN o_orderdate WHEN 4 THEN date_trunc('day', o_orderdate) WHEN 5 THEN o_orderdate - INTERVAL 330 MINUTE WHEN 6 THEN date_trunc('minute', o_orderdate) END AS parsed FROM orders""")
def parsed_dates(spark, sf_dir):
    k, d = F.col("o_orderkey") % 8, F.col("o_orderdate")
    form = lambda f: F.date_format(d, f)
    text = F.when(k == 0, F.concat(form("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(k == 1, F.concat(form("d MMM yyyy HH:mm:ss"), F.lit(" +0600"))).when(k == 2, F.concat(form("EEEE, dd-MMM-yy HH:mm:ss"), F.lit(" EST")))
    text = text.when(k == 3, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 4, form("yyyyMMdd")).when(k == 5, form("yyyy-MM-dd HH:mm:ss'+05:30'")).when(k == 6, form("dd MMMM yyyy HH:mm")).otherwise(form("'on' yyyy"))
    return t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fetching.parsed_date(text).alias("parsed"))


@query("""WITH x AS (SELECT event_id AS id, [200, 204, 301, 403, 404, 429, 500, 503][event_id % 8 + 1] AS status, event_id % 3 = 0 AS cloudflare, event_id % 5 = 0 AS marked, event_id % 31 = 0 AS challenged FROM events),
 c AS (SELECT *, CASE WHEN challenged OR (status IN (403, 429, 503) AND cloudflare AND marked) THEN 'cf_challenge' WHEN status = 429 THEN 'rate_limited' WHEN status BETWEEN 200 AND 299 THEN 'ok' ELSE 'http_error' END AS outcome FROM x)
 SELECT id, outcome, outcome = 'rate_limited' OR (outcome = 'http_error' AND status >= 500) AS again, CAST(greatest(2.0 * pow(2, id % 4), least(coalesce(CASE WHEN id % 2 = 0 THEN id % 700 END, 0), 300)) AS DOUBLE) AS delay, id % 6 < 4 AS html FROM c""")
def fetch_outcomes(spark, sf_dir):
    i = F.col("id")
    rows = t.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    status = F.get(F.array(*map(F.lit, (200, 204, 301, 403, 404, 429, 500, 503))), (i % 8).cast("int"))
    body = F.when(i % 5 == 0, "<html><title>Just a moment...</title>").otherwise("<html>plain")
    rows = rows.withColumn("status", status).withColumn("outcome", fetching.outcome(F.col("status"), F.when(i % 31 == 0, "Challenge"), F.when(i % 3 == 0, "Cloudflare").otherwise("nginx"), body))
    kind = F.when(i % 6 == 0, "text/html; charset=utf-8").when(i % 6 == 1, "application/xhtml+xml").when(i % 6 == 4, "image/png").when(i % 6 == 5, "application/json")
    page = F.when(i % 2 == 0, "  <!DOCTYPE html><p>").otherwise("<HTML>")
    return rows.select("id", "outcome", fetching.retryable(F.col("outcome"), F.col("status")).alias("again"), fetching.retry_delay(i % 4 + 1, F.when(i % 2 == 0, i % 700)).alias("delay"), fetching.is_html(kind, page).alias("html"))


@query(f"""WITH {t.VERSIONS}, p AS (SELECT article_id, id, headline, byline, published_at, final_url, lag(headline) OVER w AS h0, lag(byline) OVER w AS b0, lag(published_at) OVER w AS p0, lag(final_url) OVER w AS u0, lag(id) OVER w AS before FROM versions WINDOW w AS (PARTITION BY article_id ORDER BY fetched_at, id))
 SELECT article_id, id, CASE id % 6 WHEN 0 THEN coalesce(h0, '-') || '>' || coalesce(headline, '-') WHEN 1 THEN coalesce(b0, '-') || '>' || coalesce(byline, '-') WHEN 2 THEN coalesce(p0, '-') || '>' || coalesce(published_at, '-') WHEN 3 THEN u0 || '>' || final_url WHEN 4 THEN 'diff' ELSE '' END AS shown FROM p WHERE before IS NOT NULL""")
def changed_fields(spark, sf_dir):
    from_ = {c: F.lag(c).over(_in_order()) for c in ("headline", "byline", "published_at", "final_url", "id")}
    v = t.versions(spark, sf_dir).select("*", *[c.alias(f"was_{n}") for n, c in from_.items()]).where("was_id IS NOT NULL")
    e = F.struct(*[F.col(f"was_{n}").alias(f"from_{n}") for n in from_ if n != "id"], *[F.col(n).alias(f"to_{n}") for n in from_ if n != "id"], F.lit("diff").alias("body_diff"))
    kind = F.get(F.array(*map(F.lit, ("HEADLINE_CHANGED", "BYLINE_REMOVED", "DATE_CHANGED", "REDIRECTED", "BODY_CHANGED", "RESTORED"))), (F.col("id") % 6).cast("int"))
    told = v.withColumn("e", e).withColumn("c", display.changed_fields(kind))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return told.select("article_id", "id", F.array_join(F.transform("c", lambda x: F.coalesce(x["diff"], F.concat(dash(x["before"]), F.lit(">"), dash(x["after"])))), "|").alias("shown"))


def _in_order():
    return Window.partitionBy("article_id").orderBy("fetched_at", "id")


@query("""SELECT event_id AS id, strftime(ts + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M') AS shown FROM events""")
def local_times(spark, sf_dir):
    return t.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), display.local_time(F.col("ts")).alias("shown"))


@query("""WITH b AS (SELECT doc_id, left(text, 500) AS a FROM documents), c AS (SELECT doc_id, CASE WHEN length(a) > 60 THEN '…' ELSE '' END || right(a, 60) AS shown FROM b) SELECT doc_id, '- ' || shown || chr(10) || '+ ' || shown || '@#added' AS snippet FROM c""")
def appended_snippets(spark, sf_dir):
    head = F.substring("text", 1, 500)
    d = t.spread(t.read(spark, sf_dir, "documents"))
    return d.select("doc_id", differences.change_snippet(head, F.concat(head, F.lit("@#added"))).alias("snippet"))


@query("""WITH b AS (SELECT doc_id, rtrim(left(text, 300), ' ' || chr(10)) AS a FROM documents) SELECT doc_id, CASE WHEN a = '' THEN '@#new words:ins' ELSE a || ':same|' || ' @#new words' || ':ins' END AS changes FROM b""")
def appended_words(spark, sf_dir):
    head = F.rtrim(F.substring("text", 1, 300), F.lit(" \n"))
    after = F.when(head == "", F.lit("@#new words")).otherwise(F.concat(head, F.lit(" @#new words")))
    told = t.spread(t.read(spark, sf_dir, "documents")).select("doc_id", differences.word_diff(head, after).alias("c"))
    return told.select("doc_id", F.array_join(F.transform("c", lambda x: F.concat(x["text"], F.lit(":"), x["tag"])), "|").alias("changes"))


@query("""SELECT page_id, url NOT LIKE 'https://%/%-%' AS allowed FROM (SELECT page_id, regexp_replace('https://a.example/' || CASE WHEN page_id % 3 = 0 THEN 'private-' ELSE 'open' END || page_id, 'x', 'x') AS url FROM pages)""")
def robots_allowed(spark, sf_dir):
    p = F.col("page_id")
    url = F.concat(F.lit("https://a.example/"), F.when(p % 3 == 0, "private-").otherwise("open"), p.cast("string"))
    rows = t.read(spark, sf_dir, "pages").select("page_id", F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /private-").alias("body"), F.lit("bot").alias("agent"), url.alias("url"))
    return documents.allowed(rows).select("page_id", "allowed")


@query(f"""WITH {t.JOBS}, c AS (SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 'recheck_article' ELSE 'fetch_article' END AS kind, l_partkey AS ref_id FROM lineitem) SELECT kind, ref_id FROM c WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.kind = c.kind AND j.ref_id = c.ref_id AND status IN ('pending', 'running'))""")
def enqueued_jobs(spark, sf_dir):
    p = F.col("l_partkey")
    c = t.read(spark, sf_dir, "lineitem").select(F.when(p % 2 == 0, "recheck_article").otherwise("fetch_article").alias("kind"), p.alias("ref_id"))
    return queue.enqueue(c, t.jobs(spark, sf_dir))


@query("""WITH k AS (SELECT sha256(CAST(o_custkey AS VARCHAR)) AS url_hash, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1), s AS (SELECT sha256(CAST(l_suppkey AS VARCHAR)) AS url_hash, l_shipdate AS at_time FROM lineitem)
 SELECT url_hash, min(a) AS first_seen, max(b) AS last_seen FROM (SELECT url_hash, a, b FROM k UNION ALL SELECT url_hash, at_time, at_time FROM s) GROUP BY 1""")
def first_and_last_seen(spark, sf_dir):
    h = lambda c: F.sha2(F.col(c).cast("string"), 256).alias("url_hash")
    known = t.read(spark, sf_dir, "orders").groupBy(h("o_custkey")).agg(F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))
    return queue.upsert_seen(known, t.read(spark, sf_dir, "lineitem").select(h("l_suppkey"), F.col("l_shipdate").alias("at")))


@query("""WITH o AS (SELECT 'c' || c_custkey AS slug, c_name AS name, abs(c_acctbal) / 1000 AS rate FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT 'c' || c_custkey AS slug, upper(c_name) AS name, CASE WHEN c_custkey % 4 <> 0 THEN abs(c_acctbal) / 2000 END AS rate FROM customer WHERE c_custkey % 2 = 0)
 SELECT slug, coalesce(n.name, o.name) AS name, greatest(coalesce(n.rate, o.rate, 2.0), 2.0) AS rate, n.slug IS NOT NULL AS active FROM o FULL JOIN n USING (slug)""")
def synced_outlets(spark, sf_dir):
    c = t.read(spark, sf_dir, "customer").withColumn("slug", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    old = c.where("c_custkey % 3 <> 0").select("slug", F.col("c_name").alias("name"), (F.abs("c_acctbal") / 1000).alias("rate"))
    new = c.where("c_custkey % 2 = 0").select("slug", F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.abs("c_acctbal") / 2000).alias("rate"))
    return queue.sync(new, old)


@query("""SELECT l_suppkey AS article_id, l_orderkey * 1000000000 + l_partkey * 10 + l_linenumber AS id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY l_shipdate, l_orderkey * 1000000000 + l_partkey * 10 + l_linenumber) = 1""")
def kept_pages(spark, sf_dir):
    line = t.read(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    return triage.kept_pages(line.select(F.col("l_suppkey").alias("article_id"), key.alias("id"), F.col("l_shipdate").alias("fetched_at"), F.col("l_quantity").alias("body_hash"))).select("article_id", "id")


@query("""SELECT sha256(text) AS digest, octet_length(encode(text))::INT AS size FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)""")
def distinct_blobs(spark, sf_dir):
    return documents.blobs(t.read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("text").cast("binary").alias("content"))).select("digest", "size")


@query("""SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' WHEN 2 THEN 'news_sitemap' END AS kind, i::INT AS position, url || CASE WHEN i = 1 THEN '?b' ELSE '' END AS url, CASE WHEN page_id % 4 <> 2 OR i = 0 THEN 'T' || page_id END AS title FROM pages, range(2) t(i) WHERE page_id % 4 < 3""")
def parsed_listings(spark, sf_dir):
    p = F.col("page_id")
    esc = F.regexp_replace("url", "&", "&amp;")
    title = lambda tag: F.concat(F.lit(f"<{tag}>T"), p.cast("string"), F.lit(f"</{tag.split(' ')[0]}>"))
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    rss = say('<!DOCTYPE rss [<!ENTITY x "y">]><rss><channel><item><link> ', esc, " </link>", title("title"), "</item><item><guid>", esc, "?b</guid>", title("title"), "</item><item><title>none</title></item></channel></rss>")
    atom = say('<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="self" href="s"/><link href="', esc, '"/>', title("title"), '</entry><entry><link rel="alternate" href="', esc, '?b"/>', title("title"), "</entry></feed>")
    news = say('<urlset xmlns:n="http://www.google.com/schemas/sitemap-news/0.9"><url><loc>', esc, "</loc><n:news>", title("n:title"), "</n:news></url><url><loc>", esc, "?b</loc></url></urlset>")
    content = F.when(p % 4 == 0, rss).when(p % 4 == 1, atom).when(p % 4 == 2, news).otherwise("<html><p>no listing</p></html>")
    rows = t.read(spark, sf_dir, "pages").select(p.alias("id"), content.cast("binary").alias("content"))
    return listings.entries(rows).select("id", "kind", "position", "url", "title")


@query("""SELECT 'o' || event_id % 7 AS outlet_id, event_id AS article_id, i::INT + 1 AS attempt, CASE WHEN i < event_id % 3 THEN 'timeout' ELSE 'ok' END AS outcome FROM events, range(3) t(i) WHERE i <= event_id % 3 UNION ALL SELECT 'o' || event_id % 7, event_id, 1, 'robots_blocked' FROM events WHERE event_id % 11 = 0""")
def attempt_records(spark, sf_dir):
    e = F.col("event_id")
    base = [F.concat(F.lit("o"), (e % 7).cast("string")).alias("outlet_id"), e.alias("article_id"), F.lit("article").alias("kind"), F.lit("v").alias("vantage")]
    tries = F.transform(F.sequence(F.lit(0), (e % 3).cast("int")), lambda i: F.struct(F.lit("u").alias("url"), F.col("ts").alias("started_at"), F.when(i < e % 3, "timeout").otherwise("ok").alias("outcome"), F.lit(None).cast("int").alias("http_status")))
    rows = t.read(spark, sf_dir, "events")
    made = records.attempts(rows.select(*base, tries.alias("tries")))
    blocked = records.declined(rows.select(*base, F.lit("u").alias("url"), F.col("ts").alias("at"), (e % 11 != 0).alias("allowed")))
    columns = ["outlet_id", "article_id", "attempt", "outcome"]
    return made.select(*columns).union(blocked.select(*columns))


@query("""SELECT page_id, CASE WHEN path = '' THEN '/' ELSE path END AS pathname, sha256(url) AS url_hash FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def pathnames(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", urls.pathname(F.col("url")).alias("pathname"), urls.url_hash(F.col("url")).alias("url_hash"))


@query(f"WITH {t.JOBS} SELECT DISTINCT 'c' || ref_id AS slug FROM jobs WHERE ref_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def unknown_slugs(spark, sf_dir):
    slug = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("slug")
    return queue.unknown(t.jobs(spark, sf_dir).select(slug("ref_id")), t.read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(slug("c_custkey")))

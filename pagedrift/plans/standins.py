"""The engine's relations, made from the test tables, for Spark and, under the same names, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = "TIMESTAMP '2024-01-01 00:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are fewer, as small tables of one row group are; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as versions of an article, a day apart."""
    return spread(read(spark, sf_dir, "conversations")).select(
        F.col("conv_id").alias("article_id"),
        F.col("turn").alias("id"),
        F.expr(f"timestampadd(HOUR, CAST(turn * 30 AS INT), {START})").alias("fetched_at"),
        F.split("text", "\n")[0].alias("headline"),
        F.when(F.col("turn") % 3 != 2, F.col("role")).alias("byline"),
        F.col("text").alias("body"),
        F.when(F.col("turn") % 2 == 0, "2024-01-01").alias("published_at"),
        F.when(F.col("turn") % 4 == 3, "trafilatura_normalised").otherwise("meta").alias("date_source"),
        F.concat(F.lit("https://a.example/"), (F.col("conv_id") % 7 + F.floor(F.col("turn") / 4)).cast("string")).alias("final_url"),
    )


VERSIONS = f"""versions AS (SELECT conv_id AS article_id, turn AS id, {START} + to_hours(CAST(turn * 30 AS INT)) AS fetched_at,
 string_split(text, chr(10))[1] AS headline, CASE WHEN turn % 3 <> 2 THEN role END AS byline, text AS body,
 CASE WHEN turn % 2 = 0 THEN '2024-01-01' END AS published_at, CASE WHEN turn % 4 = 3 THEN 'trafilatura_normalised' ELSE 'meta' END AS date_source,
 'https://a.example/' || CAST(conv_id % 7 + turn // 4 AS VARCHAR) AS final_url FROM conversations)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("article_id"),
        F.col("ts").alias("started_at"),
        F.when(kind == "error", "http_error").when(kind == "signup", "timeout").when(kind == "purchase", "robots_blocked").otherwise("ok").alias("outcome"),
        F.when(kind == "error", F.when(k % 2 == 0, 404).otherwise(410)).alias("http_status"),
    )


ATTEMPTS = """attempts AS (SELECT event_id AS id, user_id AS article_id, ts AS started_at,
 CASE event_type WHEN 'error' THEN 'http_error' WHEN 'signup' THEN 'timeout' WHEN 'purchase' THEN 'robots_blocked' ELSE 'ok' END AS outcome,
 CASE WHEN event_type = 'error' THEN CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 2 = 0 THEN 404 ELSE 410 END END AS http_status FROM events)"""


def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as outlets; what they shipped in one week are their snapshots, so that some contribute nothing."""
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_quantity")
    week = F.col("l_shipdate").between(F.lit("1998-03-01").cast("timestamp"), F.lit("1998-03-07").cast("timestamp"))
    sums = line.groupBy("l_suppkey").agg(F.count("*").alias("discovered"), F.count_if(F.col("l_returnflag") != "N").alias("attempted"), F.count_if(F.col("l_returnflag") == "R").alias("captured"), F.count_if(week).alias("snapshots"), F.count_if(week & (F.col("l_quantity") > 40)).alias("archived"))
    home = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")  # 25 and 5 rows, fixed
    s = read(spark, sf_dir, "supplier").join(F.broadcast(home), F.col("s_nationkey") == F.col("n_nationkey"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = s.join(sums, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select(F.col("s_suppkey").alias("outlet_id"), F.col("r_name").alias("language"), F.concat(F.lit("tier"), F.floor((F.col("s_acctbal") + 1000) / 2000).cast("int").cast("string")).alias("tier"), zero("discovered"), zero("attempted"), zero("captured"), zero("snapshots"), zero("archived"))


OUTLETS = """outlets AS (SELECT s_suppkey AS outlet_id, r_name AS language, 'tier' || CAST(CAST(floor((s_acctbal + 1000) / 2000) AS INT) AS VARCHAR) AS tier,
 coalesce(discovered, 0) AS discovered, coalesce(attempted, 0) AS attempted, coalesce(captured, 0) AS captured, coalesce(snapshots, 0) AS snapshots, coalesce(archived, 0) AS archived
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN
 (SELECT l_suppkey, count(*) AS discovered, count_if(l_returnflag <> 'N') AS attempted, count_if(l_returnflag = 'R') AS captured,
  count_if(l_shipdate BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-03-07') AS snapshots,
  count_if(l_shipdate BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-03-07' AND l_quantity > 40) AS archived FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as entries of two fetches of a feed and a sitemap of their top-level domain."""
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]*\.(\w+)/", 1).alias("outlet_id"), F.sha2("url", 256).alias("url_hash"))
    runs = F.array(*[F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(age).alias("age"))) for kind, age, cond in (("rss", 2, F.col("page_id") % 3 == 0), ("rss", 1, F.col("page_id") % 6 == 0), ("sitemap", 2, F.col("page_id") % 4 != 0), ("sitemap", 1, F.col("page_id") % 5 != 0))])
    return p.select("outlet_id", "url_hash", "page_id", F.explode(F.array_compact(runs)).alias("r")).select("outlet_id", "url_hash", "page_id", "r.kind", "r.age")


ENTRIES = """entries AS (SELECT regexp_extract(url, '^https?://[^/]*\\.(\\w+)/', 1) AS outlet_id, sha256(url) AS url_hash, page_id, kind, age FROM pages,
 (VALUES ('rss', 2), ('rss', 1), ('sitemap', 2), ('sitemap', 1)) r(kind, age)
 WHERE CASE WHEN kind = 'rss' AND age = 2 THEN page_id % 3 = 0 WHEN kind = 'rss' THEN page_id % 6 = 0 WHEN age = 2 THEN page_id % 4 <> 0 ELSE page_id % 5 <> 0 END)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "running").otherwise("done")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ref_id"), F.when(F.col("o_orderkey") % 2 == 0, "recheck_article").otherwise("fetch_article").alias("kind"), status.alias("status"), F.col("o_orderdate").alias("run_after"), F.col("o_orderdate").alias("locked_at"), (F.col("o_orderkey") % 6 + 1).alias("attempts"))


JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey AS ref_id, CASE WHEN o_orderkey % 2 = 0 THEN 'recheck_article' ELSE 'fetch_article' END AS kind,
 CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'running' ELSE 'done' END AS status, o_orderdate AS run_after, o_orderdate AS locked_at, o_orderkey % 6 + 1 AS attempts FROM orders)"""

GONE = f"""{ATTEMPTS}, runs AS (SELECT *, count(CASE WHEN outcome = 'ok' THEN 1 END) OVER (PARTITION BY article_id ORDER BY started_at, id) AS run,
 CASE WHEN outcome = 'robots_blocked' THEN 'ROBOTS_BLOCKED' WHEN http_status = 404 THEN 'GONE_404' WHEN http_status = 410 THEN 'GONE_410' END AS kind FROM attempts),
 streaks AS (SELECT *, lag(kind, 1) OVER s AS k1, lag(kind, 2) OVER s AS k2, lag(started_at, 2) OVER s AS t2 FROM runs WHERE outcome <> 'ok' WINDOW s AS (PARTITION BY article_id, run ORDER BY started_at, id)),
 gone AS (SELECT article_id, id AS fetch_attempt_id, started_at AS detected_at, kind AS type, CASE WHEN kind = 'ROBOTS_BLOCKED' THEN 'probable' ELSE 'confirmed' END AS confidence
  FROM streaks WHERE kind = k1 AND kind = k2 AND started_at - t2 >= INTERVAL 6 HOUR)"""


#: Two days of shipments are snapshots in the export, so that some outlets have none.
DAYS = "TIMESTAMP '1998-03-01 00:00:00' AND TIMESTAMP '1998-03-02 00:00:00'"
FAMILIES = {"language": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "OCEANIA"], "tier": [f"tier{i}" for i in range(7)]}


def export(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The relations of the export: outlets, articles, attempts, snapshots, archives, events, annotations, listings."""
    line = read(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber"))
    first = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("outlet_id"))
    articles = read(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("id")).select("id", "outlet_id", F.col("o_orderdate").alias("first_seen"), F.when(F.col("id") % 7 == 0, F.lit(1)).cast("long").alias("merged_into_id"))
    home = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")  # 25 and 5 rows, fixed
    outlets = read(spark, sf_dir, "supplier").join(F.broadcast(home), F.col("s_nationkey") == F.col("n_nationkey"))
    outlets = outlets.select(F.col("s_suppkey").alias("outlet_id"), F.concat(F.lit("outlet-"), F.col("s_suppkey").cast("string")).alias("slug"), F.col("s_name").alias("name"), F.col("r_name").alias("language"), F.concat(F.lit("tier"), F.floor((F.col("s_acctbal") + 1000) / 2000).cast("int").cast("string")).alias("tier"), (F.col("s_suppkey") % 11 != 0).alias("active"))
    shots = line.where(f"l_shipdate BETWEEN {DAYS}")
    snapshots = shots.select("id", F.col("l_orderkey").alias("article_id"), F.col("l_shipdate").alias("fetched_at"), (F.col("l_quantity") * 100).cast("long").alias("body_length"), (F.col("l_linenumber") % 5 == 0).alias("failed"), F.concat(F.lit("vantage-"), F.col("l_returnflag")).alias("vantage"))
    return {
        "outlets": outlets,
        "articles": articles,
        "attempts": line.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("article_id"), F.when(F.col("l_linenumber") % 2 == 1, "article").otherwise("rss").alias("kind")),
        "snapshots": snapshots,
        "archives": shots.select(F.col("id").alias("snapshot_id"), F.when(F.col("l_quantity") > 25, "ok").otherwise("error").alias("outcome")),
        "events": shots.select("id", F.col("l_orderkey").alias("article_id"), F.when(F.col("l_linenumber") % 3 == 0, "BODY_CHANGED").when(F.col("l_linenumber") % 3 == 1, "GONE_404").otherwise("BYLINE_REMOVED").alias("type"), F.when(F.col("l_discount") > 0.015, "confirmed").otherwise("probable").alias("confidence"), F.when(F.col("l_tax") < 0.065, "confirmed").alias("review_decision")),
        "annotations": shots.select(F.col("id").alias("event_id"), F.when(F.col("l_quantity") > 5, "published").otherwise("draft").alias("review_state")),
        "listings": read(spark, sf_dir, "events").select(F.col("ts").alias("fetched_at")),
    }


EXPORT = f"""line AS (SELECT *, l_orderkey * 1000000000 + l_partkey * 10 + l_linenumber AS id FROM lineitem),
 outlet AS (SELECT s_suppkey AS outlet_id, 'outlet-' || s_suppkey AS slug, s_name AS name, r_name AS language, 'tier' || CAST(CAST(floor((s_acctbal + 1000) / 2000) AS INT) AS VARCHAR) AS tier, s_suppkey % 11 <> 0 AS active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 live AS (SELECT o_orderkey AS article_id, outlet_id, o_orderdate AS first_seen FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS outlet_id FROM line GROUP BY 1) ON l_orderkey = o_orderkey JOIN outlet USING (outlet_id) WHERE active AND o_orderkey % 7 <> 0),
 shot AS (SELECT id, l_orderkey AS article_id, l_shipdate AS fetched_at, CAST(l_quantity * 100 AS BIGINT) AS body_length, l_linenumber % 5 = 0 AS failed, 'vantage-' || l_returnflag AS vantage, l_quantity, l_discount, l_tax, l_linenumber FROM line WHERE l_shipdate BETWEEN {DAYS}),
 own AS (SELECT s.*, outlet_id FROM shot s JOIN live USING (article_id)),
 figures AS (SELECT outlet_id, slug, language, tier, (SELECT count(*) FROM live l WHERE l.outlet_id = o.outlet_id) AS discovered,
  coalesce(a.attempted, 0) AS attempted, coalesce(s.captured, 0) AS captured, coalesce(s.snapshots, 0) AS snapshots, coalesce(s.archived, 0) AS archived
  FROM outlet o LEFT JOIN (SELECT outlet_id, count(DISTINCT l_orderkey) AS attempted FROM line JOIN live ON article_id = l_orderkey WHERE l_returnflag <> 'N' AND l_linenumber % 2 = 1 GROUP BY 1) a USING (outlet_id)
  LEFT JOIN (SELECT outlet_id, count(DISTINCT article_id) AS captured, count(*) AS snapshots, count_if(l_quantity > 25) AS archived FROM own GROUP BY 1) s USING (outlet_id) WHERE active)"""

#: The rules of suppression as recursion over the groups that are withheld, a bit each, in order of judging: of the first
#: group and choice of its parts that leaves too few, the part with the fewest contributing outlets goes.
SUPPRESSION = f"""grp_key AS (SELECT * FROM (VALUES (0, 'all', 'all'), {", ".join(f"({i}, '{g}', '{k}')" for i, (g, k) in enumerate(((g, k) for g, ks in FAMILIES.items() for k in ks), 1))}) t(place, grp, key)),
 member AS (SELECT place, grp, key, outlet_id, snapshots > 0 AS contributes FROM grp_key JOIN figures ON grp = 'all' OR (grp = 'language' AND language = key) OR (grp = 'tier' AND tier = key)),
 sized AS (SELECT place, grp, key, count(outlet_id) AS n, count(*) FILTER (contributes) AS c FROM grp_key LEFT JOIN member USING (place, grp, key) GROUP BY ALL),
 cell AS (SELECT language, tier, count(*) AS n, count_if(snapshots > 0) AS c, 1 + list_position({FAMILIES["language"]}, language) - 1 AS lp, {len(FAMILIES["language"])} + list_position({FAMILIES["tier"]}, tier) AS tp FROM figures GROUP BY 1, 2),
 mask AS (SELECT unnest(range(1, 1 << {len(FAMILIES["language"])})) << 1 AS m UNION ALL SELECT unnest(range(1, 1 << {len(FAMILIES["tier"])})) << {1 + len(FAMILIES["language"])} UNION ALL
  SELECT (1 << l) | (1 << t) FROM range(1, {1 + len(FAMILIES["language"])}) a(l), range({1 + len(FAMILIES["language"])}, {1 + len(FAMILIES["language"]) + len(FAMILIES["tier"])}) b(t)),
 rest AS (SELECT m, coalesce(sum(n) FILTER (NOT covered), 0) AS n, coalesce(sum(c) FILTER (NOT covered), 0) AS c, max(times) AS times
  FROM (SELECT m, n, c, (m >> lp) & 1 = 1 OR (m >> tp) & 1 = 1 AS covered, ((m >> lp) & 1) + ((m >> tp) & 1) AS times FROM mask, cell) GROUP BY m),
 leak AS (SELECT m, arg_min(place, (s.c, grp, key)) AS victim FROM rest r JOIN sized s ON (m >> place) & 1 = 1 WHERE times <= 1 AND ((r.c > 0 AND r.c < 3) OR (r.c = 0 AND r.n > 0 AND r.n < 3)) GROUP BY m),
 state AS (SELECT coalesce(bit_or(1::BIGINT << place), 0) AS small, coalesce(bit_or(1::BIGINT << place), 0) AS held, true AS more FROM sized WHERE c < 3
  UNION ALL SELECT small, held | coalesce((SELECT 1::BIGINT << arg_min(victim, m) FROM leak WHERE m & held = 0), 0), (SELECT count(*) > 0 FROM leak WHERE m & held = 0) FROM state WHERE more AND held & 1 = 0),
 plan AS (SELECT place, grp, key, CASE WHEN (small >> place) & 1 = 1 THEN 'small_group' WHEN (held >> place) & 1 = 1 THEN 'complementary' END AS reason FROM sized, (SELECT small, bit_or(held) AS held FROM state GROUP BY 1))"""

"""Figures of each outlet and group, what is withheld of them, and the rules that published tables keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagedrift.operators.coverage import LEAST_OUTLETS, NEWEST, SHORT_CHARS, SHORT_SHARE, Group, health_label, plan_suppression, published, ratio

FIGURES = ["discovered", "attempted", "captured", "snapshots", "archived"]


def live_articles(outlets: DataFrame, articles: DataFrame) -> DataFrame:
    """Unmerged articles of active outlets: article_id, outlet_id, first_seen."""
    active = outlets.where("active").select("outlet_id")
    return articles.where("merged_into_id IS NULL").join(active, "outlet_id", "left_semi").select(F.col("id").alias("article_id"), "outlet_id", "first_seen")


def outlet_figures(outlets: DataFrame, articles: DataFrame, attempts: DataFrame, snapshots: DataFrame, archives: DataFrame) -> DataFrame:
    """Figures of each active outlet, over its unmerged articles: outlet_id, language, tier, FIGURES.

    outlets: outlet_id, language, tier, active; articles: id, outlet_id, merged_into_id, first_seen; attempts: article_id, kind;
    snapshots: id, article_id; archives: snapshot_id, outcome. One grouped pass over each relation; a fact is counted by
    article before it meets the outlets.
    """
    live = live_articles(outlets, articles)
    tried = attempts.where("kind = 'article'").select("article_id").distinct().withColumn("tried", F.lit(1))
    kept = archives.where("outcome = 'ok'").select(F.col("snapshot_id").alias("id")).distinct().withColumn("kept", F.lit(1))
    taken = snapshots.select("id", "article_id").join(kept, "id", "left").groupBy("article_id").agg(F.count("*").alias("n"), F.count("kept").alias("kept"))
    told = live.join(tried, "article_id", "left").join(taken, "article_id", "left").groupBy("outlet_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = told.agg(F.count("*").alias("discovered"), F.count("tried").alias("attempted"), F.count("n").alias("captured"), zero(F.sum("n")).alias("snapshots"), zero(F.sum("kept")).alias("archived"))
    return outlets.where("active").select("outlet_id", "language", "tier").join(sums, "outlet_id", "left").select("outlet_id", "language", "tier", *[zero(F.col(c)).alias(c) for c in FIGURES])


def totals(figures: DataFrame) -> DataFrame:
    """One row over all outlets: outlets, the sums of FIGURES, archive_rate."""
    sums = figures.agg(F.count("*").alias("outlets"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FIGURES])
    return sums.withColumn("archive_rate", ratio(F.col("archived"), F.col("snapshots")))


def by_group(rows: DataFrame) -> DataFrame:
    """Each of rows(language, tier, ...) once for each group of its outlet: all, its language, its tier."""
    of = lambda grp, key: F.struct(F.lit(grp).alias("grp"), key.alias("key"))
    return rows.withColumn("_g", F.explode(F.array(of("all", F.lit("all")), of("language", F.col("language")), of("tier", F.col("tier"))))).select("_g.*", *rows.columns)


def group_keys(spark, families: dict[str, list[str]]) -> DataFrame:
    """The groups that are published, empty ones too: place, grp, key."""
    keys = [("all", "all"), *((grp, key) for grp, names in families.items() for key in names)]
    return F.broadcast(spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "place int, grp string, key string"))  # a row for each key of closed vocabularies


def suppression(figures: DataFrame, families: dict[str, list[str]], least: int = LEAST_OUTLETS) -> dict[Group, str]:
    """plan_suppression() of figures(language, tier, snapshots). The driver sees a row for each pair of a language and a tier."""
    cells = figures.groupBy("language", "tier").agg(F.count("*").alias("n"), F.count_if(F.col("snapshots") > 0).alias("c")).collect()
    sizes = {(r["language"], r["tier"]): (r["n"], r["c"]) for r in cells}
    groups: dict[Group, set] = {("all", "all"): set(sizes)}
    for i, (grp, names) in enumerate(families.items()):
        groups |= {(grp, key): {c for c in sizes if c[i] == key} for key in names}
    return plan_suppression(groups, sizes, least)


def withheld(rows: DataFrame, plan: dict[Group, str], columns: list[str]) -> DataFrame:
    """rows(grp, key, ...) with suppressed, reason, and the named columns null where the plan withholds the group."""
    reasons = rows.sparkSession.createDataFrame([(*g, r) for g, r in plan.items()], "grp string, key string, reason string")
    told = rows.join(F.broadcast(reasons), ["grp", "key"], "left")  # fewer rows than groups
    shown = F.col("reason").isNull()
    rest = [c for c in rows.columns if c not in columns]
    return told.select(*rest, *[F.when(shown, F.col(c)).alias(c) for c in columns], (~shown).alias("suppressed"), "reason")


COVERED = ["contributing", "discovered", "captured", "snapshots", "archived", "capture_rate", "archive_rate"]


def coverage(figures: DataFrame, families: dict[str, list[str]], plan: dict[Group, str]) -> DataFrame:
    """Published coverage by group: grp, key, outlets, COVERED, suppressed, reason. A withheld group shows only its outlets."""
    sums = by_group(figures).groupBy("grp", "key").agg(F.count("*").alias("outlets"), F.count_if(F.col("snapshots") > 0).alias("contributing"), *[F.sum(c).alias(c) for c in FIGURES])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = group_keys(figures.sparkSession, families).join(sums, ["grp", "key"], "left").select("grp", "key", *map(zero, ["outlets", "contributing", *FIGURES]))
    rows = rows.withColumn("capture_rate", ratio(F.col("captured"), F.col("attempted"))).withColumn("archive_rate", ratio(F.col("archived"), F.col("snapshots")))
    return withheld(rows.drop("attempted"), plan, COVERED)


HEALTH = ["contributing", "status", "sample", "median_length", "short", "errors"]


def health(outlets: DataFrame, articles: DataFrame, snapshots: DataFrame, families: dict[str, list[str]], plan: dict[Group, str]) -> DataFrame:
    """Published extraction health by group: grp, key, HEALTH, suppressed, reason.

    snapshots: id, article_id, fetched_at, body_length, failed. The newest bodies of each outlet are judged against the
    outlet's own median and pooled; the median is that of the pooled lengths.
    """
    w = Window.partitionBy("outlet_id").orderBy(F.desc("fetched_at"), F.desc("id"))
    own = snapshots.join(live_articles(outlets, articles), "article_id").select("outlet_id", "body_length", "failed", F.row_number().over(w).alias("place")).where(F.col("place") <= NEWEST)
    told = own.withColumn("median", F.median("body_length").over(Window.partitionBy("outlet_id")))
    short = F.col("body_length") < F.greatest(F.lit(float(SHORT_CHARS)), F.lit(SHORT_SHARE) * F.col("median"))
    judged = told.select("outlet_id", "body_length", "failed", short.alias("short")).join(outlets.select("outlet_id", "language", "tier"), "outlet_id")
    pooled = by_group(judged).groupBy("grp", "key").agg(F.countDistinct("outlet_id").alias("contributing"), F.count("*").alias("sample"), F.median("body_length").alias("median_length"), F.count_if("short").alias("short"), F.count_if("failed").alias("errors"))
    rows = group_keys(outlets.sparkSession, families).join(pooled, ["grp", "key"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = health_label(zero("short"), zero("errors"), zero("sample"))
    return withheld(rows.select("grp", "key", zero("contributing").alias("contributing"), status.alias("status"), zero("sample").alias("sample"), "median_length", zero("short").alias("short"), zero("errors").alias("errors")), plan, HEALTH)


def event_summary(outlets: DataFrame, articles: DataFrame, events: DataFrame, annotations: DataFrame, contributing: DataFrame, families: dict[str, list[str]], plan: dict[Group, str]) -> DataFrame:
    """Published events by group: grp, key, contributing, published_events, by_type (a map), suppressed, reason.

    events: id, article_id, type, confidence, review_decision; annotations: event_id, review_state; contributing: outlet figures.
    """
    counted = published(events, annotations).join(live_articles(outlets, articles), "article_id").join(outlets.select("outlet_id", "language", "tier"), "outlet_id")
    types = by_group(counted.select("language", "tier", "type")).groupBy("grp", "key", "type").agg(F.count("*").alias("n"))
    maps = types.groupBy("grp", "key").agg(F.sum("n").alias("published_events"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    shares = by_group(contributing).groupBy("grp", "key").agg(F.count_if(F.col("snapshots") > 0).alias("contributing"))
    rows = group_keys(outlets.sparkSession, families).join(shares, ["grp", "key"], "left").join(maps, ["grp", "key"], "left")
    none = F.create_map().cast("map<string,bigint>")
    rows = rows.select("grp", "key", F.coalesce("contributing", F.lit(0)).alias("contributing"), F.coalesce("published_events", F.lit(0)).alias("published_events"), F.coalesce("by_type", none).alias("by_type"))
    return withheld(rows, plan, ["contributing", "published_events", "by_type"])


def volume(outlets: DataFrame, articles: DataFrame, snapshots: DataFrame, suppressed: bool, zone: str = "Asia/Dhaka") -> DataFrame:
    """Snapshots taken and articles first seen by local day, with zeros between the first and the last: day, snapshots,
    articles_first_seen. Nothing if suppressed."""
    live = live_articles(outlets, articles)
    taken = snapshots.join(live, "article_id", "left_semi").select(F.col("fetched_at").alias("at"), F.lit(1).alias("s"), F.lit(0).alias("f"))
    told = taken.union(live.select(F.col("first_seen").alias("at"), F.lit(0), F.lit(1)))
    days = told.groupBy(F.to_date(F.from_utc_timestamp("at", zone)).alias("day")).agg(F.sum("s").alias("snapshots"), F.sum("f").alias("articles_first_seen")).where("day IS NOT NULL")
    every = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    out = every.join(days, "day", "left").select("day", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("snapshots", "articles_first_seen")])
    return out.where(F.lit(not suppressed))


def meta(snapshots: DataFrame, listings: DataFrame) -> DataFrame:
    """One row: first_capture_at, last_capture_at, vantages (distinct, sorted), last_listing_at; over all snapshots and listings."""
    shots = snapshots.agg(F.min("fetched_at").alias("first_capture_at"), F.max("fetched_at").alias("last_capture_at"), F.array_sort(F.collect_set("vantage")).alias("vantages"))
    return shots.crossJoin(F.broadcast(listings.agg(F.max("fetched_at").alias("last_listing_at"))))  # one row by one row


def group_table(covered: DataFrame, healthy: DataFrame, summary: DataFrame) -> DataFrame:
    """Coverage, health and events of each group in one row: grp, key, outlets, contributing, snapshots, status, median_length, published_events, reason."""
    return covered.join(healthy.select("grp", "key", "status", "median_length"), ["grp", "key"]).join(summary.select("grp", "key", "published_events"), ["grp", "key"]).select("grp", "key", "outlets", "contributing", "snapshots", "status", "median_length", "published_events", "reason")


def calendar(days: DataFrame, until: Column, months: int = 12) -> DataFrame:
    """The days of the months that end with that of the date `until`: day, week_column (0 is Saturday), week_row, kind, snapshots.

    days: day, snapshots. kind is future after the last day with figures, before until the first day with snapshots, else
    capture or zero.
    """
    told = days.agg(F.min(F.when(F.col("snapshots") > 0, F.col("day"))).alias("started"), F.max("day").alias("last"))
    first = F.add_months(F.trunc(until, "month"), 1 - months)
    dates = told.select("started", "last", F.explode(F.sequence(first, F.last_day(until))).alias("day"))
    lead = F.dayofweek(F.trunc("day", "month")) % 7
    place = lead + F.dayofmonth("day") - 1
    rows = dates.join(days.select("day", "snapshots"), "day", "left").withColumn("snapshots", F.coalesce("snapshots", F.lit(0)))
    kind = F.when(F.col("day") > F.col("last"), "future").when(F.col("started").isNull() | (F.col("day") < F.col("started")), "before").when(F.col("snapshots") > 0, "capture").otherwise("zero")
    return rows.select("day", (place % 7).alias("week_column"), F.floor(place / 7).cast("int").alias("week_row"), kind.alias("kind"), "snapshots")


def dataset_violations(outlets: DataFrame, covered: DataFrame, healthy: DataFrame, summary: DataFrame, days: DataFrame, least: int = LEAST_OUTLETS) -> DataFrame:
    """Broken rules of the published tables, a row each: place, rule. place is grp:key, or the table. Empty if all hold.

    outlets: slug, language, tier (those monitored); the other tables as coverage(), health(), event_summary() and volume()
    give them.
    """
    name = F.concat_ws(":", "grp", "key")
    rule = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.lit(text))

    def rows(df: DataFrame, table: str, shown: list[str], needed: list[str], more: list[Column]) -> DataFrame:
        every = lambda names, test: F.forall(F.array(*[test(F.col(c)) for c in names]), lambda x: x)
        null = F.when(F.col("suppressed"), ~every(shown, lambda c: c.isNull())).otherwise(~every(needed, lambda c: c.isNotNull()))
        rules = [
            rule(null, f"{table}: figures are null exactly when suppressed"),
            rule(F.col("suppressed") != F.col("reason").isNotNull(), f"{table}: a reason is set exactly when suppressed"),
            rule(~F.col("suppressed") & (F.col("contributing") < least), f"{table}: published with too few contributing"),
            *more,
        ]
        return df.select(name.alias("place"), F.explode(F.array_compact(F.array(*rules))).alias("rule"))

    own = by_group(outlets).groupBy("grp", "key").agg(F.count("*").alias("_members"))
    checked = covered.join(own, ["grp", "key"], "left")
    found = rows(checked, "coverage", COVERED, [c for c in COVERED if not c.endswith("_rate")], [
        rule(F.col("outlets") != F.coalesce("_members", F.lit(0)), "coverage: outlets are its members"),
        rule(~F.col("suppressed") & (F.col("captured") > F.col("discovered")), "coverage: captured within discovered"),
        rule(~F.col("suppressed") & (F.col("archived") > F.col("snapshots")), "coverage: archived within snapshots"),
    ])
    found = found.union(rows(healthy, "health", HEALTH, ["contributing", "status"], []))
    found = found.union(rows(summary, "events", ["published_events", "by_type"], ["published_events", "by_type"], []))
    reasons = covered.select("grp", "key", F.lit(True).alias("_known"), F.col("reason").alias("_reason"))
    for table, df in (("health", healthy), ("events", summary)):
        both = df.select("grp", "key", "reason", F.lit(True).alias("_here")).join(reasons, ["grp", "key"], "full")
        unlike = F.col("_here").isNull() | F.col("_known").isNull() | ~F.col("reason").eqNullSafe(F.col("_reason"))
        found = found.union(both.where(unlike).select(name, F.lit(f"{table}: groups and reasons are those of coverage")))
    twice = lambda df, key, place, text: df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(place, F.lit(text))
    found = found.union(twice(outlets, ["slug"], F.col("slug"), "outlets: a slug is there once"))
    found = found.union(twice(covered, ["grp", "key"], name, "coverage: a group is there once"))
    whole = covered.where("grp = 'all'").select(F.col("snapshots").alias("_all"), F.col("suppressed").alias("_held"))
    parts = covered.where("grp <> 'all'").groupBy("grp").agg(F.sum("outlets").alias("outlets"), F.sum("snapshots").alias("snapshots"), F.bool_or("suppressed").alias("held"))
    cohort = outlets.agg(F.count("*").alias("_n"))
    told = parts.crossJoin(F.broadcast(cohort)).crossJoin(F.broadcast(whole))  # rows for two families by one row each
    sums = F.array_compact(F.array(rule(F.col("outlets") != F.col("_n"), "coverage: the groups of a family are all outlets"), rule(~F.col("_held") & ~F.col("held") & (F.col("snapshots") != F.col("_all")), "coverage: the snapshots of a family are all snapshots")))
    found = found.union(told.select(F.col("grp"), F.explode(sums)))
    series = days.agg(F.coalesce(F.sum("snapshots"), F.lit(0)).alias("s"), F.count("*").alias("n")).crossJoin(F.broadcast(whole))  # one row by one row
    wrong = F.when(F.col("_held"), F.col("n") > 0).otherwise(F.col("s") != F.col("_all"))
    return found.union(series.where(wrong).select(F.lit("volume"), F.lit("volume: the series is that of all outlets")))


# How sure an event can be.
CONFIDENCES = ("confirmed", "probable", "unverified")


def triage_violations(rows: DataFrame) -> DataFrame:
    """Broken rules of a triage document, a row each: id, rule. Empty if all hold.

    rows: id, type, detected_at, confidence, severity, age_hours, outlet_slug, outlet_name, url, review_state of annotations,
    article_change_count, self_corrected, as triage.document() gives them.
    """
    rules = {
        "id is positive": ~(F.col("id") > 0),
        "type is named": F.coalesce(F.col("type"), F.lit("")) == "",
        "detected_at is set": F.col("detected_at").isNull(),
        "confidence is known": ~F.col("confidence").isin(*CONFIDENCES),
        "severity is set": F.col("severity").isNull(),
        "age is not negative": ~(F.col("age_hours") >= 0),
        "outlet is named": (F.coalesce(F.col("outlet_slug"), F.lit("")) == "") | (F.coalesce(F.col("outlet_name"), F.lit("")) == ""),
        "url is a URL": ~F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]"),
        "changes are counted": ~(F.col("article_change_count") >= 0),
        "annotations are signed and in a known state": F.exists("annotations", lambda a: ~F.coalesce(a["review_state"].isin("draft", "published", "retracted"), F.lit(False)) | (F.coalesce(a["author"], F.lit("")) == "")),
        "self_corrected is set": F.col("self_corrected").isNull(),
    }
    # An unknown answer is a broken rule, but for annotations, which may be missing.
    unknown = lambda name: F.lit(not name.startswith("annotations"))
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, unknown(name)), name) for name, bad in rules.items()]))
    return rows.select("id", F.explode(broken).alias("rule"))


def checked(violations: DataFrame, shown: int = 20) -> None:
    """Raise an error that names the first broken rules, if there are any."""
    found = violations.limit(shown).collect()
    if found:
        raise ValueError("; ".join(": ".join(map(str, r)) for r in found))


def archive_coverage(snapshots: DataFrame, archives: DataFrame) -> DataFrame:
    """One row: snapshots, and of them archived, those with a good copy."""
    good = archives.where("outcome = 'ok'").select(F.col("snapshot_id").alias("id")).distinct().withColumn("good", F.lit(1))
    return snapshots.select("id").join(good, "id", "left").agg(F.count("*").alias("snapshots"), F.count("good").alias("archived"))


def monitored(outlets: DataFrame) -> DataFrame:
    """The outlets that are looked at, by slug, without any figure: slug, name, language, tier."""
    return outlets.where("active").select("slug", "name", "language", "tier").orderBy("slug")

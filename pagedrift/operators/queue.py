"""Work that is due, and the articles that URLs lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagedrift.functions.fetching import cut_error
from pagedrift.sources.staging import staged


def enqueue(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """candidates(kind, ref_id) without an open job of their own, each once."""
    busy = jobs.where(F.col("status").isin("pending", "running")).select("kind", "ref_id")
    return candidates.dropDuplicates(["kind", "ref_id"]).join(busy, ["kind", "ref_id"], "left_anti")


def due(jobs: DataFrame, now: Column, n: int, stale_hours: int = 1) -> DataFrame:
    """The n jobs to take next: pending and due, or running under a lock that is too old; the earliest first."""
    waiting = (F.col("status") == "pending") & (F.col("run_after") <= now)
    stuck = (F.col("status") == "running") & (F.col("locked_at") < now - F.make_interval(hours=F.lit(stale_hours)))
    return jobs.where(waiting | stuck).orderBy("run_after", "id").limit(n)


def without_recheck(articles: DataFrame, jobs: DataFrame) -> DataFrame:
    """Captured, unmerged articles that have no recheck job of any status."""
    known = jobs.where("kind = 'recheck_article'").select(F.col("ref_id").alias("id"))
    return articles.where("status = 'captured' AND merged_into_id IS NULL").join(known, "id", "left_anti")


def transition(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs after results(id, action, at, error, backoff_seconds), one for a job at most; jobs without a result stay as they are.

    jobs: id, status, attempts, max_attempts, run_after, locked_by, locked_at, last_error, and more. complete: done. fail: one
    attempt more, parked as failed at the last one, else pending again after backoffs that double. release: pending, untouched.
    Only what is kept of the errors of failures, ERROR_CHARS each, is moved and sorted with the rows.
    """
    kept = F.when(F.col("action") == "fail", cut_error(F.col("error"))).alias("error")
    told = jobs.join(results.select("id", "action", "at", kept, "backoff_seconds"), "id", "left")
    did = lambda *names: F.coalesce(F.col("action").isin(*names), F.lit(False))
    attempts = F.col("attempts") + F.when(did("complete", "fail"), 1).otherwise(0)
    parked = did("fail") & (attempts >= F.col("max_attempts"))
    wait = F.make_dt_interval(secs=(F.col("backoff_seconds") * F.pow(F.lit(2.0), attempts - 1)).cast("decimal(18,6)"))
    new = {
        "status": F.when(did("complete"), "done").when(parked, "failed").when(did("fail", "release"), "pending").otherwise(F.col("status")),
        "attempts": attempts,
        "run_after": F.when(did("fail") & ~parked, F.col("at") + wait).otherwise(F.col("run_after")),
        "locked_by": F.when(~did("complete", "fail", "release"), F.col("locked_by")),
        "locked_at": F.when(~did("complete", "fail", "release"), F.col("locked_at")),
        "last_error": F.when(did("fail"), F.col("error")).otherwise(F.col("last_error")),
    }
    return told.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def spacing(attempts: DataFrame, least_seconds: float) -> DataFrame:
    """Starts on one host closer to the one before than allowed: host, id, started_at, gap.

    Hosts are divided by day, so no task gets a host's whole history; the first start of a day is measured from the last one
    before that day, which comes from a row for each host and day.
    """
    rows = attempts.select("host", "id", "started_at", F.to_date("started_at").alias("day"))
    last = rows.groupBy("host", "day").agg(F.max("started_at").alias("last"))
    carried = last.select(F.col("host").alias("of"), F.col("day").alias("on"), F.lag("last").over(Window.partitionBy("host").orderBy(F.col("day").asc_nulls_first())).alias("carried"))
    w = Window.partitionBy("host", "day").orderBy("started_at", "id")
    told = rows.select("host", "day", "id", "started_at", F.lag("started_at").over(w).alias("before")).join(carried, F.col("host").eqNullSafe(F.col("of")) & F.col("day").eqNullSafe(F.col("on")), "left")
    gap = (F.unix_micros("started_at") - F.unix_micros(F.coalesce("before", "carried"))) / F.lit(1e6)
    return told.select("host", "id", "started_at", gap.alias("gap")).where(F.col("gap") < least_seconds)


def merged(articles: DataFrame, aliases: DataFrame) -> DataFrame:
    """articles(id, merged_into_id, ...) after aliases(article_id, url_hash): of articles that share a URL the newer ones merge
    into the oldest; merges that are known stay."""
    oldest = aliases.groupBy("url_hash").agg(F.min("article_id").alias("oldest"))
    up = aliases.join(oldest, "url_hash").groupBy("article_id").agg(F.min("oldest").alias("up")).where("up < article_id")
    told = articles.join(up, articles["id"] == up["article_id"], "left")
    return told.select(*[F.coalesce(F.col("merged_into_id"), F.col("up")).alias(c) if c == "merged_into_id" else F.col(c) for c in articles.columns])


def roots(articles: DataFrame, most_steps: int = 40) -> DataFrame:
    """Where following merged_into_id ends, for each of articles(id, merged_into_id): id, root.

    Only articles that are merged take part in the rounds. Pointers double their reach in each, so a chain of n takes log2(n)
    joins; every round is written to the shared checkpoint folder, without its lineage.
    """
    merges = articles.where("merged_into_id IS NOT NULL").select("id", F.col("merged_into_id").alias("root"))
    found = staged(merges)
    for _ in range(most_steps):
        onward = found.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = staged(found.join(onward, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        found = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            break
    return articles.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def resolved(entries: DataFrame, aliases: DataFrame, root: DataFrame) -> DataFrame:
    """entries(url_hash, ...) with article_id, the root of the article that the URL is known for; null if it isn't known."""
    known = aliases.join(root, aliases["article_id"] == root["id"]).groupBy("url_hash").agg(F.min("root").alias("article_id"))
    return entries.join(known, "url_hash", "left")


def unknown(asked: DataFrame, outlets: DataFrame) -> DataFrame:
    """Slugs that were asked for and that no outlet has."""
    return asked.select("slug").distinct().join(outlets.select("slug"), "slug", "left_anti")


def upsert_seen(known: DataFrame, seen: DataFrame) -> DataFrame:
    """First and last sight of each URL over what is known and what is new: url_hash, first_seen, last_seen."""
    both = known.select("url_hash", "first_seen", "last_seen").union(seen.select("url_hash", F.col("at").alias("first_seen"), F.col("at").alias("last_seen")))
    return both.groupBy("url_hash").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def sync(configured: DataFrame, known: DataFrame, least_rate: float = 2.0) -> DataFrame:
    """Outlets after a configuration: slug, name, rate, active. Missing ones stay, inactive; no rate is below the least."""
    new = configured.select("slug", F.col("name").alias("new_name"), F.col("rate").alias("new_rate"), F.lit(True).alias("active"))
    out = known.select("slug", "name", "rate").join(new, "slug", "full")
    return out.select("slug", F.coalesce("new_name", "name").alias("name"), F.greatest(F.coalesce("new_rate", "rate", F.lit(least_rate)), F.lit(least_rate)).alias("rate"), F.coalesce("active", F.lit(False)).alias("active"))

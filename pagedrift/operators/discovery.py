"""Which feeds and sitemaps of an outlet to follow, judged from what was found in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagedrift.functions.urls import path, same_site

# The least share of entries on the site, days after which a listing is stale, sitemaps taken of an index, and
# of an index without dates.
ON_SITE, STALE_DAYS, CHILDREN, UNDATED_CHILDREN = 0.5, 30, 10, 5
# Fixed value: a path with a year and a month will be out of date with them.
DATED = r"(19|20)\d{2}[-_/]?(0[1-9]|1[0-2])"


# The wording of reasons.
UNPARSED, EMPTY, SAME, STALE = "not RSS/Atom/sitemap", "parsed but empty", "same entries as ", "stale: newest entry "
GENERAL, INDEX, CHILD = "no news sitemap; general sitemap selected", "index of dated news sitemaps", "dated child; parent index selected"
UNDATED, SPARE = "no dated entries; likely sections, not articles", "verified, not needed"


def measured(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """candidates(outlet_id, place, url, kind, root, source, parent) with entries, on_site_share, newest and same_as.

    place is the order in which an outlet's candidates were tried. entries: outlet_id, place, url, date. same_as is the URL of
    the first earlier candidate with the same set of URLs; an index is never the same as another.
    """
    told = entries.join(candidates.select("outlet_id", "place", "root"), ["outlet_id", "place"])
    h = F.xxhash64("url")
    sums = told.groupBy("outlet_id", "place").agg(F.count("*").alias("entries"), F.round(F.avg(same_site(F.col("url"), F.col("root")).cast("int")), 3).alias("on_site_share"), F.max("date").alias("newest"))
    sets = entries.select("outlet_id", "place", h.alias("h"), F.xxhash64(F.lit(1), "url").alias("g")).distinct().groupBy("outlet_id", "place").agg(F.count("*").alias("_n"), F.bit_xor("h").alias("_h"), F.bit_xor("g").alias("_g"))
    out = candidates.join(sums, ["outlet_id", "place"], "left").join(sets, ["outlet_id", "place"], "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    plain = (F.col("kind") != "sitemap_index") & (F.col("entries") > 0)
    w = Window.partitionBy("outlet_id", plain, "_n", "_h", "_g").orderBy("place")
    first = F.first("url").over(w)
    return out.withColumn("same_as", F.when(plain & (F.row_number().over(w) > 1), first)).drop("_n", "_h", "_g")


def reason_against(now: Column) -> Column:
    """Why a measured candidate can't be followed; null if it can."""
    age = F.floor((F.unix_micros(now) - F.unix_micros("newest")) / F.lit(86_400_000_000))
    stale = (F.col("kind") != "sitemap_index") & (F.col("newest") < now - F.make_interval(days=F.lit(STALE_DAYS)))
    return (
        F.when(F.col("kind").isNull(), UNPARSED)
        .when(F.col("entries") <= 0, EMPTY)
        .when(F.col("same_as").isNotNull(), F.concat(F.lit(SAME), F.col("same_as")))
        .when(F.col("on_site_share") < ON_SITE, F.concat(F.lit("only "), F.format_number(F.col("on_site_share") * 100, 0), F.lit("% of entries on "), F.col("root")))
        .when(stale, F.concat(F.lit(STALE), age.cast("string"), F.lit(" days old")))
    )


def selected(candidates: DataFrame, now: Column) -> DataFrame:
    """measured() candidates with selected and reason.

    All good feeds and news sitemaps are followed; of one whose name bears a date the index that it came from, instead. Without a
    news sitemap the good general sitemaps that have dates are: those that robots.txt declares, or else the first.
    """
    told = candidates.withColumn("_bad", reason_against(now))
    good = F.col("_bad").isNull()
    feed, news, general = F.col("kind").isin("rss", "atom"), F.col("kind") == "news_sitemap", F.col("kind").isin("sitemap_index", "sitemap")
    whole = Window.partitionBy("outlet_id")
    told = told.withColumn("_news", F.coalesce(F.bool_or(good & news).over(whole), F.lit(False)))
    dated = good & (feed | news) & F.col("parent").isNotNull() & path(F.col("url")).rlike(DATED)
    heads = told.where(dated).select("outlet_id", F.col("parent").alias("url"), F.lit(True).alias("_head")).distinct()
    told = told.join(heads, ["outlet_id", "url"], "left")
    usable = ~F.col("_news") & general & good & F.col("newest").isNotNull()
    told = told.withColumn("_usable", F.coalesce(usable, F.lit(False)))
    declared = F.col("_usable") & (F.col("source") == "robots")
    told = told.withColumn("_any", F.bool_or(declared).over(whole)).withColumn("_first", F.min(F.when(F.col("_usable"), F.col("place"))).over(whole))
    fallback = F.when(F.coalesce(F.col("_any"), F.lit(False)), declared).otherwise(F.col("_usable") & (F.col("place") == F.col("_first")))
    head = F.coalesce(F.col("_head"), F.lit(False))
    follows = head | F.coalesce(good & (feed | news) & ~dated, F.lit(False)) | F.coalesce(fallback, F.lit(False))
    reason = (
        F.when(F.coalesce(fallback, F.lit(False)), GENERAL)
        .when(head, INDEX)
        .when(F.coalesce(dated, F.lit(False)), CHILD)
        .when(~good, F.col("_bad"))
        .when(~F.col("_news") & general & F.col("newest").isNull(), UNDATED)
        .when(~follows, SPARE)
    )
    return told.select(*candidates.columns, follows.alias("selected"), reason.alias("reason"))


def followed(chosen: DataFrame) -> DataFrame:
    """What selected() comes to for each outlet: outlet_id, rss_urls, sitemap_urls (in order of trial), limitations."""
    urls = lambda kinds: F.transform(F.array_sort(F.collect_list(F.when(F.col("selected") & F.col("kind").isin(*kinds), F.struct("place", "url")))), lambda x: x["url"])
    out = chosen.groupBy("outlet_id").agg(urls(["rss", "atom"]).alias("rss_urls"), urls(["news_sitemap", "sitemap", "sitemap_index"]).alias("sitemap_urls"), F.bool_or((F.col("kind") == "news_sitemap") & F.col("same_as").isNull() & (F.col("selected") | (F.col("reason") == CHILD))).alias("_news"))
    none = lambda c: F.size(c) == 0
    limits = F.array_compact(F.array(F.when(none("rss_urls"), "no_rss"), F.when(none("sitemap_urls"), "no_sitemap").when(~F.coalesce(F.col("_news"), F.lit(False)), "no_news_sitemap")))
    return out.select("outlet_id", "rss_urls", "sitemap_urls", limits.alias("limitations"))


def children(entries: DataFrame, cutoff: Column, most: int = CHILDREN) -> DataFrame:
    """The sitemaps to read of each index: entries(listing_id, position, root, url, date) that are on the site, the most recent
    of those not before the cutoff, by date and then URL, descending; of an index without any date the first that have news in
    their path."""
    here = entries.where(same_site(F.col("url"), F.col("root")))
    whole = Window.partitionBy("listing_id")
    told = here.withColumn("_dated", F.bool_or(F.col("date").isNotNull()).over(whole))
    recent = told.where(F.col("_dated") & (F.col("date") >= cutoff)).withColumn("_n", F.row_number().over(whole.orderBy(F.desc("date"), F.desc("url")))).where(F.col("_n") <= most)
    named = told.where(~F.col("_dated") & F.contains(F.lower(path(F.col("url"))), F.lit("news"))).withColumn("_n", F.row_number().over(whole.orderBy("position"))).where(F.col("_n") <= UNDATED_CHILDREN)
    return recent.union(named).select("listing_id", F.col("_n").alias("rank"), "url", "date")

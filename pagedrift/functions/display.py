"""How figures and changes are shown to readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii of a day's mark, the archive's address, and words of an error by which it asks for patience.
LEAST_RADIUS, MOST_RADIUS = 2.2, 6.8
ARCHIVE = "https://web.archive.org"
PATIENCE = ["too-many", "session-limit", "rate-limit", "overloaded"]


def changed_fields(kind: Column, event: str = "e") -> Column:
    """What an event of this type changed, as an array of (before, after, diff): only the field that gave rise to it.

    event is a struct with from_ and to_ headline, byline, published_at and final_url, and body_diff. Events of absence and
    return have no field.
    """
    pair = lambda name: F.array(F.struct(F.col(f"{event}.from_{name}").alias("before"), F.col(f"{event}.to_{name}").alias("after"), F.lit(None).cast("string").alias("diff")))
    body = F.struct(F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"), F.col(f"{event}.body_diff").alias("diff"))
    none = F.array().cast("array<struct<before:string,after:string,diff:string>>")
    found = F.when(kind == "HEADLINE_CHANGED", pair("headline")).when(kind.isin("BYLINE_CHANGED", "BYLINE_REMOVED"), pair("byline"))
    found = found.when(kind == "DATE_CHANGED", pair("published_at")).when(kind == "REDIRECTED", pair("final_url"))
    return found.when((kind == "BODY_CHANGED") & F.coalesce(F.col(f"{event}.body_diff") != "", F.lit(False)), F.array(body)).otherwise(none)


def percent(share: Column) -> Column:
    """A share in per cent: one digit after the point under ten per cent, else none."""
    small = (share > 0) & (share < 0.1)
    return F.concat(F.when(small, F.format_number(share * 100, 1)).otherwise(F.format_number(share * 100, 0)), F.lit("%"))


def radius(value: Column, most: Column) -> Column:
    """Radius of a day's mark: its area grows with the value."""
    return F.lit(LEAST_RADIUS) + F.lit(MOST_RADIUS - LEAST_RADIUS) * F.sqrt(value / most)


def nice(value: Column) -> Column:
    """A number of one digit, and zeros, near the value; whole and 1 at least up to ten."""
    ten = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    return F.when(value <= 10, F.greatest(F.lit(1.0), F.floor(value + 0.5))).otherwise(F.floor(value / ten + 0.5) * ten)


def local_time(at: Column, zone: str = "Asia/Dhaka") -> Column:
    """A moment as reviewers read it: local date and time to the minute."""
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm")


def archive_url(location: Column) -> Column:
    """The address of an archived copy that a redirect points to; null if it points to none."""
    stamp, original = F.regexp_extract(location, r"/web/(\d{14})/(.+)$", 1), F.regexp_extract(location, r"/web/(\d{14})/(.+)$", 2)
    return F.when(stamp != "", F.concat(F.lit(f"{ARCHIVE}/web/"), stamp, F.lit("/"), original))


def archive_job(answer: Column) -> Column:
    """The name of an archiving job in an answer; null without one."""
    found = F.regexp_extract(answer, r"spn2-[0-9a-f]{20,}", 0)
    return F.when(found != "", found)


def archive_failure(error: Column) -> Column:
    """rate_limited if an error asks for patience, else error."""
    return F.when(F.exists(F.array(*map(F.lit, PATIENCE)), lambda w: F.contains(F.lower(error), w)), "rate_limited").otherwise("error")

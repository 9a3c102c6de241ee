"""Outcomes of fetches, retries and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of a challenge page, hours of the recheck schedule, seconds a server may ask to wait.
CHALLENGE_MARKERS = ["challenge-platform", "cf-chl-", "cf_chl_opt", "<title>Just a moment...</title>", "Attention Required! | Cloudflare"]
SCHEDULE_HOURS = [1, 6, 24, 72, 168, 720, 2160, 8760]
LONGEST_WAIT = 300
# Characters kept of an error, months and zones of mail dates.
ERROR_CHARS = 2000
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MAIL_ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def outcome(status: Column, mitigated: Column, server: Column, body: Column) -> Column:
    """ok, http_error, rate_limited or cf_challenge for an exchange that got a status."""
    head = F.substring(F.coalesce(body, F.lit("")), 1, 32_768)
    marked = F.exists(F.array(*map(F.lit, CHALLENGE_MARKERS)), lambda m: F.contains(head, m))
    guarded = status.isin(403, 429, 503) & F.contains(F.lower(F.coalesce(server, F.lit(""))), F.lit("cloudflare"))
    challenge = (F.lower(F.coalesce(mitigated, F.lit(""))) == "challenge") | (guarded & marked)
    return F.when(challenge, "cf_challenge").when(status == 429, "rate_limited").when(status.between(200, 299), "ok").otherwise("http_error")


def retryable(result: Column, status: Column) -> Column:
    return F.coalesce(result.isin("timeout", "conn_error", "rate_limited") | ((result == "http_error") & (status >= 500)), F.lit(False))


def retry_delay(attempt: Column, retry_after: Column, base: float = 2.0) -> Column:
    """Seconds before the next attempt: doubled each time, or what the server asks for up to LONGEST_WAIT, if that is more."""
    own = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    return F.greatest(own, F.least(F.coalesce(retry_after.cast("double"), F.lit(0.0)), F.lit(float(LONGEST_WAIT))))


def capture_label(result: Column, status: Column, html: Column) -> Column:
    """What a capture came to, for counters of a run."""
    with_status = F.when(status.isNotNull(), F.concat(result, F.lit("_"), status.cast("string"))).otherwise(result)
    return F.when(result == "ok", F.when(html, "captured").otherwise("non_html")).when(retryable(result, status), F.concat(F.lit("retry_"), result)).otherwise(with_status)


def gone_kind(result: Column, status: Column) -> Column:
    return F.when(result == "robots_blocked", "ROBOTS_BLOCKED").when((result == "http_error") & (status == 404), "GONE_404").when((result == "http_error") & (status == 410), "GONE_410")


def recheck_after_hours(step: Column) -> Column:
    """Hours after first sight of the recheck with this number, from 0; null beyond the schedule."""
    return F.when(step >= 0, F.get(F.array(*map(F.lit, SCHEDULE_HOURS)), step))


def age_band(hours: Column) -> Column:
    """1 for the first hour to 9 beyond a year; a bound belongs to the band it ends."""
    return (F.lit(1) + F.size(F.filter(F.array(*[F.lit(float(h)) for h in SCHEDULE_HOURS]), lambda b: b < hours))).cast("int")


def is_html(content_type: Column, body: Column) -> Column:
    """By the content type, or without one by how the first 512 characters begin."""
    kind = F.lower(F.trim(F.split(content_type, ";")[0]))
    start = F.lower(F.ltrim(F.substring(F.coalesce(body, F.lit("")), 1, 512)))
    return F.when(F.coalesce(kind, F.lit("")) != "", kind.isin("text/html", "application/xhtml+xml")).otherwise(F.startswith(start, F.lit("<!doctype html")) | F.startswith(start, F.lit("<html")))


def queue_state(attempts: Column, most: Column, base: float) -> tuple[Column, Column]:
    """Status and seconds of delay after a failure: parked at the last attempt, else doubled delays."""
    parked = attempts >= most
    return F.when(parked, "parked").otherwise("pending"), F.when(~parked, F.lit(base) * F.pow(F.lit(2.0), attempts - 1))


def cut_error(text: Column) -> Column:
    """What is kept of an error's text."""
    return F.substring(text, 1, ERROR_CHARS)


_MAIL = r"^(?:[A-Za-z]+\.?,?\s*)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*\.?[\s-]+(\d{2,4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?(?:\s*([+-]\d{4}|[A-Za-z]+))?\s*(?:\(.*\))?$"
_ISO = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2}(?:[.,]\d{1,6})?)\d*)?)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"


def parsed_date(text: Column) -> Column:
    """Timestamp of a date as mail (RFC 2822, with its old forms) or ISO 8601 writes it; without an offset it is UTC,
    whatever the session's zone; null if it is neither or names no day."""
    bare = F.trim(text)
    mail = lambda i: F.regexp_extract(bare, _MAIL, i)
    iso = lambda i: F.regexp_extract(bare, _ISO, i)
    zones = F.create_map(*[F.lit(x) for pair in MAIL_ZONES.items() for x in pair])
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])
    number = lambda c: F.coalesce(F.when(c != "", c).try_cast("int"), F.lit(0))
    year = mail(3).try_cast("int")
    year = F.when(F.length(mail(3)) == 4, year).when(F.length(mail(3)) == 2, F.when(year > 68, year + 1900).otherwise(year + 2000))
    zone = F.when(mail(7).rlike(r"^[+-]"), mail(7)).otherwise(F.coalesce(F.try_element_at(zones, F.upper(mail(7))), F.lit("+0000")))
    colon = lambda z: F.regexp_replace(z, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    by_mail = F.try_make_timestamp(year, F.try_element_at(months, F.lower(mail(2))), mail(1).try_cast("int"), number(mail(4)), number(mail(5)), number(mail(6)).cast("decimal(8,6)"), colon(zone))
    seconds = F.coalesce(F.regexp_replace(iso(6), ",", ".").try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))
    by_iso = F.try_make_timestamp(iso(1).try_cast("int"), iso(2).try_cast("int"), iso(3).try_cast("int"), number(iso(4)), number(iso(5)), seconds, F.when(iso(7).isin("", "Z"), "+00:00").otherwise(colon(iso(7))))
    return F.coalesce(F.when(mail(1) != "", by_mail), F.when(iso(1) != "", by_iso))

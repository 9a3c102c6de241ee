"""Canonical URLs and tests on them, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and first path segments of pages that list others.
TRACKING_NAMES = ["fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid", "igshid", "mc_cid", "mc_eid", "_ga", "_gl", "ref_src", "ocid", "cmpid", "s_cid"]
TRACKING_PREFIXES = ["utm_", "pk_", "mtm_", "hsa_"]
LISTING_SEGMENTS = ["tag", "tags", "topic", "topics", "category", "categories", "author", "authors", "search", "page", "pages", "archive", "archives", "articlelist"]

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


#: White space as Python counts it, and what browsers strip before a scheme.
_SPACE = r"[\x00-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _part(url: Column, i: int) -> Column:
    bare = F.regexp_replace(url, rf"^{_SPACE}+|{_SPACE}+\z", "")
    return F.regexp_extract(F.translate(bare, "\t\r\n", ""), _SPLIT, i)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Host in lower case, without user, port and final dots."""
    name = F.regexp_replace(F.lower(_part(url, 2)), r"^.*@", "")
    return F.regexp_replace(F.regexp_replace(name, r":\d*$", ""), r"\.+$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(_part(url, 2), r":(\d+)$", 1)


def path(url: Column) -> Column:
    return _part(url, 3)


def pathname(url: Column) -> Column:
    """The path as browsers show it: "/" if there is none."""
    return F.when(path(url) == "", "/").otherwise(path(url))


def site(url_host: Column) -> Column:
    """Host without its www."""
    return F.regexp_replace(F.rtrim(F.lower(url_host)), r"^www\.", "")


def _decoded(x: Column) -> Column:
    """x without its escapes; a percent sign that begins none stands for itself."""
    return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """URL in the one form under which a document is known; null for null or if the port is no number up to 65535.

    Scheme and host in lower case; user, default port, fragment and tracking parameters dropped; parameters sorted; the
    path untouched, or "/" if empty.
    """
    pairs = F.transform(
        F.filter(F.split(_part(url, 4), "&"), lambda p: p != ""),
        lambda p: F.struct(_decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, r"^[^=]*=?(.*)$", 1)).alias("v")),
    )
    tracks = lambda k: k.isin(TRACKING_NAMES) | F.exists(F.array(*map(F.lit, TRACKING_PREFIXES)), lambda x: F.startswith(k, x))
    kept = F.array_sort(F.filter(pairs, lambda p: ~tracks(F.lower(p["k"]))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    default = ((scheme(url) == "http") & (port(url) == "80")) | ((scheme(url) == "https") & (port(url) == "443"))
    netloc = F.concat(host(url), F.when((port(url) == "") | default, "").otherwise(F.concat(F.lit(":"), port(url).try_cast("int").cast("string"))))
    named = F.regexp_replace(_part(url, 2), r"^.*@", "")
    bad = named.rlike(r":[^:\]]*[^\d:\]][^:\]]*$") | ((port(url) != "") & F.coalesce(port(url).try_cast("int") > 65535, F.lit(True)))
    out = F.concat(scheme(url), F.lit("://"), netloc, F.when(path(url) == "", "/").otherwise(path(url)), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.isNotNull() & ~bad, out)


def url_hash(url: Column) -> Column:
    """SHA-256 of a URL as it stands."""
    return F.sha2(url, 256)


def same_site(url: Column, root: Column) -> Column:
    """Whether a URL's host is the root site or below it."""
    h = site(host(url))
    return (h == root) | F.endswith(h, F.concat(F.lit("."), root))


def lists_others(url: Column) -> Column:
    """Whether the first path segment names a kind of listing."""
    first = F.get(F.filter(F.split(path(url), "/"), lambda s: s != ""), F.lit(0))
    return F.coalesce(F.lower(first).isin(LISTING_SEGMENTS), F.lit(False))

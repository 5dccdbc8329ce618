"""URL functions as column expressions over the parts of RFC 3986's own pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarisk.functions.text import text, unescape
from tamarisk.rules import TRACKING_KEYS, TRACKING_PREFIX, VOLATILE_KEYS

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, which: str) -> Column:
    """scheme, host, path, query or fragment, '' where it is missing."""
    return F.regexp_extract(url, f"(?s){PARTS}", ("scheme", "host", "path", "query", "fragment").index(which) + 1)


def _decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encode(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """The pairs of a query as structs (key, value), decoded; blank values are kept, empty segments are not."""
    segments = F.filter(F.split(query, "&"), lambda x: x != "")
    value = lambda x: F.when(x.contains("="), F.regexp_extract(x, "(?s)=(.*)$", 1)).otherwise("")
    pair = lambda x: F.named_struct(F.lit("key"), _decode(F.substring_index(x, "=", 1)), F.lit("value"), _decode(value(x)))
    return F.transform(segments, pair)


def joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))), "&")


def without_keys(pairs: Column, keys, prefix: str = TRACKING_PREFIX) -> Column:
    return F.filter(pairs, lambda p: ~(F.lower(p["key"]).isin(list(keys)) | F.lower(p["key"]).startswith(prefix)))


def _strip(url: Column) -> Column:
    return F.regexp_replace(url, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _slashless(path: Column) -> Column:
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(bare == "", path).otherwise(bare)


def _built(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    authority = F.when(host != "", F.concat(F.lit("//"), host, F.when((path != "") & ~path.startswith("/"), F.lit("/")).otherwise(""))).otherwise("")
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), authority, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def canonicalize_url(x: Column | str) -> Column:
    """Lower scheme (https without one) and host, no trailing slash, no tracking parameters, no fragment."""
    url = _strip(text(x))
    scheme, host = F.lower(part(url, "scheme")), F.lower(part(url, "host"))
    scheme = F.when(scheme == "", F.lit("https")).otherwise(scheme)
    query = joined(without_keys(query_pairs(part(url, "query")), TRACKING_KEYS))
    return F.when(text(x) == "", F.lit("")).otherwise(_built(scheme, host, _slashless(part(url, "path")), query))


def numbered_id(x: Column | str) -> Column:
    """The digits of a posting's path, after an optional slug."""
    return F.regexp_extract(text(x), r"(?i)/jobs/view/(?:[^/?#]*-)?(\d+)(?:[/?#]|$)", 1)


def slug_id(x: Column | str) -> Column:
    """The segment after /jobs/p/."""
    return F.regexp_extract(text(x), r"/jobs/p/([^/?#]+)", 1)


def canonicalize_numbered(x: Column | str, site: str, host: str) -> Column:
    """The site's host and the posting's number; without a number the plain host and no volatile parameters."""
    url = unescape(_strip(text(x)))
    found, there = part(url, "host"), F.lower(part(url, "host")).contains(site)
    path = _slashless(part(url, "path"))
    number = F.coalesce(F.nullif(numbered_id(path), F.lit("")), numbered_id(x))
    query = joined(without_keys(query_pairs(part(url, "query")), VOLATILE_KEYS))
    plain = _built(F.lit("https"), F.when(there, F.lit(host)).otherwise(F.lower(found)), path, query)
    return F.when(text(x) == "", F.lit("")).when((number != "") & there, F.concat(F.lit(f"https://{host}/jobs/view/"), number)).otherwise(plain)


def resolve(x: Column | str, base: str) -> Column:
    """A link of a page made absolute with the site's base (scheme and host)."""
    url = text(x)
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(F.lit(base.split("//")[0]), url))
        .when(url.startswith("/"), F.concat(F.lit(base), url))
        .otherwise(F.concat(F.lit(base + "/"), url))
    )


def without_query(x: Column) -> Column:
    return F.substring_index(x, "?", 1)


def with_start(x: Column | str, start: Column) -> Column:
    """The page offset added or replaced; unchanged where start is not positive."""
    url = text(x)
    pairs = F.filter(query_pairs(part(url, "query")), lambda p: p["key"] != "start")
    query = F.concat_ws("&", F.nullif(joined(pairs), F.lit("")), F.concat(F.lit("start="), start.cast("string")))
    fragment = part(url, "fragment")
    made = F.concat(_built(part(url, "scheme"), part(url, "host"), part(url, "path"), query), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.when(start <= 0, url).otherwise(made)


def legacy_url_id(x: Column | str) -> Column:
    """Cut at the first utm parameter, no trailing slashes, lower case."""
    return F.lower(F.regexp_replace(F.substring_index(F.substring_index(text(x), "?utm", 1), "&utm", 1), "/+$", ""))

"""Text functions as column expressions; only the decoding of HTML entities needs Python (Arrow batches)."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tamarisk.rules import COMPANY_SUFFIXES, LEGACY_NOISE

# White space as Python's \s has it: Unicode white space and the four separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def array_of(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def contains_any(lowered: Column, patterns) -> Column:
    """Is one of the patterns (lower case) a substring of the lowered text? Without patterns never."""
    return F.exists(array_of(patterns), lambda p: F.contains(lowered, p))


def matches_any(x: Column | str, patterns) -> Column:
    """contains_any whatever the case of text and patterns."""
    return contains_any(F.lower(text(x)), [p.lower() for p in patterns])


def collapse(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(x), SPACE, " "))


def normalize_text(x: Column | str) -> Column:
    """Null to '', lower case, white space runs to one space."""
    return collapse(F.lower(text(x)))


def normalize_company(x: Column | str) -> Column:
    """X1 without legal forms as whole words, and without marks at the ends."""
    bare = F.regexp_replace(normalize_text(x), rf"(?U)\b({'|'.join(COMPANY_SUFFIXES)})\b", "")
    return F.btrim(F.regexp_replace(bare, SPACE, " "), F.lit(" ,.-"))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(x: Column | str) -> Column:
    """HTML entities decoded; only texts with an ampersand travel to Python."""
    c = _c(x)
    return F.when(c.contains("&"), _unescape(F.when(c.contains("&"), c))).otherwise(c)


def clean_a(x: Column | str) -> Column:
    """Scripts, styles and tags out, then entities decoded, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text(x), r"(?is)<script\b.*?</script>", " "), r"(?is)<style\b.*?</style>", " ")
    return collapse(unescape(F.regexp_replace(bare, r"<[^>]+>", " ")))


def clean_b(x: Column | str) -> Column:
    """Entities decoded first, then tags out, white space collapsed, blanks and dashes off the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(unescape(text(x)), r"<[^>]+>", " "), SPACE, " "), F.lit(" \n\t-"))


def escape(x: Column | str) -> Column:
    """Ampersand, less and greater; quotes stay."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), text(x))


def escape_list(x: Column | str) -> Column:
    """X5 of a list: its items joined by comma and space."""
    return escape(F.array_join(_c(x), ", "))


def flatten_tags(tags: Column | str) -> Column:
    """The tags joined by spaces, null tags left out."""
    return F.coalesce(F.array_join(_c(tags), " "), F.lit(""))


def flat_items(raw: Column | str) -> Column:
    """X6 at the border: a JSON list of texts, lists of texts (one level) or objects with a name or label, as texts."""
    items = F.from_json(_c(raw), "array<string>")
    nested = F.transform(items, lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).when(x.startswith("{"), F.array(F.coalesce(F.nullif(F.get_json_object(x, "$.name"), F.lit("")), F.get_json_object(x, "$.label"), F.lit("")))).otherwise(F.array(x)))
    return F.coalesce(F.flatten(nested), F.array().cast("array<string>"))


def tags_from_json(raw: Column | str) -> Column:
    """A JSON list of texts; anything else, malformed text too, is the empty list."""
    return F.coalesce(F.from_json(F.when(F.trim(_c(raw)).startswith("["), _c(raw)), "array<string>"), F.array().cast("array<string>"))


def tags_to_json(tags: Column | str) -> Column:
    """A JSON list of texts with ', ' between items."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(_c(tags), F.array().cast("array<string>")), lambda t: F.regexp_extract(F.to_json(F.array(t)), r"(?s)^\[(.*)\]$", 1)), ", "), F.lit("]"))


def patterns_present(cleaned: Column, patterns, most: int) -> Column:
    """Which patterns the text holds, whatever the case, in the order of the patterns, each once, the first `most`."""
    lowered = F.lower(cleaned)
    return F.slice(F.filter(array_of(list(dict.fromkeys(patterns))), lambda p: F.contains(lowered, F.lower(p))), 1, most)


def relative_age(cleaned: Column) -> Column:
    """Seconds since a card was posted, null where no age (or one in months) is visible."""
    low = F.lower(cleaned)
    units = (("minute|minutes|min|mins", 60), ("hour|hours|hr|hrs", 3600), ("day|days", 86400), ("week|weeks", 604800))
    ages = []
    for unit, seconds in units:
        found = F.regexp_extract(low, rf"(\d+)\s*(?:{unit})\s+ago", 1)
        ages.append(F.nullif(found, F.lit("")).try_cast("long") * seconds)
    return F.when(low.contains("just now") | low.contains("moments ago"), F.lit(0).cast("long")).otherwise(F.coalesce(*ages))


def legacy_id(title: Column | str, company: Column | str) -> Column:
    """The older identity, with its substring replacement."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    name = reduce(lambda c, noise: strip(F.replace(c, F.lit(noise), F.lit(""))), LEGACY_NOISE, strip(F.lower(text(company))))
    return F.concat(strip(F.lower(text(title))), F.lit("|"), name)


def title_case(x: Column | str) -> Column:
    """Every run of letters with a capital first, so also after a dash."""
    parts = F.regexp_extract_all(F.lower(text(x)), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")

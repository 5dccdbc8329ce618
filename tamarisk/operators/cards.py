"""Search-result pages to postings: site A's links with the gaps between them, site B's list items.

A page is parsed in its own row with built-in regular expressions; the page's HTML is dropped as soon as it is cut into
cards.  First-wins rules within a page and across pages are ranks over (key, arrival), never dropDuplicates, which does not
say which row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk import rules as R
from tamarisk.functions import text as T
from tamarisk.functions import urls as U
from tamarisk.operators import filters

# Patterns of the two sites' pages.
LINK = r"""(?is)<a\b[^>]*href=["']([^"']*/jobs/p/[^"']+)["'][^>]*>(.*?)</a>"""
CAREER = r"""(?is)<a\b[^>]*href=["'][^"']*/jobs/careers/[^"']+["'][^>]*>(.*?)</a>"""
SPAN = r"(?is)<span\b[^>]*>(.*?)</span>"
TAG = r"(?is)<(?:a\b[^>]*>(.*?)</a>|span\b[^>]*>(.*?)</span>)"
ITEM = r"(?is)<li\b[^>]*>(.*?)</li>"
BASE_CARD = r"""(?is)<div\b[^>]*class=["'][^"']*base-card[^"']*["'].*?</div>\s*</div>\s*</div>"""
TITLE_B = r"""(?is)class=["'][^"']*base-search-card__title[^"']*["'][^>]*>(.*?)</(?:h3|a|span|div)>"""
COMPANY_B = r"""(?is)class=["'][^"']*base-search-card__subtitle[^"']*["'][^>]*>(.*?)</(?:h4|a|span|div)>"""
PLACE_B = r"""(?is)class=["'][^"']*job-search-card__location[^"']*["'][^>]*>(.*?)</span>"""


def first_per(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of the rows of one key the first in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def last_per(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of the rows of one key the last in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))).where("_r = 1").drop("_r")


def gaps(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, href, title, card): links to postings, each with what stands between it and the next such link."""
    parts = pages.select(key, F.regexp_extract_all("html", F.lit(LINK), 1).alias("h"), F.regexp_extract_all("html", F.lit(LINK), 2).alias("t"), F.split("html", LINK).alias("s"))
    zipped = F.arrays_zip(F.col("h").alias("href"), F.col("t").alias("title"), F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))).alias("card"))
    return parts.select(key, F.posexplode(zipped).alias("pos", "x")).select(key, "pos", "x.*")


def _company_a(card: Column) -> Column:
    return F.btrim(T.clean_a(F.regexp_extract(card, CAREER, 1)), F.lit(" -"))


def company_location(cards: DataFrame, key: list[str]) -> DataFrame:
    """(keys, company, location) of cards: the careers link, the first span behind it that looks like a place; where
    one is missing, "company - place, country" in the cleaned text."""
    rest = F.when(F.col("card").rlike(CAREER), F.element_at(F.split("card", CAREER, 2), 2)).otherwise(F.col("card"))
    rows = cards.select(*key, _company_a(F.col("card")).alias("company"), T.clean_a("card").alias("whole"), F.regexp_extract_all(rest, F.lit(SPAN), 1).alias("spans"))
    spans = rows.select(*key, F.posexplode("spans").alias("at", "raw")).select(*key, "at", F.btrim(T.clean_a("raw"), F.lit(" -")).alias("span"))
    places = spans.where(filters.looks_like_location(F.col("span"))).groupBy(*key).agg(F.min_by("span", "at").alias("place"))
    fallback = rf"(?i)([^\n|]+?)\s+-\s+([^\n]+?(?:{'|'.join(R.A_COUNTRIES)}))"
    found = rows.join(places, key, "left").withColumn("place", F.coalesce("place", F.lit("")))
    missing = (F.col("company") == "") | (F.col("place") == "")
    take = lambda have, group: F.when(missing & (have == ""), F.trim(F.regexp_extract("whole", fallback, group))).otherwise(have)
    return found.select(*key, take(F.col("company"), 1).alias("company"), take(F.col("place"), 2).alias("location"), "whole")


def tags_a(cards: DataFrame, key: list[str]) -> DataFrame:
    """(keys, tags): texts of links and spans that are no navigation and no noise, each once, the first 18."""
    raw = cards.select(*key, F.posexplode(F.arrays_zip(F.regexp_extract_all("card", F.lit(TAG), 1).alias("a"), F.regexp_extract_all("card", F.lit(TAG), 2).alias("b"))).alias("at", "x"))
    rows = raw.select(*key, "at", T.clean_a(F.coalesce(F.nullif("x.a", F.lit("")), F.col("x.b"))).alias("tag"))
    rows = rows.where((F.col("tag") != "") & ~F.lower("tag").isin(R.A_BLOCKED_TAGS) & ~filters.is_noise_tag(F.col("tag")))
    kept = rows.groupBy(*key, "tag").agg(F.min("at").alias("at")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "tag"))).alias("x"))
    return kept.select(*key, F.slice(F.col("x.tag"), 1, R.MOST_TAGS_A).alias("tags"))


def parse_a(pages: DataFrame, base: str, source: str) -> DataFrame:
    """Pages (page_id, html) of site A to postings with (page_id, pos), each page's postings once by address."""
    key = ["page_id", "pos"]
    links = gaps(pages).select(*key, U.without_query(U.resolve(T.unescape("href"), base)).alias("url"), T.clean_a("title").alias("title"), "card")
    links = first_per(links.where("title <> ''"), ["page_id", "url"], "pos")
    types = T.patterns_present(F.col("whole"), R.A_JOB_TYPES + R.A_WORKPLACES, R.MOST_TYPES)
    fields = company_location(links, key).select(*key, "company", "location", F.array_join(types, " | ").alias("job_type"), filters.remote_text_a(F.col("whole")).alias("is_remote"))
    rows = links.drop("card").join(fields, key).join(tags_a(links, key), key, "left")
    return _posting(rows.withColumn("source_job_id", U.slug_id("url")), source)


def parse_b(pages: DataFrame, base: str, host: str, site: str, source: str, most_seconds: int | None = None) -> DataFrame:
    """Pages (page_id, html, params) of site B to postings: open and fresh cards, each address once (D3)."""
    items, cards = F.regexp_extract_all("html", F.lit(ITEM), 1), F.regexp_extract_all("html", F.lit(BASE_CARD), 0)
    rows = pages.select("page_id", "params", F.posexplode(F.when(F.size(items) > 0, items).otherwise(cards)).alias("pos", "card"))
    rows = rows.withColumn("whole", T.clean_b("card"))
    rows = rows.where(~filters.is_closed(F.col("whole")) & ~filters.is_stale(F.col("whole"), most_seconds))
    href = rf"""(?i)href=["'](https?://[^"']*{site.replace('.', '[.]')}/jobs/view/[^"']+|/jobs/view/[^"']+)["']"""
    rows = rows.select("page_id", "pos", "params", "card", "whole", T.clean_b(F.regexp_extract("card", TITLE_B, 1)).alias("title"), T.unescape(F.regexp_extract("card", href, 1)).alias("raw"))
    rows = rows.where("title <> '' AND raw <> ''").withColumn("url", U.canonicalize_numbered(U.resolve("raw", base), site, host))
    rows = first_per(rows, ["page_id", "url"], "pos")
    place = T.clean_b(F.regexp_extract("card", PLACE_B, 1))
    rows = rows.withColumns({
        "company": T.clean_b(F.regexp_extract("card", COMPANY_B, 1)),
        "location": F.coalesce(F.nullif(place, F.lit("")), F.try_element_at("params", F.lit("location")), F.lit("Remote")),
        "types": T.patterns_present(F.col("whole"), R.B_JOB_TYPES, R.MOST_TYPES),
    })
    remote = F.coalesce(F.try_element_at("params", F.lit("f_WT")) == "2", F.lit(False)) | filters.remote_signal_b(F.col("title"), F.col("location"), F.col("card"))
    rows = rows.withColumn("is_remote", remote)
    rows = rows.withColumn("tags", tags_b(F.col("types"), F.col("is_remote"))).withColumn("job_type", F.array_join("types", " | "))
    return _posting(rows.withColumn("source_job_id", U.numbered_id("url")), source)


def tags_b(types: Column, remote: Column) -> Column:
    """The types, and Remote where the work is remote; the first 8."""
    return F.slice(F.when(remote, F.array_union(types, F.array(F.lit("Remote")))).otherwise(types), 1, R.MOST_TAGS_B)


def _posting(rows: DataFrame, source: str) -> DataFrame:
    empty = F.lit("")
    return rows.select(
        "page_id", "pos", "title", "company", "location", "url", F.lit(source).alias("source"), empty.alias("salary"), "job_type",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "is_remote", empty.alias("original_source"), "source_job_id",
    )


def across_pages(postings: DataFrame, lowered: bool) -> DataFrame:
    """D2 (lowered, no trailing slashes) or D4 (as it is): of all pages' postings of one address the first."""
    key = F.regexp_replace(F.lower("url"), "/+$", "") if lowered else F.col("url")
    return first_per(postings.withColumn("_k", key), ["_k"], "page_id", "pos").drop("_k")

"""Scans of search-result pages: specifications, offsets, fetching with fault isolation, a Python data source.

Fetching is a seam: a fetcher is a function (url, params) -> html or None.  Each page is a row of a specification frame, so
many sites are fetched in parallel; a site with a pause between requests gets one partition of its own.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from tamarisk import rules as R
from tamarisk.functions.urls import with_start
from tamarisk.schema import PAGE

Fetcher = Callable[[str, dict], str | None]
AGENT = {"User-Agent": "Mozilla/5.0 (compatible; posting-reader)", "Accept": "text/html,application/xhtml+xml;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9"}


def get_text(url: str, params: dict | None = None, timeout: float = 15, headers: dict | None = None) -> str | None:
    """The body, or None on any error."""
    if params:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params)
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=AGENT | (headers or {})), timeout=timeout) as answer:  # noqa: S310
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except (OSError, ValueError):
        return None


def _json(request: urllib.request.Request, timeout: float):
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return json.loads(answer.read())
    except (OSError, ValueError):
        return None


def get_json(url: str, params: dict | None = None, headers: dict | None = None, timeout: float = 15):
    """The parsed answer, or None on any error."""
    if params:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params)
    return _json(urllib.request.Request(url, headers=AGENT | {"Accept": "application/json"} | (headers or {})), timeout)


def post_json(url: str, payload=None, headers: dict | None = None, timeout: float = 15):
    """The parsed answer to a JSON body, or None on any error."""
    body = None if payload is None else json.dumps(payload).encode()
    kind = {"Content-Type": "application/json", "Accept": "application/json"}
    return _json(urllib.request.Request(url, data=body or b"", headers=AGENT | kind | (headers or {}), method="POST"), timeout)


def _checked(pages: int, delay: float = 0) -> None:
    if pages < 1:
        raise ValueError("pages must be at least 1")
    if delay < 0:
        raise ValueError("delay must not be negative")


def specs_a(spark: SparkSession, urls: list[str], pages: int = 1, source: str = "a") -> DataFrame:
    """One row per search address and page, the offset in the address."""
    _checked(pages)
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "search_idx int, base string")
    rows = rows.withColumn("page_idx", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    return rows.select(F.lit(source).alias("source"), "search_idx", "page_idx", with_start("base", F.col("page_idx") * R.PAGE_SIZE_A).alias("url"), F.create_map().cast("map<string,string>").alias("params"))


def merged_params(defaults, params):
    """Defaults overridden by a search's own parameters (columns of maps)."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(params, k)), params)


def specs_b(spark: SparkSession, url: str, searches: list[dict[str, str]], pages: int = 1, delay: float = 0, fresh: int = R.FRESH_SECONDS, source: str = "b") -> DataFrame:
    """One row per search and page; freshness and order are parameters of the remote side, the offset always sent."""
    _checked(pages, delay)
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(searches)], "search_idx int, own map<string,string>")
    rows = rows.withColumn("page_idx", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    defaults = F.create_map(F.lit("f_TPR"), F.lit(f"r{fresh}"), F.lit("sortBy"), F.lit("DD"))
    start = F.create_map(F.lit("start"), (F.col("page_idx") * R.PAGE_SIZE_B).cast("string"))
    own = F.map_filter("own", lambda k, _: k != "start")
    return rows.select(F.lit(source).alias("source"), "search_idx", "page_idx", F.lit(url).alias("url"), F.map_concat(merged_params(defaults, own), start).alias("params"))


def fetched(specs: DataFrame, fetcher: Fetcher = get_text, delay: float = 0) -> DataFrame:
    """Specifications to PAGE rows; a page without an answer has a null html, a fetcher's exception counts as none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bodies = []
            for i, (url, params) in enumerate(zip(frame["url"], frame["params"])):
                if delay and i:
                    time.sleep(delay)
                try:
                    bodies.append(fetcher(url, dict(params or {})))
                except Exception:  # noqa: BLE001
                    bodies.append(None)
            yield frame.assign(html=bodies)[PAGE.fieldNames()]

    return (specs.coalesce(1) if delay else specs).mapInPandas(run, PAGE)


def loggable(params):
    """Parameters without secrets."""
    return F.map_filter(params, lambda k, _: ~F.lower(k).isin(R.SECRET_KEYS))


def scan_sources(spark: SparkSession, fetchers: dict[str, Callable[[], DataFrame | None]], now) -> tuple[DataFrame | None, DataFrame]:
    """The union of all sources' postings in the order of the registry, and a health row for each source.

    A source whose reader raises is recorded as an error, and the others go on; None counts as no rows."""
    found, health = None, []
    for i, (name, fetch) in enumerate(fetchers.items()):
        name, error = name.strip().lower(), ""
        try:
            rows = fetch()
            if rows is not None:
                rows = rows.withColumn("source_ord", F.lit(i))
                rows.isEmpty()  # faults of lazy readers show here, before the union
                found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        except Exception as e:  # noqa: BLE001
            error = str(e).split("\n")[0][:500]
        health.append((name, None, "error" if error else "ok", error, now, i))
    return found, spark.createDataFrame(health, "source string, last_run_at timestamp, status string, error string, at timestamp, seq int")


class _Page(InputPartition):
    def __init__(self, rows):
        self.rows = rows


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.wanted = options, {}

    def pushFilters(self, filters):  # noqa: N802
        """Equality on source and page_idx decides which pages are fetched at all."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("source",), ("page_idx",)) and self.wanted.setdefault(f.attribute[0], f.value) == f.value:
                continue  # a second equality with another value stays a filter
            yield f

    def partitions(self):
        urls = [u for u in self.options.get("urls", "").split("\n") if u]
        pages, source = int(self.options.get("pages", "1")), self.options.get("source", "a")
        _checked(pages)
        rows = []
        for i, url in enumerate(urls):
            for page in range(pages):
                if self.wanted.get("source", source) == source and self.wanted.get("page_idx", page) == page:
                    start = page * R.PAGE_SIZE_A
                    rows.append((source, i, page, f"{url}{'&' if '?' in url else '?'}start={start}" if start else url))
        delay = float(self.options.get("delay", "0"))
        return [_Page(rows)] if delay else [_Page([r]) for r in rows] or [_Page([])]

    def read(self, partition):
        module, _, name = self.options.get("fetcher", "tamarisk.sources.pages:get_text").partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for i, (source, search, page, url) in enumerate(partition.rows):
            if i:
                time.sleep(float(self.options.get("delay", "0")))
            yield source, search, page, url, {}, fetch(url, {})


class PageSource(DataSource):
    """spark.read.format("pages"): options urls (one per line), pages, source, delay, fetcher ("module:function")."""

    @classmethod
    def name(cls):
        return "pages"

    def schema(self):
        return PAGE

    def reader(self, schema):
        return _PageReader(self.options)

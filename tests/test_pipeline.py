import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamarisk.operators import merge
from tamarisk.schema import POSTING
from tamarisk.sources import pages, settings
from tamarisk.sources.store import Store
from tamarisk.streaming import pipeline
from tests.test_operators import RULES, postings

NOW = dt.datetime(2026, 1, 2)


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def cycle(spark, store, rows, sender, **more):
    return pipeline.run(spark, store, {"A ": lambda: postings(spark, *rows)} if rows is not None else {}, RULES, sender, NOW, **more)


def test_partial_then_only_the_missing_topic(spark, store, tmp_path):
    log = tmp_path / "sent"

    def sender(topic, message):
        with open(log, "a") as f:
            f.write(topic + "\n")
        return topic != "home" or log.read_text().count("home") > 1

    one = cycle(spark, store, [{}], sender)
    assert (one["inserted"], one["successes"], one["failures"], one["total"]) == (1, 2, 1, 1)
    assert store.read("jobs").first().send_status == "partial"
    two = cycle(spark, store, [{}], sender)
    assert (two["inserted"], two["refreshed"], two["successes"], two["failures"]) == (0, 1, 1, 0)
    assert store.read("jobs").first().send_status == "sent"
    three = cycle(spark, store, [{}], sender)
    assert three["processed"] == 0 and sorted(log.read_text().split()) == ["back", "general", "home", "home"]
    assert store.read("metadata").first().value == "1"


def test_seed_skips_and_stays_skipped(spark, store):
    assert cycle(spark, store, [{}], lambda *_: True, seed=True)["skipped"] == 1
    again = cycle(spark, store, [{}], lambda *_: True)
    assert again["refreshed"] == 1 and again["processed"] == 0 and store.read("job_sends").count() == 0


def test_a_failing_source_does_not_stop_others(spark, store):
    def broken():
        raise OSError("down")

    made = pipeline.run(spark, store, {"x": broken, " Y ": lambda: postings(spark, {}), "z": lambda: None}, RULES, lambda *_: True, NOW)
    health = {r.source: (r.status, r.error) for r in store.read("source_runs").collect()}
    assert health == {"x": ("error", "down"), "y": ("ok", ""), "z": ("ok", "")} and made["inserted"] == 1 and made["sources_failed"] == 1
    assert merge.last_run(store.read("source_runs"), "x").first().last_run_at == NOW


def test_nothing_to_do(spark, store):
    made = cycle(spark, store, None, lambda *_: True)
    assert made["total"] == 0 and made["processed"] == 0


def test_stream_equals_batches(spark, store, tmp_path):
    for i, rows in enumerate([[{}, {"url": "https://h.x/2"}], [{"salary": "9"}, {"url": "https://h.x/3"}]]):
        postings(spark, *rows).withColumn("arrival_seq", F.col("arrival_seq") + 10 * i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(POSTING).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    pipeline.stream(stream, store, RULES, lambda *_: True, lambda: NOW, f"{tmp_path}/cp").awaitTermination(240)
    rows = store.read("jobs").collect()
    assert len(rows) == 3 and {r.send_status for r in rows} == {"sent"} and store.read("job_sends").count() == 9
    assert sorted(r.id for r in rows) == [1, 2, 3]


def test_store_swaps_versions(spark, store):
    assert store.read("metadata").count() == 0
    store.commit(metadata=merge.replace_metadata(store.read("metadata"), "k", "1"))
    store.commit(metadata=merge.replace_metadata(store.read("metadata"), "k", "2"))
    assert [tuple(r) for r in store.read("metadata").collect()] == [("k", "2")]
    with pytest.raises(Exception, match="(?i)bad"):
        store.commit(metadata=store.read("metadata").withColumn("value", F.raise_error(F.lit("bad"))))
    assert store.read("metadata").first().value == "2"


def test_page_specs_and_fetching(spark):
    specs = pages.specs_a(spark, ["https://h.x/a"], 2)
    assert [r.url for r in specs.orderBy("page_idx").collect()] == ["https://h.x/a", "https://h.x/a?start=20"]
    b = pages.specs_b(spark, "https://h.x/s", [{"location": "X", "sortBy": "R"}], 2, 4)
    assert [r.params for r in b.orderBy("page_idx").collect()] == [{"f_TPR": "r3600", "sortBy": "R", "location": "X", "start": s} for s in ("0", "25")]
    for bad in (lambda: pages.specs_a(spark, [], 0), lambda: pages.specs_b(spark, "", [], 1, -1)):
        with pytest.raises(ValueError):
            bad()

    def fetch(url, params):
        if "start" in url:
            raise OSError
        return "<p>"

    assert [r.html for r in pages.fetched(specs, fetch).orderBy("page_idx").collect()] == ["<p>", None]
    r = spark.range(1).select(pages.loggable(F.create_map(F.lit("Token"), F.lit("x"), F.lit("q"), F.lit("y"))).alias("m")).first()
    assert r.m == {"q": "y"}


def fake(url, params):
    return f"<html>{url}</html>"


def test_page_data_source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader decides by filters which pages it fetches
    spark.dataSource.register(pages.PageSource)
    df = spark.read.format("pages").option("urls", "https://h.x/a\nhttps://h.x/b").option("pages", "2").option("fetcher", "tests.test_pipeline:fake").load()
    assert {r.html for r in df.collect()} == {f"<html>https://h.x/{x}</html>" for x in ("a", "b", "a?start=20", "b?start=20")}
    assert {r.url for r in df.where("page_idx = 1").collect()} == {"https://h.x/a?start=20", "https://h.x/b?start=20"}


def test_settings():
    assert settings.topic_ids({"a": "A", "b": "B", "c": "C"}, {"A": "12", "B": "x"}) == {"a": 12, "b": None, "c": None}
    assert settings.seed_mode(None, {"SEED_MODE": "Yes"}) and not settings.seed_mode(False, {"SEED_MODE": "1"}) and not settings.seed_mode(None, {})


def test_late_rows(spark):
    df = spark.createDataFrame([(1, NOW, 10), (2, NOW, 11), (3, NOW, None)], "id int, at timestamp, age long")
    made = {r.id: r.event_time for r in pipeline.fresh_only(df, "at", "age", 10).collect()}
    assert made == {1: NOW - dt.timedelta(seconds=10), 3: NOW}

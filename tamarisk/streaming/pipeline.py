"""The run cycle, as a batch and as a stream of micro-batches with the same result.

State that never expires (postings, deliveries) is in the store's tables, joined per batch, not in a stream's state store.
Delivery is at least once: results are written to a table of their own before the ledger is merged and the versions are
swapped in one step, so a crash before the swap sends again, and a crash after it does not.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import delivery, filters, merge, routing
from tamarisk.rules import QUEUE_LIMIT, RuleSet
from tamarisk.schema import SCHEMA_VERSION, store_form
from tamarisk.sources.pages import scan_sources
from tamarisk.sources.store import Store


def persist(store: Store, postings: DataFrame, rules: RuleSet, now: dt.datetime) -> dict[str, int]:
    """U8: filter, then merge into the jobs table. postings have arrival_seq."""
    # Written once: the counts, the merge and the fetch behind it would each run again otherwise.
    path = f"{store.root}/.batch-{uuid.uuid4().hex}"
    merge.with_identity(store_form(filters.runtime_filter(postings, rules))).write.parquet(path)
    given = store.spark.read.parquet(path)
    jobs = store.read("jobs")
    counts = merge.upsert_counts(jobs, given).first()
    store.commit(jobs=merge.upsert_jobs(jobs, given, F.lit(now)))
    store._fs.delete(store._path(path), True)
    return {"inserted": counts.inserted, "refreshed": counts.refreshed}


def send_pending(store: Store, rules: RuleSet, sender: delivery.Sender, now: dt.datetime, limit: int = QUEUE_LIMIT, configured: list[str] | None = None) -> dict[str, int]:
    """The queue's postings to the topics that they have not reached; ledger and states in one commit."""
    spark, jobs, ledger = store.spark, store.read("jobs"), store.read("job_sends")
    queued = routing.with_topics(delivery.queue(jobs, limit), rules).withColumn("message", routing.rendered(rules))
    todo = delivery.with_remaining(queued.select("id", "topics", "message"), ledger)
    path = f"{store.root}/.results-{uuid.uuid4().hex}"
    delivery.deliver(delivery.attempts(todo), sender, configured).write.parquet(path)
    results = spark.read.parquet(path)
    made = results.select(F.col("id").alias("job_id"), "topic_key", "success", "error", F.lit(now).alias("at"), F.col("ord").alias("seq"))
    ledger = merge.record_sends(ledger, made)
    states = todo.select("id", "topics").join(delivery.sent_topics(ledger).withColumnRenamed("job_id", "id"), "id", "left")
    states = states.select("id", delivery.status_of(F.col("topics"), F.coalesce("sent", F.array().cast("array<string>"))).alias("status"))
    counts = delivery.counters(results).first()
    processed = todo.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("topics") == 0).alias("skipped")).first()
    store.commit(jobs=merge.set_status(jobs, states), job_sends=ledger)
    store._fs.delete(store._path(path), True)
    return {"processed": processed.n, "skipped": processed.skipped, "successes": counts.successes, "failures": counts.failures}


def run(spark: SparkSession, store: Store, fetchers: dict[str, Callable[[], DataFrame | None]], rules: RuleSet, sender: delivery.Sender, now: dt.datetime, seed: bool = False, limit: int = QUEUE_LIMIT) -> dict[str, int]:
    """One cycle; the summary's counters."""
    found, health = scan_sources(spark, fetchers, now)
    summary = {"fetched": 0, "inserted": 0, "refreshed": 0, "processed": 0, "skipped": 0, "successes": 0, "failures": 0, "sources_failed": health.where("status = 'error'").count()}
    store.commit(source_runs=merge.record_source_runs(store.read("source_runs"), health), metadata=merge.replace_metadata(store.read("metadata"), "schema_version", SCHEMA_VERSION))
    if found is not None:
        summary["fetched"] = found.count()
        summary |= persist(store, found.withColumn("arrival_seq", F.col("source_ord") * (1 << 40) + F.col("arrival_seq")), rules, now)
    if seed:
        queued = delivery.queue(store.read("jobs"), 2**31 - 1).count()
        store.commit(jobs=delivery.seeded(store.read("jobs")))
        summary["skipped"] = queued
    else:
        summary |= send_pending(store, rules, sender, now, limit)
    return summary | {"total": store.read("jobs").count()}


def stream(postings: DataFrame, store: Store, rules: RuleSet, sender: delivery.Sender, clock: Callable[[], dt.datetime], checkpoint: str, limit: int = QUEUE_LIMIT, trigger: dict | None = None):
    """A stream of postings (with arrival_seq) through the same steps, micro-batch by micro-batch; one query per
    checkpoint writes the store."""

    def batch(rows: DataFrame, _: int) -> None:
        now = clock()
        persist(store, rows, rules, now)
        send_pending(store, rules, sender, now, limit)

    return postings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fresh_only(rows: DataFrame, fetched_at: str, age: str, most_seconds: int) -> DataFrame:
    """Rows whose visible age is within the limit, with their event time; an unknown age stays (no watermark would do)."""
    kept = rows.where(F.coalesce(F.col(age) <= most_seconds, F.lit(True)))
    return kept.withColumn("event_time", F.timestamp_seconds(F.unix_timestamp(fetched_at) - F.coalesce(age, F.lit(0))))

"""The queue, the targets not yet reached, the sink, and what came of it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.operators import filters
from tamarisk.rules import QUEUE_LIMIT, QUEUED_STATES
from tamarisk.sources.pages import post_json
from tamarisk.sources.shared import written

Sender = Callable[[str, str], bool]  # (topic_key, message) -> delivered?


def queue(jobs: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """The oldest queued postings (a top-k, no full sort)."""
    return jobs.where(F.col("send_status").isin(QUEUED_STATES)).orderBy("first_seen_at", "id").limit(limit)


def sent_topics(ledger: DataFrame) -> DataFrame:
    """(job_id, sent): the topics that each job has reached."""
    return ledger.where(F.col("status") == "sent").groupBy("job_id").agg(F.array_sort(F.collect_set("topic_key")).alias("sent"))


def with_remaining(queued: DataFrame, ledger: DataFrame) -> DataFrame:
    """Queued (id, topics) with `sent` and `remaining` (the topics not reached, in rule order)."""
    rows = queued.join(sent_topics(ledger).withColumnRenamed("job_id", "id"), "id", "left")
    rows = rows.withColumn("sent", F.coalesce("sent", F.array().cast("array<string>")))
    return rows.withColumn("remaining", F.array_except("topics", "sent"))


def status_of(topics: Column, sent: Column) -> Column:
    """A5: skipped without topics, sent when all are reached, partial when any is (even one no longer wanted), else retry."""
    return F.when(F.size(topics) == 0, "skipped").when(F.size(F.array_except(topics, sent)) == 0, "sent").when(F.size(sent) > 0, "partial").otherwise("retry")


def attempts(remaining: DataFrame) -> DataFrame:
    """K2: one row per job and topic still to be sent, in rule order: (id, ord, topic_key, message)."""
    return remaining.select("id", "message", F.posexplode("remaining").alias("ord", "topic_key"))


def deliver(rows: DataFrame, sender: Sender, configured: list[str] | None = None) -> DataFrame:
    """K1, K2: rows (id, ord, topic_key, message) through the sender, partition by partition: (id, ord, topic_key, success, error).

    A topic that is not configured fails without an attempt; an exception of the sender is a failure with its text.  The
    result must be written before it is read twice, or messages go out twice: see `tamarisk.streaming.pipeline`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done, errors = [], []
            for topic, message in zip(frame["topic_key"], frame["message"]):
                error = ""
                try:
                    good = bool(sender(topic, message)) if configured is None or topic in configured else False
                except Exception as e:  # noqa: BLE001
                    good, error = False, str(e)
                done.append(good)
                errors.append(error if error or good else "delivery failed")
            yield frame[["id", "ord", "topic_key"]].assign(success=done, error=errors)

    return rows.select("id", "ord", "topic_key", "message").mapInPandas(run, "id long, ord int, topic_key string, success boolean, error string")


class HttpSender:
    """K1: posts messages to an address as JSON, to the thread of their topic, with a pause after each attempt.

    `threads` maps topics to thread ids; a topic that has none is not configured and is refused without an attempt."""

    def __init__(self, url: str, chat: str, threads: dict[str, int], pause: float = 0.5, timeout: float = 10, post: Callable[..., object] | None = None):
        self.url, self.chat, self.threads, self.pause, self.timeout, self.post = url, chat, threads, pause, timeout, post

    def __call__(self, topic: str, message: str) -> bool:
        if topic not in self.threads:
            return False
        body = {"chat_id": self.chat, "message_thread_id": self.threads[topic], "text": message, "parse_mode": "HTML", "disable_web_page_preview": True}
        try:
            answer = (self.post or post_json)(self.url, body, timeout=self.timeout)
            return isinstance(answer, dict) and bool(answer.get("ok"))
        finally:
            time.sleep(self.pause)


def delete_messages(messages: DataFrame, deleter: Callable[[str, int], bool]) -> DataFrame:
    """K5: service messages (update_id, chat_id, message_id) through the deleter: with `deleted`; an exception is a failure."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def gone(chat: str, message: int) -> bool:
            try:
                return bool(deleter(chat, int(message)))
            except Exception:  # noqa: BLE001
                return False

        for frame in frames:
            yield frame.assign(deleted=[gone(c, m) for c, m in zip(frame["chat_id"], frame["message_id"])])

    return messages.select("update_id", "chat_id", "message_id").mapInPandas(run, "update_id long, chat_id string, message_id long, deleted boolean")


def deleted_count(done: DataFrame) -> DataFrame:
    """(n), how many messages were deleted."""
    return done.agg(F.count_if("deleted").alias("n"))


def clean_up(updates: DataFrame, order: str, group_id: str, deleter: Callable[[str, int], bool], acknowledge: Callable[[int], object]) -> int:
    """Deletes the group's service messages among the updates, then acknowledges all updates; the number deleted."""
    done = written(delete_messages(filters.service_messages(updates, group_id), deleter), "deleted")
    offset = filters.next_offset(updates, order).first().next_offset
    n = deleted_count(done).first().n
    if offset is not None:
        acknowledge(offset)
    return n


def default_false(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """Wanted (id, topic_key) with the result, false where there is none."""
    return wanted.join(results.select("id", "topic_key", "success"), ["id", "topic_key"], "left").withColumn("success", F.coalesce("success", F.lit(False)))


def counters(results: DataFrame) -> DataFrame:
    """A3: (attempts, successes, failures)."""
    return results.agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"))


def topic_successes(results: DataFrame) -> DataFrame:
    """Successes per topic, topics without any included."""
    return results.groupBy("topic_key").agg(F.sum(F.col("success").cast("long")).alias("n")).orderBy("topic_key")


def seeded(jobs: DataFrame) -> DataFrame:
    """K7: every queued posting skipped."""
    return jobs.withColumn("send_status", F.when(F.col("send_status").isin(QUEUED_STATES), "skipped").otherwise(F.col("send_status")))

"""Keyed merges: postings by content hash, deliveries by (job, topic), source health by source.

A merge reads a table, never writes it: it returns the new contents, and `tamarisk.sources.store` swaps versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.functions.urls import canonicalize_url
from tamarisk.operators.cards import last_per
from tamarisk.operators.filters import checked_status
from tamarisk.sources.shared import written

MUTABLE = ["source", "source_job_id", "title", "company", "location", "url", "canonical_url", "salary", "job_type", "tags", "is_remote", "original_source"]
RANGES = 4096


def content_hash(canonical: Column | str = "canonical_url") -> Column:
    """SHA-256 of title, company, location and canonical address in their normal forms."""
    return F.sha2(F.concat_ws("|", T.normalize_text("title"), T.normalize_company("company"), T.normalize_text("location"), T.text(canonical)), 256)


def with_identity(postings: DataFrame) -> DataFrame:
    return postings.withColumn("canonical_url", canonicalize_url("url")).withColumn("content_hash", content_hash())


def dense_ids(rows: DataFrame, order: str, start: Column | int, name: str = "id") -> DataFrame:
    """`name` = start + 1, start + 2, ... in the order of a number column.

    The numbers come from counts of value ranges and ranks within them.  RANGES equal ranges of values are cut again, each
    into as many as its share of the rows asks for: so clusters of numbers far apart are no single task either."""
    cut = lambda lo, hi, parts: F.least(F.floor((F.col(order) - F.col(lo)) / (F.col(hi) - F.col(lo) + 1.0) * parts), parts - 1)
    span = rows.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    coarse = rows.crossJoin(F.broadcast(span)).withColumn("_range", cut("_lo", "_hi", F.lit(RANGES))).drop("_lo", "_hi")
    each = coarse.groupBy("_range").agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    each = each.withColumn("_parts", F.ceil(F.col("_n") * RANGES / F.sum("_n").over(Window.partitionBy(F.lit(0)))))  # over RANGES rows at most
    fine = coarse.join(F.broadcast(each.drop("_n")), "_range").withColumn("_part", cut("_lo", "_hi", F.col("_parts"))).drop("_lo", "_hi", "_parts")
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)  # over 2 RANGES rows at most
    bases = fine.groupBy("_range", "_part").agg(F.count(F.lit(1)).alias("_n")).select("_range", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_range", "_part").orderBy(order))
    start = F.lit(start) if isinstance(start, int) else start
    return fine.join(F.broadcast(bases), ["_range", "_part"]).withColumn(name, start + F.col("_base") + rank).drop("_range", "_part", "_base")


def is_complete() -> Column:
    """Whether a posting has what it needs to be stored: title, address and hash."""
    return (T.text("title") != "") & (T.text("url") != "") & F.col("content_hash").isNotNull()


def _checked(incoming: DataFrame) -> DataFrame:
    message = F.lit("a posting to be stored needs title, address and hash")
    return incoming.withColumn("content_hash", F.when(is_complete(), F.col("content_hash")).otherwise(F.raise_error(message)))


def upsert_jobs(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The new contents of the jobs table. incoming: postings with arrival_seq, canonical_url and content_hash.

    Of several incoming postings of one hash the last one's values win, the first one's place gives the id.  A stored row
    keeps id, hash, state and first_seen_at and takes the other fields; a new row is pending.  A posting without title,
    address or hash is an error (see `is_complete`).

    Each hash is gathered once, to one row, and joined once with the stored rows; the ids of new rows are made from a
    narrow table of hashes, which is written because counts, ranges and ranks read it."""
    given = _checked(incoming)
    # The largest (seq) and so the last one's values, with a map-side combine.
    batch = given.groupBy("content_hash").agg(F.max_by(F.struct(*MUTABLE), "arrival_seq").alias("_new"))
    firsts = given.groupBy("content_hash").agg(F.min("arrival_seq").alias("_first"))
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = written(firsts.join(stored.select("content_hash"), "content_hash", "left_anti").crossJoin(F.broadcast(top)), "upsert-new")
    ids = dense_ids(fresh, "_first", F.col("_top"), "_id").select("content_hash", "_id")
    joined = stored.join(batch.join(ids, "content_hash", "left"), "content_hash", "full_outer")
    old, met = F.col("id").isNotNull(), F.col("_new").isNotNull()

    def value(c: str) -> Column:
        if c in MUTABLE:
            return F.when(met, F.col("_new")[c]).otherwise(F.col(c))
        made = {"id": F.col("_id"), "send_status": F.lit("pending"), "first_seen_at": now}
        if c == "last_seen_at":
            return F.when(met, now).otherwise(F.col(c))
        return F.when(old, F.col(c)).otherwise(made[c]) if c in made else F.col(c)

    return joined.select(*(value(c).alias(c) for c in stored.columns))


def upsert_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A2: (inserted, refreshed); a second copy within the batch counts as refreshed."""
    keys = _checked(incoming).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))
    known = stored.groupBy("content_hash").agg(F.first(F.lit(1)).alias("known"))
    rows = keys.join(known, "content_hash", "left").agg(F.count_if(F.col("known").isNull()).alias("inserted"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return rows.select("inserted", (F.col("total") - F.col("inserted")).alias("refreshed"))


def _merged(stored: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest wins among the changes; changes win over the stored."""
    new = last_per(changes, keys, *order).select(*stored.columns)
    return stored.join(new.select(*keys), keys, "left_anti").select(*stored.columns).unionByName(new)


def record_sends(ledger: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts (job_id, topic_key, success, error, at, seq) merged into the ledger; a failure clears sent_at."""
    rows = attempts.select(
        "job_id", "topic_key", F.when(F.col("success"), "sent").otherwise("failed").alias("status"), F.when(F.col("success"), F.col("at")).alias("sent_at"),
        F.coalesce("error", F.lit("")).alias("error"), F.col("at").alias("updated_at"), "seq",
    )
    return _merged(ledger, rows, ["job_id", "topic_key"], ["seq"])


def record_source_runs(health: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs (source, last_run_at or null, status, error, at, seq) merged; last_run_at defaults to the time of the run."""
    rows = runs.select("source", F.coalesce("last_run_at", "at").alias("last_run_at"), "status", F.coalesce("error", F.lit("")).alias("error"), F.col("at").alias("updated_at"), "seq")
    return _merged(health, rows, ["source"], ["seq"])


def set_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (id, status) applied to send_status; a status that is no legal state is an error, of several for
    one id the last in alphabetical order holds."""
    new = changes.select("id", checked_status(F.col("status")).alias("_s")).groupBy("id").agg(F.max("_s").alias("_s"))
    return jobs.join(new, "id", "left").withColumn("send_status", F.coalesce("_s", "send_status")).drop("_s").select(*jobs.columns)


def replace_metadata(metadata: DataFrame, key: str, value: str) -> DataFrame:
    """U6."""
    row = metadata.sparkSession.createDataFrame([(key, value)], metadata.schema)
    return metadata.where(F.col("key") != key).unionByName(row)


def last_run(health: DataFrame, source: str) -> DataFrame:
    """One row (last_run_at), none for an unknown source."""
    return health.where(F.col("source") == source).select("last_run_at")


def count_jobs(jobs: DataFrame) -> DataFrame:
    """A1."""
    return jobs.agg(F.count(F.lit(1)).alias("n"))

"""Problem 8: documents of several sources mixed to target weights.

Method: a time-varying curriculum.  Every source has a weight schedule over the training time t in [0, 1]; its integral
times the total is the source's cumulative token demand.  A source's documents stand one after the other (in an order given
by a hash of their ids; repeats follow as whole further passes), so each has a place on the source's token axis, and the
demand's inverse at that place is its training position.  The mix is the range sort of all documents by position.

The schedule is w(t) = share (1 + tilt (2 t - 1)), so the integral up to 1 is the target share whatever the tilt, and the
demand share total (t + tilt (t^2 - t)) is inverted in closed form.

The sums along a source's axis are made from sums of BUCKETS hash ranges of each source: windows are over one bucket or
over the bucket sums, so a source that holds a third of all rows is no single task.

Defined results: a source is used up to its target share of the total or `max_repeats` passes, whichever comes first, and
the shares report what came of it; sources without documents have share 0; documents of sources without target, and null
or empty texts (no tokens), are left out; a document is in if its first token is within the demand.
"""

from __future__ import annotations

import base64
import functools
import importlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern of the public byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 256
PIECE = 100_000  # characters given to the tokenizer at once, cut at a line break where there is one


@functools.lru_cache(2)
def _encoding(path: str):
    tiktoken = importlib.import_module("tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of documents with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            counts = [len(x) for x in encoding.encode_ordinary_batch(batch.column("text").to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(counts, pa.int64())], names=["doc_id", "source", "n_tokens"])

    texts = documents.select("doc_id", "source", "text").where("text <> '' AND source IS NOT NULL")
    return texts.mapInArrow(run, "doc_id long, source string, n_tokens long")


def _tilts(targets: DataFrame) -> DataFrame:
    """A tilt for each source: sources of small target share come later, and the tilts balance at every time."""
    rows = targets.where("target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    mean = rows.agg(F.sum(F.col("target_share") * F.col("target_share")).alias("m"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("raw", F.col("m") - F.col("target_share")).withColumn("tilt", F.col("raw") / F.greatest(F.lit(1e-9), F.lit(2.0) * F.greatest(F.col("m"), F.lit(1) - F.col("m"))))


def position(place: Column, demand: Column, tilt: Column) -> Column:
    """The time t in [0, 1] with demand (t + tilt (t^2 - t)) = place."""
    c = place / demand
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - tilt) * (1 - tilt) + 4 * tilt * c))
    # The stable form of the quadratic's root; for tilt 0 it is c.
    return F.least(F.lit(1.0), 2 * c / (1 - tilt + root))


def plan(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target source: demand, supply, passes; total_tokens is the size of the mix (default: of the supply)."""
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs"))
    rows = _tilts(targets).join(have, "source", "left").na.fill(0, ["supply", "n_docs"])
    total = F.lit(total_tokens) if total_tokens else F.sum("supply").over(Window.partitionBy(F.lit(0)))  # over the few targets
    return rows.withColumn("demand", F.col("target_share") * total).withColumn("used", F.least("demand", F.col("supply") * F.col("max_repeats")))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, pass, n_tokens, position), sorted by position over range partitions."""
    counts = materialise(token_counts(documents, tokenizer), "p8-counts")
    sources = materialise(plan(counts, targets, total_tokens).where("used > 0"), "p8-plan")
    rows = counts.where("n_tokens > 0").withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    rows = rows.join(sums, ["source", "bucket"]).withColumn("place", F.col("base") + F.col("inner"))
    rows = rows.join(sources.select("source", "demand", "used", "supply", "tilt", "max_repeats"), "source")
    passes = F.least(F.col("max_repeats"), F.ceil(F.col("used") / F.col("supply")).cast("int"))
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(1), passes))).withColumn("place", F.col("place") + (F.col("pass") - 1) * F.col("supply"))
    rows = rows.where("place < used")
    made = rows.select("doc_id", "source", "pass", "n_tokens", position(F.col("place"), F.col("demand"), F.col("tilt")).alias("position"))
    return made.orderBy("position", "source", "pass", "doc_id")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_documents, n_passes) of every target source."""
    sums = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("n_documents"), F.max("pass").alias("n_passes"))
    rows = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"))
    rows = rows.join(sums, "source", "left").na.fill(0, ["n_tokens", "n_documents", "n_passes"])
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))  # over the few targets
    return rows.select("source", "target_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0).alias("actual_share"), "n_tokens", "n_documents", "n_passes")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return shares(mixed(spark, sf_dir), targets)

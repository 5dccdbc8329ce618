"""The schemas of the tables, and checks of what Spark does not enforce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, MapType, StringType, StructType, TimestampType

_FIELDS = "title string, company string, location string, url string, source string, salary string, job_type string, tags array<string>, is_remote boolean, original_source string, source_job_id string"

_KINDS = {
    "string": StringType(), "long": LongType(), "int": IntegerType(), "boolean": BooleanType(), "timestamp": TimestampType(),
    "array<string>": ArrayType(StringType()), "map<string,string>": MapType(StringType(), StringType()),
}


def _table(fields: str) -> StructType:
    """"name kind, ..." as a schema, without a session."""
    made = StructType()
    for field in fields.split(", "):
        name, kind = field.split(" ", 1)
        made = made.add(name, _KINDS[kind])
    return made


POSTING = _table(f"{_FIELDS}, arrival_seq long")
JOBS = _table(f"id long, {_FIELDS}, canonical_url string, content_hash string, send_status string, first_seen_at timestamp, last_seen_at timestamp")
JOB_SENDS = _table("job_id long, topic_key string, status string, sent_at timestamp, error string, updated_at timestamp")
SOURCE_RUNS = _table("source string, last_run_at timestamp, status string, error string, updated_at timestamp")
METADATA = _table("key string, value string")
TOPIC_RULE = _table("ord int, topic_key string, name string, match string, keywords array<string>")
PAGE = _table("source string, search_idx int, page_idx int, url string, params map<string,string>, html string")
SCHEMA_VERSION = "1"


def problems(table: DataFrame, not_null: list[str], unique: list[str]) -> DataFrame:
    """(problem, n): nulls in columns that must have values, and repeated keys; no rows when all is well."""
    nulls = table.select(F.explode(F.array(*(F.when(F.col(c).isNull(), F.lit(f"null in {c}")) for c in not_null))).alias("problem")).where("problem IS NOT NULL")
    repeats = table.groupBy(*unique).count().where("count > 1").select(F.lit(f"repeated {', '.join(unique)}").alias("problem"))
    return nulls.unionByName(repeats).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def store_form(rows: DataFrame) -> DataFrame:
    """Rows of the store: missing text as the empty text, missing flags false, tags that are no list of texts empty."""
    columns = []
    for name, kind in rows.dtypes:
        if kind == "string" and name != "error":
            columns.append(F.coalesce(name, F.lit("")).alias(name))
        elif kind == "boolean":
            columns.append(F.coalesce(name, F.lit(False)).alias(name))
        elif kind == "array<string>":
            columns.append(F.coalesce(name, F.array().cast("array<string>")).alias(name))
        else:
            columns.append(F.col(name))
    return rows.select(*columns)

"""Problem 5: one form for texts that look the same.

Method: DuckDB inside Arrow partitions.  Each executor's Arrow batches are registered with an embedded DuckDB, whose SQL
takes invisible characters away (regular expression), maps look-alike letters, compatibility forms and odd spaces
(translate, and lists by code point for the many rare ones), composes accents (nfc_normalize) and makes white space
runs one space.  The tables come from Unicode's decompositions by rule (`common`): kept are kinds that look the same, as
wide, narrow, mathematical and Arabic presentation forms, ligatures and units; circled, raised and lowered signs are not.

Defined results: null is the empty text; case, accents, marks and the length of a dash stay.  Rows that look the same are
found by a 128-bit digest of the three forms, and differ when the digests of the stored texts (ordinary white space made
even) differ; a group in which all rows have the same characters is dropped before any rows are paired.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import COMPATIBLE, INVISIBLE, LOOKALIKE, SPACES, WIDE, materialise, table

FIELDS = ["title", "company", "location"]


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(chars: str) -> str:
    """A character class of a regular expression."""
    points, ranges = sorted(map(ord, chars)), []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


# Tables that a text asks for by what it holds, the most usual ones first, so that one kind costs one small translation.
LETTERS = {a: b for a, b in LOOKALIKE.items() if len(unicodedata.normalize("NFD", a)) == 1}
ASCII_WIDE = {a: b for a, b in WIDE.items() if "!" <= b <= "~"}
RARE = {a: b for a, b in (LOOKALIKE | COMPATIBLE).items() if a not in LETTERS and a not in ASCII_WIDE}
# Ranges of code points in which the rare forms lie closely enough for lists that are looked up by code point.
SPANS = [(0x80, 0x58F), (0x1C80, 0x1FFF), (0x2000, 0x33FF), (0xFB00, 0xFFEF), (0x1D400, 0x1D7FF), (0x1EE00, 0x1F2FF)]


def _translated(sql: str, pairs: dict[str, str]) -> str:
    return f"translate({sql}, {_text(''.join(pairs))}, {_text(''.join(pairs.values()))})"


def _looked_up(sql: str, pairs: dict[str, str]) -> str:
    """Character by character, from lists over spans of code points; what lies in none of them, from a map."""
    left, cases = dict(pairs), []
    for low, high in SPANS:
        texts = [left.pop(chr(p), chr(p)) for p in range(low, high + 1)]
        cases.append(f"WHEN ord(c) BETWEEN {low} AND {high} THEN list_extract([{', '.join(map(_text, texts))}], ord(c) - {low - 1})")
    if left:
        cases.append("WHEN ord(c) > 127 THEN coalesce(MAP {" + ", ".join(f"{_text(a)}: {_text(b)}" for a, b in left.items()) + "}[c], c)")
    return f"array_to_string(list_transform(string_split({sql}, ''), lambda c: CASE {' '.join(cases)} ELSE c END), '')"


def form_sql(column: str) -> str:
    """DuckDB SQL of the form of a column."""
    text = f"regexp_replace({column}, {_text(_class(INVISIBLE))}, '', 'g')"
    for pairs, change in ((dict.fromkeys(SPACES, " "), _translated), (ASCII_WIDE, _translated), (LETTERS, _translated), (RARE, _looked_up)):
        text = f"CASE WHEN regexp_matches({column}, {_text(_class(''.join(pairs)))}) THEN {change(text, pairs)} ELSE {text} END"
    text = f"CASE WHEN {column} IS NULL THEN '' WHEN strlen({column}) = length({column}) THEN {column} ELSE nfc_normalize({text}) END"
    return rf"trim(regexp_replace({text}, '[ \t\r\n\f\v]+', ' ', 'g'), ' ')"


def plain_sql(column: str) -> str:
    """DuckDB SQL of the stored characters with ordinary white space made even."""
    return rf"trim(regexp_replace(coalesce({column}, ''), '[ \t\r\n\f\v]+', ' ', 'g'), ' ')"


def _digest(parts: list[str]) -> list[str]:
    joined = " || chr(31) || ".join(parts)
    return [f"(md5_number_{half}({joined})::HUGEINT - 9223372036854775808)::BIGINT" for half in ("lower", "upper")]


def duckdb_batches(query: str, schema: pa.Schema):
    """A mapInArrow function: `query` over each batch as table t, in an embedded DuckDB of one thread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB"}) as db:
            for batch in batches:
                if batch.num_rows:
                    db.register("t", pa.Table.from_batches([batch]))
                    made = db.sql(query).to_arrow_table()
                    db.unregister("t")
                    yield from made.cast(schema).to_batches()

    return run


def forms(jobs: DataFrame) -> DataFrame:
    """(id, title, company, location): the one consistent form."""
    schema = pa.schema([("id", pa.int64()), *((f, pa.string()) for f in FIELDS)])
    query = f"SELECT id, {', '.join(f'{form_sql(f)} AS {f}' for f in FIELDS)} FROM t"
    return jobs.select("id", *FIELDS).mapInArrow(duckdb_batches(query, schema), "id long, title string, company string, location string")


def digests(jobs: DataFrame) -> DataFrame:
    """(id, f0, f1, v0, v1): digests of the forms and of the stored characters."""
    names = ["id", "f0", "f1", "v0", "v1"]
    query = (
        "SELECT id, "
        + ", ".join(f"{e} AS {n}" for e, n in zip(_digest([f"f_{f}" for f in FIELDS]) + _digest([f"v_{f}" for f in FIELDS]), names[1:]))
        + " FROM (SELECT id, "
        + ", ".join(f"{form_sql(f)} AS f_{f}, {plain_sql(f)} AS v_{f}" for f in FIELDS)
        + " FROM t)"
    )
    schema = pa.schema([(n, pa.int64()) for n in names])
    return jobs.select("id", *FIELDS).mapInArrow(duckdb_batches(query, schema), ", ".join(f"{n} long" for n in names))


def same_looking(jobs: DataFrame) -> DataFrame:
    """(id_a, id_b): rows that look the same and differ in their characters."""
    rows = materialise(digests(jobs), "p5-digests")
    mixed = rows.groupBy("f0", "f1").agg(F.min("v0").alias("a0"), F.max("v0").alias("b0"), F.min("v1").alias("a1"), F.max("v1").alias("b1"))
    mixed = mixed.where("a0 <> b0 OR a1 <> b1").select("f0", "f1")
    rows = materialise(rows.join(mixed, ["f0", "f1"], "left_semi"), "p5-mixed")
    other = rows.select(*(F.col(c).alias(f"{c}_b") for c in rows.columns))
    on = (F.col("f0") == F.col("f0_b")) & (F.col("f1") == F.col("f1_b")) & (F.col("id") < F.col("id_b"))
    return rows.join(other, on & ((F.col("v0") != F.col("v0_b")) | (F.col("v1") != F.col("v1_b")))).select(F.col("id").alias("id_a"), "id_b")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking(table(spark, sf_dir, "jobs"))


def all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(table(spark, sf_dir, "jobs"))

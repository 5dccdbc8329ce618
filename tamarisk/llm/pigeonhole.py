"""The partition-based pigeonhole join of short strings, in SQL.

A name is cut into k + 1 segments, so k edits leave at least one whole.  An inverted index holds the segments by (length
of the name, number, text); a string looks up the substrings at the few shifted positions at which it can hold each
segment, and built-in levenshtein, which works in a band of the threshold's width, verifies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import sql

MAX_EDITS = 2  # k: a swap of two neighbours counts two for levenshtein
MIN_FUZZY = 5  # shorter names must be exact

# Segment s (from 1) of a name of length m starts after the first floor((s - 1) m / (k + 1)) characters.  At most s - 1
# edits lie before it and k + 1 - s behind it, which bounds the shift from either end.
PROBES = """
    SELECT owner, gram, m, s, substring(gram, pos, len) AS piece
    FROM (SELECT *, explode(sequence(low, high)) AS pos
          FROM (SELECT *, greatest(1, start - (s - 1), start + (length(gram) - m) - ({k} + 1 - s)) AS low,
                       least(length(gram) - len + 1, start + (s - 1), start + (length(gram) - m) + ({k} + 1 - s)) AS high
                FROM (SELECT *, CAST(1 + floor((s - 1) * m / ({k} + 1)) AS INT) AS start,
                             CAST(floor(s * m / ({k} + 1)) - floor((s - 1) * m / ({k} + 1)) AS INT) AS len
                      FROM (SELECT owner, gram, m, explode(sequence(1, {k} + 1)) AS s
                            FROM (SELECT owner, gram, explode(sequence(greatest({least}, length(gram) - {k}), length(gram) + {k})) AS m
                                  FROM {grams} WHERE length(gram) >= {least} - {k}))))
          WHERE low <= high)
"""

SEGMENTS = """
    SELECT name, m, s, substring(name, CAST(1 + floor((s - 1) * m / ({k} + 1)) AS INT),
                                 CAST(floor(s * m / ({k} + 1)) - floor((s - 1) * m / ({k} + 1)) AS INT)) AS piece
    FROM (SELECT name, length(name) AS m, explode(sequence(1, {k} + 1)) AS s
          FROM (SELECT DISTINCT name FROM {names} WHERE length(name) >= {least}))
"""

# SQL: one edit, or two that are a swap of two neighbours.
NEAR = """({a} IS NOT NULL AND (levenshtein({a}, {b}, 2) BETWEEN 0 AND 1
    OR (length({a}) = length({b}) AND levenshtein({a}, {b}, 2) = 2 AND exists(sequence(1, length({a}) - 1),
        i -> {a} = concat(left({b}, i - 1), substring({b}, i + 1, 1), substring({b}, i, 1), substring({b}, i + 2))))))"""


def near_sql(a: str, b: str) -> str:
    return NEAR.replace("{a}", a).replace("{b}", b)


VERIFIED = """
    SELECT owner, gram, name
    FROM (SELECT DISTINCT p.owner, p.gram, g.name
          FROM {probes} p JOIN {segments} g ON p.m = g.m AND p.s = g.s AND p.piece = g.piece)
    WHERE {near}
"""


def pigeonhole(spark: SparkSession, grams: DataFrame, names: DataFrame, k: int = MAX_EDITS, least: int = MIN_FUZZY) -> DataFrame:
    """grams(owner, gram), names(name) -> (owner, gram, name): grams within one edit or one swap of a name."""
    fill = lambda text: text.replace("{k}", str(k)).replace("{least}", str(least))
    return sql(spark, VERIFIED.replace("{near}", near_sql("gram", "name")), probes=sql(spark, fill(PROBES), grams=grams), segments=sql(spark, fill(SEGMENTS), names=names))

"""Problem 4: records that differ only in formatting, collapsed into one with the number of copies.

Method: the texts of an Arrow batch pass as one stream of code points through a lookup table that skips what does not
count and folds the rest, into polynomial hashes of each field (four primes, 124 bits), added up so that the order of the
two fields does not matter.  No canonical string is made: but for the few characters with marks behind them, each code
point is looked up on its own.  Rows of one hash are compared with the first of them by two
pointers that skip and fold in step; rows that fail go round again with other bases, so a collision can't join rows.

Defined results: a row with nothing that counts in either field (null, empty, marks only) is left out; the group's row is
its smallest id.  A group that holds a third of all rows costs a map-side aggregate and one joined row each.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import COMPATIBLE, INVISIBLE, LOOKALIKE, materialise, plain, table

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
COUNTED_MARKS = "+#"
SEVERAL = 0xFFFFFFFF
JOINED, BETWEEN = 1, 2
UNUSUAL = {*COMPATIBLE, *LOOKALIKE, *INVISIBLE}


def _fold(text: str) -> str:
    """The characters that count of a piece of text: those of its form in `lookalikes`, letter case and all else off."""
    return "".join(c for c in unicodedata.normalize("NFC", plain(text)).lower() if c in COUNTED_MARKS or unicodedata.category(c)[0] in "LN")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the folded code point, 0 if it is skipped, SEVERAL if it counts as several; and whether it changes
    the character before it (combining marks, the later parts of syllables) or lies between invisibly."""
    kinds = [unicodedata.category(chr(p)) for p in range(sys.maxunicode + 1)]
    last = max(p for p, kind in enumerate(kinds) if kind[0] in "LN" or unicodedata.combining(chr(p)))
    one, joins = np.zeros(last + 2, np.uint32), np.zeros(last + 2, np.int8)
    for point in (p for p in range(last + 1) if kinds[p] not in ("Cn", "Co", "Cs")):
        char = chr(point)
        parts = unicodedata.normalize("NFD", char)
        if kinds[point] == "Lo" and len(parts) == 1 and ord(parts) == point and char not in UNUSUAL:
            one[point] = point
            continue
        made = _fold(char)
        one[point] = ord(made) if len(made) == 1 else SEVERAL if made else 0
        if unicodedata.combining(char):
            joins[point] = JOINED
        for later in parts[1:]:
            joins[ord(later)] = JOINED
    for char, form in COMPATIBLE.items():
        if joins[ord(form[0])] == JOINED:
            joins[ord(char)] = JOINED
    for char in INVISIBLE:
        joins[ord(char)] = BETWEEN
    return one, joins


def _clusters(points: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Where a character and what joins it stand, or one that counts as several: such pieces are folded as a whole."""
    one, joins = _tables()
    kinds = joins[np.minimum(points, len(joins) - 1)]
    special = np.flatnonzero((kinds == JOINED) | (one[np.minimum(points, len(one) - 1)] == SEVERAL))
    first, made = set(starts.tolist()) if len(special) else set(), []
    for at in special.tolist():
        if made and at < made[-1][1]:
            continue
        low, high = at, at + 1
        while kinds[low] and low not in first:
            low -= 1
        while high < len(points) and kinds[high] and high not in first:
            high += 1
        made.append((low, high))
    return made


def _stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points (0: skipped) of all texts, one after the other, and where each text starts (and the end)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    starts = before[offsets - offsets[0]]
    one, _ = _tables()
    folded = one[np.minimum(points, len(one) - 1)]
    if len(pieces := _clusters(points, starts)):
        times, texts = np.ones(len(points), np.int64), []
        for low, high in pieces:
            text = _fold("".join(map(chr, points[low:high].tolist())))
            times[low:high] = 0
            times[low] = len(text)
            texts.append(text)
        place = np.concatenate([[0], np.cumsum(times)])
        folded = np.repeat(folded, times)
        for (low, _), text in zip(pieces, texts):
            folded[place[low] : place[low] + len(text)] = [ord(c) for c in text]
        starts = place[starts]
    return folded, starts


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(prime: int, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo prime, by doubling."""
    have = _powers.get((prime, base), np.ones(1, np.int64))
    while len(have) < n:
        have = np.concatenate([have, have * pow(base, len(have), prime) % prime])
    _powers[(prime, base)] = have
    return have


def field_hashes(column: pa.Array, round_: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 62-bit hashes of each text, and how many characters count."""
    folded, starts = _stream(column)
    kept = folded != 0
    count = np.concatenate([[0], np.cumsum(kept)])
    lengths = count[starts[1:]] - count[starts[:-1]]
    codes = folded[kept].astype(np.int64)
    firsts = count[starts[:-1]]
    within = np.arange(len(codes)) - np.repeat(firsts, lengths)
    halves = []
    for i, prime in enumerate(PRIMES):
        base = int(_mixed(np.array([i + 17]), round_)[0] % np.uint64(prime - 1000)) + 500
        terms = codes * _power(prime, base, int(lengths.max(initial=0)) + 1)[within] % prime
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms.astype(np.uint64), dtype=np.uint64)])
        halves.append((total[firsts + lengths] - total[firsts]) % np.uint64(prime))
    shift = np.uint64(31)
    return halves[0] << shift | halves[1], halves[2] << shift | halves[3], lengths


def _hash_batches(round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a0, a1, na = field_hashes(batch.column("x"), round_)
            b0, b1, nb = field_hashes(batch.column("y"), round_)
            k0 = (_mixed(a0, 1) + _mixed(b0, 1)).view(np.int64)
            k1 = (_mixed(a1 ^ a0, 2) + _mixed(b1 ^ b0, 2)).view(np.int64)
            counted = pa.array((na > 0) & (nb > 0))
            made = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(k0), pa.array(k1)], names=["id", "k0", "k1"])
            yield made.filter(counted)

    return run


def _steps(text: str) -> Iterator[int]:
    """The folded code points of a text, one by one; a character is folded with what joins it, as in `_stream`."""
    one, joins = _tables()
    last, n, at = len(one) - 1, len(text), 0
    kind = lambda i: joins[min(ord(text[i]), last)]
    while at < n:
        code, low = int(one[min(ord(text[at]), last)]), at
        at += 1
        joined = code == SEVERAL or kind(low) == JOINED
        while at < n and kind(at):
            joined = joined or kind(at) == JOINED
            at += 1
        if joined:
            yield from map(ord, _fold(text[low:at]))
        elif code:
            yield code


def same(a: str, b: str) -> bool:
    """Two pointers over the stored texts, each skipping what does not count."""
    if a == b:
        return True
    left, right = _steps(a), _steps(b)
    for x in left:
        if x != next(right, 0):
            return False
    return next(right, 0) == 0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y, u, v = (batch.column(c).to_pylist() for c in ("x", "y", "u", "v"))
        ok = [same(a, c) and same(b, d) or same(a, d) and same(b, c) for a, b, c, d in zip(x, y, u, v)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("head"), pa.array(ok, pa.bool_())], names=["id", "head", "ok"])


def copies(rows: DataFrame) -> DataFrame:
    """rows(id, x, y) -> (id, head): every row that counts as the same as one with a smaller id, with the group's smallest id."""
    found, left, round_ = None, rows, 0
    while True:
        keys = materialise(left.mapInArrow(_hash_batches(round_), "id long, k0 long, k1 long"), "p4-keys")
        groups = keys.groupBy("k0", "k1").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        pairs = materialise(keys.join(groups, ["k0", "k1"]).where("id <> head").select("id", "head"), "p4-pairs")
        heads = left.select(F.col("id").alias("head"), F.col("x").alias("u"), F.col("y").alias("v"))
        texts = pairs.join(left, "id").join(heads, "head").select("id", "head", "x", "y", "u", "v")
        checked = materialise(texts.mapInArrow(_verify, "id long, head long, ok boolean"), "p4-checked")
        good = checked.where("ok").select("id", "head")
        found = good if found is None else found.unionByName(good)
        failed = checked.where("NOT ok").select("id")
        if failed.isEmpty():
            return found
        left, round_ = materialise(left.join(failed, "id", "left_semi"), "p4-left"), round_ + 1


def _rows(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", F.coalesce("title", F.lit("")).alias("x"), F.coalesce("company", F.lit("")).alias("y"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(_rows(table(spark, sf_dir, "jobs"))).select(F.col("head").alias("id_a"), F.col("id").alias("id_b"))


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per group, with the number of its copies (1 where there is no other); rows without countable text too."""
    jobs = table(spark, sf_dir, "jobs").select("id", "title", "company")
    pairs = materialise(copies(_rows(jobs)), "p4-copies")
    counts = pairs.groupBy(F.col("head").alias("id")).agg((F.count(F.lit(1)) + 1).alias("n"))
    kept = jobs.join(pairs.select("id"), "id", "left_anti")
    return kept.join(counts, "id", "left").select("id", "title", "company", F.coalesce("n", F.lit(1)).alias("n_copies"))

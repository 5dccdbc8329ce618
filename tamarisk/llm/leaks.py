"""Problem 7: evaluation texts in the corpus.

Method: Wu-Manber multi-pattern search.  The patterns are all windows of M words of the items (with at most one changed or
added word in ten, 30 words in a row always hold 7 of them untouched); the alphabet is words, a block is two of them.  The
shift table tells for the block at a window's end how far the window can move on; where it cannot, the block's suffix
bucket holds the patterns that end so, and a direct comparison of the window's words confirms.  The windows of all
documents of an Arrow batch move in step, as one array.  Confirmed places are then tested exactly: the words in common are
chained, and a passage counts when it holds LEAST words of the item in a row with at most one change in ten.

The items are a stated query set: they are sent to every task in blocks of bounded size.

Defined results: null and empty texts and items of fewer than M words give nothing; case, punctuation, line breaks and
markup don't count; each (doc_id, item_id) comes once; texts of any length are read whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sql, table

M = 7  # words of a pattern
B = 2  # words of a block
LEAST = 30  # words of a passage
CHANGES = 10  # one changed or added word in so many
BLOCK_CHARS = 4_000_000  # characters of items that one pass sends to every task
LANE = 2_000  # words that one window walks; longer texts are walked in several lanes

_MARKUP = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text: markup off, compatibility forms and case folded, everything but letters and digits a border."""
    if not text:
        return []
    text = html.unescape(_MARKUP.sub(" ", text)) if "<" in text or "&" in text else text
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


class Search:
    """Tables of one block of items: plain arrays, so that they go to the tasks as they are."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in items if len(w := words(t)) >= M]
        self.ids: dict[str, int] = {}
        coded = [[self.ids.setdefault(x, len(self.ids) + 1) for x in w] for _, w in self.items]
        self.size = 1 << max(12, (sum(map(len, coded)) * 4).bit_length())
        self.shift = np.full(self.size, M - B + 1, np.int64)
        ends, patterns, owner, offset = [], [], [], []
        for n, code in enumerate(coded):
            code = np.array(code, np.int64)
            blocks = self._hash(code[:-1], code[1:])
            for start in range(len(code) - M + 1):
                window = blocks[start : start + M - B + 1]
                np.minimum.at(self.shift, window, np.arange(M - B, -1, -1))
                patterns.append(code[start : start + M])
                owner.append(n)
                offset.append(start)
                ends.append(window[-1])
        order = np.argsort(np.array(ends, np.int64), kind="stable")
        self.ends = np.array(ends, np.int64)[order]
        self.patterns = np.array(patterns, np.int64).reshape(-1, M)[order]
        self.owner, self.offset = np.array(owner, np.int64)[order], np.array(offset, np.int64)[order]

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7_919 + (a ^ b)) % self.size

    def scan(self, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (start in text, pattern number) in lanes: windows that end at first .. last."""
        at, last = first + M - 1, last.copy()
        places, numbers = [], []
        while True:
            live = at <= last
            if not live.all():
                at, last = at[live], last[live]
            if not len(at):
                break
            end = self._hash(text[at - 1], text[at])
            step = self.shift[end]
            stop = np.flatnonzero(step == 0)
            if len(stop):
                # The bucket of the block: patterns that end with it, in one range of the sorted table.
                low = np.searchsorted(self.ends, end[stop], "left")
                many = np.searchsorted(self.ends, end[stop], "right") - low
                start = np.repeat(at[stop] - M + 1, many)
                number = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                # The first words are compared before the rest.
                good = self.patterns[number, 0] == text[start]
                start, number = start[good], number[good]
                good = (self.patterns[number] == text[start[:, None] + np.arange(M)]).all(axis=1)
                places.append(start[good])
                numbers.append(number[good])
            at = at + np.maximum(step, 1)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(numbers)


def holds(item: list[str], text: list[str], first: int, last: int, least: int = LEAST, changes: int = CHANGES) -> bool:
    """Does text, near the places first .. last where its first word of the item would stand, hold a passage?"""
    slack = len(item) // changes + 2
    low, high = max(0, first - slack), min(len(text), last + len(item) + slack)
    near = text[low:high]
    runs = [m for m in SequenceMatcher(None, item, near, autojunk=False).get_matching_blocks() if m.size]
    for i, start in enumerate(runs):
        changed = 0
        for j in range(i, len(runs)):
            if j > i:
                gap_item, gap_text = runs[j].a - runs[j - 1].a - runs[j - 1].size, runs[j].b - runs[j - 1].b - runs[j - 1].size
                changed += max(gap_item, gap_text)
            length = runs[j].a + runs[j].size - start.a
            if length >= least and changed * changes <= length:
                return True
    return False


def _likely(item: np.ndarray, text: np.ndarray, at: int, least: int, changes: int) -> bool:
    """A necessary condition, quickly: enough words of some 30 in a row stand near the place's diagonal."""
    slack = len(item) // changes + 1
    hit = np.zeros(len(item), bool)
    for d in range(at - slack, at + slack + 1):
        low, high = max(0, -d), min(len(item), len(text) - d)
        if high > low:
            hit[low:high] |= item[low:high] == text[low + d : high + d]
    total = np.concatenate([[0], np.cumsum(hit)])
    return len(item) >= least and (total[least:] - total[:-least]).max() >= least - least // changes - 1


def _searcher(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded_items = [np.array([search.ids[x] for x in w], np.int64) for _, w in search.items]
        for batch in batches:
            texts = [words(t) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            get = search.ids.get
            flat = np.fromiter((get(x, 0) for t in texts for x in t), np.int64, int(sizes.sum()))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            lanes = [(s + k, min(s + k + LANE + M - 2, e - 1)) for s, e in zip(starts[:-1], starts[1:]) for k in range(0, max(0, e - s - M + 1), LANE)]
            first, last = (np.array(x, np.int64) for x in zip(*lanes)) if lanes else (np.zeros(0, np.int64),) * 2
            at, number = search.scan(flat, first, last)
            doc = np.searchsorted(starts, at, "right") - 1
            # By document and item: the places where the item's first word would stand.
            near: dict[tuple[int, int], set[int]] = {}
            for d, n, p, o in zip(doc.tolist(), search.owner[number].tolist(), at.tolist(), search.offset[number].tolist()):
                near.setdefault((d, n), set()).add(p - int(starts[d]) - o)
            out_doc, out_item = [], []
            ids = batch.column("doc_id").to_pylist()
            for (d, n), diagonals in near.items():
                code, text = coded_items[n], flat[starts[d] : starts[d + 1]]
                good = sorted(x for x in diagonals if _likely(code, text, x, LEAST, CHANGES))
                # Places far apart are passages of their own.
                groups: list[list[int]] = []
                for x in good:
                    if groups and x - groups[-1][-1] <= len(code):
                        groups[-1].append(x)
                    else:
                        groups.append([x])
                if any(holds(search.items[n][1], texts[d], g[0], g[-1]) for g in groups):
                    out_doc.append(ids[d])
                    out_item.append(search.items[n][0])
            yield pa.RecordBatch.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out_item, pa.int64())], names=["doc_id", "item_id"])

    return run


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_CHARS characters (one item at least)."""
    block, size = [], 0
    for r in items.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id").toLocalIterator():
        if block and size + len(r.text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents with the items of which they hold a passage."""
    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    made = [texts.mapInArrow(_searcher(Search(block)), "doc_id long, item_id long") for block in item_blocks(items)]
    if not made:
        return texts.select("doc_id", F.lit(0).cast("long").alias("item_id")).limit(0)
    return reduce(DataFrame.unionByName, made)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).distinct()


def by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the number of documents that it leaked into."""
    counts = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))
    return sql(
        spark,
        "SELECT i.item_id, i.task, coalesce(c.n, 0) AS n_documents FROM {items} i LEFT JOIN {counts} c ON i.item_id = c.item_id",
        items=table(spark, sf_dir, "eval_items"),
        counts=counts,
    )

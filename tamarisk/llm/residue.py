"""Problem 9: template residue, filler, error messages and script notices in place of content.

Method: positive-unlabelled naive Bayes by expectation-maximisation.  Texts are cut into passages (lines and sentences).
Trusted positives only train: passages with a template field in doubled delimiters or stock filler (residue), and records
of which half the passages or more are stock errors or script notices (messages).  All else is unlabelled and starts as
content; each expectation moves to the positive classes what their words explain better.  In the end every passage, the
trusted ones too, is scored by the model alone, and the scores decide the record.

The model of a record: it either consists of a message, and then its passages come from the
words of messages, but for a share of CLOSING lines beside menu lines, which are removed; or each of its passages is residue or content.  So one passage of residue is enough for a case,
while a message that content mentions has all the other passages against it.

Two guards against drift of what the unlabelled texts teach: they count in the positive classes with weight UNLABELLED
only, and one in HELD_OUT trusted records is never taught.  A round's worth is r^2 / f: r of these found, f records found
in all; the rounds end before one of less than DRIFT times the best worth, or when nothing changes.

Words are hashed to a fixed number of buckets, so the model's size doesn't depend on the corpus; counts are over all
passages.  Each round adds its counts up by bucket, in the tasks first; only the bucket sums come to the driver.

Defined results: null and empty texts and texts of menu lines alone are no cases; each row of a case comes once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

CONTENT, RESIDUE, MESSAGE = range(3)
BUCKETS = 1 << 16
ROUNDS = 8  # at most
SMOOTH = 0.1  # share of the words of all texts in those of a class: at any size, a word that the class lacks speaks against it
UNLABELLED = 0.02  # weight of texts that aren't trusted in the positive classes
HELD_OUT = 8  # one in so many trusted records is never taught
DRIFT = 0.9  # a round worth less than this share of the best is dropped
CLOSING = 0.1  # of the passages in a message are closing lines
MENTION = 0.001  # of the passages in content only mention a message
TRUST = 1 / 2  # of a record's passages are notices in a trusted message
FOUND = 0.5

# Words of template fields, and the delimiters of slots, doubled or unmistakable ones first.
FIELD = r"(?:name|title|company|employer|date|city|mail|email|url|link|position|address|salary|manager|recruiter|team|department|number|insert|your|location|benefit|phone|job|role|contact|amount)"
STRICT = [r"\{\{([^{}]*)\}\}", r"<%=?([^%]*)%>", r"\{%([^%{}]*)%\}", r"\$\{([^{}]*)\}", r"\[\[([^\[\]]*)\]\]", r"@@([^@]*)@@", r"__([^_\s](?:[^_]|_[^_])*)__", r"#\{([^{}]*)\}", r"<<([^<>]*)>>", r"«([^«»]*)»", r"%\(([^()]*)\)[sd]"]
LOOSE = [r"\{([^{}]+)\}", r"\[([^\[\]]+)\]", r"%([^%\d\s][^%]*)%", r"<([^<>/]+)>", r"#([^#\d\s][^#]*)#"]

# Words of the stock filler, and phrases of filler in plain words.
LOREM = set(
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam nostrud "
    "exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum".split()
)
FILLER = r"(?i)\b(?:dummy (?:copy|text)|placeholder text|sample (?:text|description)|filler text|text goes here|content goes here|replace (?:this )?before publish\w*|replace this text|to be (?:filled|written) (?:in|later)|insert text here|(?:headline|subline|body copy|button label) here|placeholder paragraph|test posting|test test test|asdf\w*|qwerty|blindtext|faux texte|texte de remplissage)\b|^\W*(?:TODO|FIXME|TBD)\b\W|\bX{4,}\b|نص تجريبي"

# Stock errors and script notices.
ERRORS = r"(?i)\b(?:page (?:was )?not found|could not be found|no longer (?:here|available|exists)|access (?:is )?denied|permission (?:to|denied)|session (?:has )?expired|something went wrong|an error occurred|service (?:is )?(?:not available|(?:temporarily )?unavailable)|bad gateway|gateway time-?out|internal (?:server )?(?:error|problem)|server error|(?:connection|database|query)\W+(?:\w+\W+){0,2}(?:failed|refused|reset)|too many requests|cannot be reached|did not respond|request timed out|down for maintenance|under maintenance|failed to load|could not load|try again later|unexpected (?:error|fault|condition)|(?:does|do) not exist|(?:been|was|were) (?:moved or )?(?:deleted|removed)|without an account|undefined (?:variable|index)|uncaught exception|traceback \(most recent call last\)|(?:key|type|value|index|attribute)error:|null ?pointer ?exception|seite nicht gefunden|zugriff verweigert|sitzung (?:ist )?abgelaufen|page introuvable|accès refusé|session (?:a )?expiré)|\b(?:http|error|status|code|fehler|erreur)\W{0,3}(?:[45]\d\d)\b|^\W*(?:[45]\d\d)\b\W+\w+|الصفحة غير موجودة|رمز الخطأ|تم رفض الوصول|انتهت الجلسة"
SCRIPTS = r"(?i)\b(?:(?:enable|activate|allow|turn on|switch on|need(?:s)? to allow|permit)\W+(?:\w+\W+){0,3}(?:java ?script|scripts?|scripting|js|cookies)|(?:java ?script|scripts?|scripting|js)(?:\W+\w+){0,2}\W+(?:is|are|must|have to|has to|support)\W+(?:\w+\W+){0,4}(?:required|enabled|disabled|allowed|permitted|active|turned|on|off|run|be)|run java ?script|without script support|active scripting|needs? scripts|(?:switch|turn) (?:them|it) on|(?:has|have) (?:them|it) (?:turned|switched) off|not run scripts|checking your browser|aktivieren sie java ?script|activer java ?script)\b|تفعيل جافا ?سكريبت|تفعيل javascript"

# Lines of menus and closing lines.
MENU = r"(?i)^\W*(?:(?:home|start|menu|search|jobs|vacancies|employers|sign in|log ?in|register|help|contact|about(?: us)?|imprint|privacy|terms|language|faq|news|all rights reserved|posting|back|results|copyright|en|ar|de|fr|\(c\)|©|\d+)(?:\W+|$))+$|^\W*(?:go )?back to (?:the )?(?:start(?: page)?|results|search|home(?: ?page)?|overview)\W*$|^\W*(?:\(c\)|©|copyright)\W*\d{4}.*$|^\W*language\W.*$|^.{0,60}\|.{0,40}\|.*$"

# For Arrow's regular expressions, in which \w and \b know ASCII letters only.
TAG = r"(?i)</?(?:html|body|head|div|p|span|br|ul|ol|li|h[1-6]|main|nav|footer|header|section|article|table|tr|td|a|b|i|em|strong)(?:\s[^<>]*)?/?>"
SENTENCE_END, WORD_GAP, LETTER = r"([.!?؟])\s+", r"[^\pL\pN]+", r"[\pL\pN]"
SLOT_SIGN = r"[{}\[\]%<>#@«»]|__"
_STRICT, _LOOSE = re.compile("|".join(STRICT)), re.compile("|".join(LOOSE))
_FIELD = re.compile(rf"(?i)(?<![a-z]){FIELD}(?![a-z])")
_CODE, _WORD = re.compile(r"[(){};=+*/\\]"), re.compile(r"[^\W_]+")


def _arrow(pattern: str) -> str:
    """A pattern in the terms of Arrow's regular expressions."""
    return pattern.replace(r"\W", r"[^\pL\pN_]").replace(r"\w", r"[\pL\pN_]")


def _inner(slot: re.Match) -> str:
    return next((g for g in slot.groups() if g), "")


def _one_line(text: str) -> str:
    return _STRICT.sub(lambda m: re.sub(r"\s+", " ", m[0]), text)


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The passages of all texts but menu and closing lines, and the number of each one's text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = np.flatnonzero(pc.match_substring_regex(texts, r"(?:\{\{|<%|\{%|\$\{|\[\[|@@|__|#\{|<<|«|%\()[^\n]*\n").to_numpy(zero_copy_only=False))
    if len(odd):  # a slot over several lines is one passage
        plain = texts.to_pylist()
        for i in odd.tolist():
            plain[i] = _one_line(plain[i])
        texts = pa.array(plain, pa.large_string())
    texts = pc.replace_substring_regex(pc.utf8_normalize(texts, "NFKC"), TAG, "\n")
    lists = pc.split_pattern(pc.replace_substring_regex(texts, SENTENCE_END, "\\1\n"), "\n")
    owner, parts = pc.list_parent_indices(lists), pc.utf8_trim(pc.list_flatten(lists), " \t\r-*•")
    kept = pc.and_(pc.and_not(pc.greater(pc.utf8_length(parts), 1), pc.match_substring_regex(parts, _arrow(MENU))), pc.match_substring_regex(parts, LETTER))
    return owner.filter(kept).to_numpy().astype(np.int64), parts.filter(kept)


def _bucket(word: str) -> int:
    """Numbers as their number of digits, but for error codes; words with digits as such."""
    if word.isdigit():
        word = "code" if len(word) == 3 and word[0] in "45" else f"{len(word)} digits"
    elif any(c.isdigit() for c in word):
        word = "mixed"
    return zlib.crc32(word.encode()) % BUCKETS


def tokens(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words of all passages, the number of each one's passage, and how many words of stock filler each passage has."""
    lists = pc.split_pattern_regex(pc.utf8_lower(parts), WORD_GAP)
    owner, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    some = pc.not_equal(words, "")
    owner, words = owner.filter(some).to_numpy().astype(np.int64), words.filter(some).dictionary_encode()
    known = words.dictionary.to_pylist()
    at = words.indices.to_numpy()
    buckets = np.array([_bucket(w) for w in known], np.int32)[at] if len(at) else np.zeros(0, np.int32)
    stock = np.bincount(owner, np.array([w in LOREM for w in known], bool)[at] if len(at) else None, len(parts))
    # What stands in slots counts once more as such.
    slots, where = [], np.flatnonzero(pc.match_substring_regex(parts, SLOT_SIGN).to_numpy(zero_copy_only=False))
    for i, passage in zip(where.tolist(), parts.take(pa.array(where)).to_pylist()):
        for m in (*_STRICT.finditer(passage), *_LOOSE.finditer(passage)):
            slots += [(i, zlib.crc32(b"in:" + w.encode()) % BUCKETS) for w in _WORD.findall(_inner(m).lower())]
    if slots:
        more, inside = np.array(slots).T
        owner, buckets = np.concatenate([owner, more]), np.concatenate([buckets, inside.astype(np.int32)])
        order = np.argsort(owner, kind="stable")
        owner, buckets = owner[order], buckets[order]
    return buckets, owner, stock


def trusted(record: np.ndarray, parts: pa.Array, n_words: np.ndarray, stock: np.ndarray) -> np.ndarray:
    """The class of each passage that trains; content stands for unlabelled."""
    kinds = np.zeros(len(parts), np.int32)
    notice = pc.or_(pc.match_substring_regex(parts, _arrow(ERRORS)), pc.match_substring_regex(parts, _arrow(SCRIPTS))).to_numpy(zero_copy_only=False)
    many = np.bincount(record)
    kinds[(np.bincount(record, notice) >= TRUST * many)[record]] = MESSAGE
    filler = pc.match_substring_regex(parts, _arrow(FILLER)).to_numpy(zero_copy_only=False)
    kinds[filler | ((n_words > 3) & (stock >= np.maximum(2, 0.25 * n_words)))] = RESIDUE
    where = np.flatnonzero(pc.match_substring_regex(parts, SLOT_SIGN).to_numpy(zero_copy_only=False))
    for i, passage in zip(where.tolist(), parts.take(pa.array(where)).to_pylist()):
        inner = [_inner(m) for m in _STRICT.finditer(passage)]
        if any(_FIELD.search(re.sub("[_.]", " ", x)) and not _CODE.search(x) for x in inner):
            kinds[i] = RESIDUE
    return kinds


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record: its passages' hashed words, one after the other, with their numbers of words and trusted classes."""

    def lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32()), pa.array(values, pa.int32()))

    for batch in batches:
        if not batch.num_rows:
            continue
        record, parts = cut(batch.column("text"))
        words, passage, stock = tokens(parts)
        sizes = np.bincount(passage, minlength=len(parts))
        kinds = trusted(record, parts, sizes, stock) if len(parts) else np.zeros(0, np.int32)
        n = batch.num_rows
        made = [batch.column("doc_id"), lists(sizes, record, n), lists(kinds, record, n), lists(words, record[passage], n)]
        yield pa.RecordBatch.from_arrays(made, names=["doc_id", "sizes", "kinds", "words"])


class Records:
    """A batch of prepared records under a model: posteriors by the words alone."""

    def __init__(self, batch: pa.RecordBatch, model: np.ndarray | None, prior: np.ndarray):
        self.n = batch.num_rows
        self.sizes, self.kinds, self.words = (np.asarray(batch.column(c).flatten()) for c in ("sizes", "kinds", "words"))
        self.passage = np.repeat(np.arange(len(self.sizes)), self.sizes)
        many = np.asarray(pc.list_value_length(batch.column("sizes"))).astype(np.int64)
        self.record = np.repeat(np.arange(self.n), many)
        ids = np.asarray(batch.column("doc_id").cast(pa.int64())).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.held = (ids >> np.uint64(40)) % np.uint64(HELD_OUT) == 0  # trusted records that are never taught
        if model is None or not len(self.sizes):
            self.message, self.residue, self.notice = np.zeros(self.n), np.zeros(len(self.sizes)), np.zeros(len(self.sizes))
            return
        content, residue, message = (np.bincount(self.passage, model[self.words, c], len(self.sizes)) for c in range(3))
        share = np.log(prior) - np.log1p(-prior)  # of residue among passages, of messages among records
        odds = residue - content + share[0]
        beside = np.logaddexp(content + np.log1p(-prior[0]), residue + np.log(prior[0]))
        notice, closing = message + np.log1p(-CLOSING), beside + np.log(CLOSING)
        other = np.logaddexp(beside + np.log1p(-MENTION), message + np.log(MENTION))
        total = np.bincount(self.record, np.logaddexp(notice, closing) - other, self.n) + share[1]
        logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        self.message = np.where(many > 0, logistic(total), 0)
        self.residue, self.notice = logistic(odds), logistic(notice - closing)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each record: whether it is a message, whether it has residue."""
        message = self.message >= FOUND
        return message, (np.bincount(self.record, self.residue >= FOUND, self.n) > 0) & ~message


def _counter(model: np.ndarray | None, prior: np.ndarray):
    """Sums of the next model: words by class; then passages by class, records by class; held-out records, those found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS + 3, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            r = Records(batch, model, prior)
            taught = (r.kinds > 0) & ~r.held[r.record]
            message = np.where(taught, r.kinds == MESSAGE, r.message[r.record] * r.notice)
            residue = np.where(taught, r.kinds == RESIDUE, (1 - message) * r.residue)
            weight = np.where(taught, 1.0, UNLABELLED)
            post = np.stack([1 - message - residue, residue * weight, message * weight], axis=1)
            for c in range(3):
                total[:BUCKETS, c] += np.bincount(r.words, post[r.passage, c], BUCKETS)
            total[BUCKETS] += (1 - message - residue).sum(), residue.sum(), message.sum()
            whole = np.where(r.held, r.message, np.maximum(r.message, np.bincount(r.record, r.kinds == MESSAGE, r.n) > 0))
            total[BUCKETS + 1] += (np.bincount(r.record, minlength=r.n) > 0).sum() - whole.sum(), 0, whole.sum()
            spies = np.zeros(r.n, bool)
            spies[r.record[r.kinds > 0]] = True
            spies &= r.held
            total[BUCKETS + 2] += spies.sum(), (spies & np.logical_or(*r.found())).sum(), np.logical_or(*r.found()).sum()
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, c]) for c in range(3))], names=["bucket", "c0", "c1", "c2"])

    return run


def fit(rows: DataFrame, rounds: int = ROUNDS, log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word log-probabilities by class, and the shares of residue among passages and of messages among records."""
    model, prior, best, most, before = None, np.full(2, 0.5), None, 0.0, -1
    for _ in range(rounds + 1):
        counts = np.zeros((BUCKETS + 3, 3))
        for r in rows.mapInArrow(_counter(model, prior), "bucket long, c0 double, c1 double, c2 double").groupBy("bucket").agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in range(3))).collect():
            counts[r.bucket] = r.c0, r.c1, r.c2  # BUCKETS rows and three at most
        held = counts[BUCKETS + 2]
        if log is not None:
            log.append((held.tolist(), prior.tolist()))
        if model is not None:
            score = (held[1] + 1) ** 2 / max(held[2], 1)
            if score < DRIFT * most:
                break
            best, most = (model, prior), max(most, score)
            if held[2] == before:
                break
            before = held[2]
        prior = np.array([(counts[BUCKETS][1] + 1) / (counts[BUCKETS][:2].sum() + 2), (counts[BUCKETS + 1][2] + 1) / (counts[BUCKETS + 1].sum() + 2)])
        words = counts[:BUCKETS]
        whole = (words.sum(axis=1) + 1) / (words.sum() + BUCKETS)
        model = np.log((1 - SMOOTH) * words / np.maximum(words.sum(axis=0), 1e-9) + SMOOTH * whole[:, None])
    return best or (model, prior)


def _decider(model: np.ndarray, prior: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                message, residue = Records(batch, model, prior).found()
                out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(message, "message", "residue"))], names=["doc_id", "reason"])
                yield out.filter(pa.array(message | residue))

    return run


def residue(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, reason): records to be excluded, and whether for residue or as a message."""
    texts = documents.select("doc_id", "text").where("text <> ''")
    rows = materialise(texts.mapInArrow(_prepared, "doc_id long, sizes array<int>, kinds array<int>, words array<int>"), "p9-passages")
    return rows.mapInArrow(_decider(*fit(rows, rounds)), "doc_id long, reason string")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents"))

"""Problems 7 to 9: leaks, mixing, residue."""

import random

import pytest
from pyspark.sql import functions as F

from tamarisk.llm import leaks, mixing, residue

WORDS = [a + b + c for a in ("ba", "ke", "mo", "ru") for b in ("lin", "sor", "tep", "vud") for c in ("a", "is", "on", "ek")]


def sentence(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def documents(spark, texts):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("item_id", F.lit(7)).withColumn("n_tokens", F.lit(1))


def test_leaks_against_the_definition(spark):
    rng = random.Random(3)
    items = [sentence(rng, 60 + i) for i in range(8)]
    frame = lambda words: " ".join(sentence(rng, 25) + words + sentence(rng, 25))
    texts, want = [], set()

    def add(text, item=None):
        if item is not None:
            want.add((len(texts), item))
        texts.append(text)

    for i, item in enumerate(items):
        add(frame(item), i)
        add(frame(item[5:35]), i)  # 30 words
        add(frame(item[5:29]))  # 24 words
        changed = item[10:50]
        for k in (7, 15, 23, 31):
            changed[k] = "other"
        add(frame(changed), i)  # 4 of 40
        added = item[10:43]
        for k in (24, 16, 8):
            added.insert(k, "added")
        add(frame(added), i)
        for k in range(4, len(broken := item[:]), 5):
            broken[k] = "other"
        add(frame(broken))  # every fifth word
        add("<p>" + "</p>\n<b>".join(w.upper() + "!" for w in item) + "</b>", i)
    add(" ".join(sentence(rng, 5000) + items[0] + sentence(rng, 5000) + items[1]), 0)
    want.add((len(texts) - 1, 1))
    texts += [None, "", "short", "<<<", " ".join(items[2][:6])]
    item_table = spark.createDataFrame([(i, " ".join(w), "t") for i, w in enumerate(items)] + [(90, None, "t"), (91, "", "t"), (92, "too short", "t")], "item_id long, text string, task string")
    df = documents(spark, texts)
    assert {tuple(r) for r in leaks.leaks(df, item_table).collect()} == want
    assert leaks.leaks(df.limit(0), item_table).count() == 0 and leaks.leaks(df, item_table.limit(0)).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    items = [" ".join(sentence(rng, 50)) for _ in range(5)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 400)
    assert len(list(leaks.item_blocks(table))) > 2
    assert {tuple(r) for r in leaks.leaks(documents(spark, items), table).collect()} == {(i, i) for i in range(5)}


def test_wu_manber_finds_every_window():
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("ab cd ef".split()) for _ in range(12))) for i in range(3)]
    search = leaks.Search(items)
    import numpy as np

    text = np.array([search.ids[rng.choice("ab cd ef".split())] for _ in range(3000)], np.int64)
    at, number = search.scan(text, np.array([0, 1500 - leaks.M + 1]), np.array([1499, 2999]))
    want = {(p, n) for n, pattern in enumerate(search.patterns) for p in range(len(text) - leaks.M + 1) if (text[p : p + leaks.M] == pattern).all()}
    assert set(zip(at.tolist(), number.tolist())) == want and want


@pytest.fixture()
def bytes_tokenizer(tmp_path):
    import base64

    path = tmp_path / "bytes.tiktoken"
    path.write_text("\n".join(f"{base64.b64encode(bytes([b])).decode()} {b}" for b in range(256)))
    return str(path)


def test_mix(spark, bytes_tokenizer):
    texts = ["x" * 10] * 600 + ["y" * 50] * 3 + [None, ""]
    rows = [(i, t, "big" if i < 600 else "small") for i, t in enumerate(texts)] + [(900, "z" * 5, "other"), (901, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bucket", F.lit(1)).withColumn("place", F.lit(2))
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 4), ("none", 0.2, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, 2000, bytes_tokenizer).collect()
    used = {s: [r for r in mixed if r.source == s] for s in ("big", "small")}
    assert sum(r.n_tokens for r in used["big"]) == 1000 and len({r.doc_id for r in used["big"]}) == 100
    assert sum(r.n_tokens for r in used["small"]) == 600 and max(r["pass"] for r in used["small"]) == 4
    assert [r.position for r in mixed] == sorted(r.position for r in mixed) and all(0 <= r.position <= 1 for r in mixed)
    report = {r.source: r for r in mixing.shares(mixing.mix(df, targets, 2000, bytes_tokenizer), targets).collect()}
    assert report["none"].actual_share == 0 and abs(report["big"].actual_share - 1000 / 1600) < 1e-9 and report["small"].n_documents == 3
    assert mixing.mix(df.limit(0), targets, 2000, bytes_tokenizer).count() == 0 and mixing.mix(df, targets.limit(0), 2000, bytes_tokenizer).count() == 0


def test_position_inverts_the_schedule(spark):
    df = spark.createDataFrame([(t, k) for t in (0.0, 0.1, 0.5, 0.9, 1.0) for k in (-0.9, -0.2, 0.0, 0.4, 0.9)], "t double, k double")
    place = F.lit(700.0) * (F.col("t") + F.col("k") * (F.col("t") * F.col("t") - F.col("t")))
    assert all(abs(r.t - r.p) < 1e-9 for r in df.select("t", mixing.position(place, F.lit(700.0), F.col("k")).alias("p")).collect())


CONTENT = ["The group has {n} members and looks after the field engineers.", "You plan cache layers together with the support desk for {n} months.", "Good written notes matter to us, since the legal group read them every day.", "Interviews take place in two rounds and take about {n} hours.", "We look for people who test build pipelines with care."]
SLOTS = ["Welcome to {{company_name}}!", "Dear <%= your name %>, thank you for the interest in the post at {{job_title}}.", "Questions go to ${contact.email}.", "Please send your papers to __hiring_manager__."]
MESSAGES = ["Error 404. The page was not found.", "Access denied. You do not have permission to view this address.", "Please enable JavaScript to view this page.", "Something went wrong. Try again later."]


def residue_texts(rng):
    """Texts with the reason of each case: content of four to twelve lines, slots, filler, messages, mentions."""
    line = lambda: rng.choice(CONTENT).format(n=rng.randint(2, 60))
    texts, want = [], {}
    for i in range(400):
        texts.append("\n".join(line() for _ in range(rng.randint(1, 12))))
    for i in range(60):
        want[len(texts)] = "residue"
        texts.append("\n".join([line(), rng.choice(SLOTS), line(), line()]))
        want[len(texts)] = "message"
        texts.append(f"Home | Jobs | Sign in\n{rng.choice(MESSAGES)}\nBack to the start page.")
    for loose in ("Welcome to [company name]!", "Questions go to %contact email%.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit."):
        want[len(texts)] = "residue"
        texts.append("\n".join([line(), line(), loose]))
    mentions = ["You write the texts of our 404 pages and fix error 500 reports.", "Our widgets work even when visitors have JavaScript disabled.", "Practice with templates such as {{ }} is welcome.", "Array access like rows[i] should feel familiar."]
    for i in range(120):
        texts.append("\n".join([line(), mentions[i % 4], *(line() for _ in range(rng.randint(3, 7)))]))
    return texts, want


def test_residue(spark):
    texts, want = residue_texts(random.Random(6))
    texts += [None, "", "Home | Jobs", "y " * 30_000]
    rows = [(r.doc_id, r.reason) for r in residue.residue(documents(spark, texts)).collect()]
    made = dict(rows)
    assert len(rows) == len(made)
    both = sum(made.get(k) == v for k, v in want.items())
    assert both >= 0.95 * len(want) and both >= 0.95 * len(made)
    assert residue.residue(documents(spark, texts).limit(0)).count() == 0


def test_residue_beyond_former_limits(spark):
    """Long messages, long slots, slots over lines and after many others."""
    texts, want = residue_texts(random.Random(7))
    error = " ".join(f"{m} Error {c}." for m in MESSAGES for c in (404, 500, 502, 503))
    odd = {error: "message", "Welcome to {{company name " + "and the town " * 20 + "}}!": "residue", "Welcome to {{company\nname}}!": "residue", "You plan [1] [2] [3] [4] [5] and read {{company_name}}!": "residue"}
    for text, reason in odd.items():
        want[len(texts)] = reason
        texts.append(text)
    made = {r.doc_id: r.reason for r in residue.residue(documents(spark, texts)).collect()}
    assert [made.get(k) for k in list(want)[-len(odd) :]] == list(odd.values())


def test_every_passage_is_scored_by_the_model(spark):
    """A trusted form that content holds in great numbers is content to the model."""
    texts, want = residue_texts(random.Random(8))
    quoted = "Session expired is what the third talk of the spring meeting was about, with coffee"
    n = len(texts)
    texts += [f"{quoted}.\n" + "\n".join(random.Random(i).choice(CONTENT).format(n=i) for _ in range(5)) for i in range(200)] + [quoted]
    made = {r.doc_id for r in residue.residue(documents(spark, texts)).collect()}
    assert not made & set(range(n, len(texts)))


def test_drift_ends_the_rounds(spark, monkeypatch):
    texts, _ = residue_texts(random.Random(9))
    rows = documents(spark, texts).select("doc_id", "text").mapInArrow(residue._prepared, "doc_id long, sizes array<int>, kinds array<int>, words array<int>").cache()
    monkeypatch.setattr(residue, "DRIFT", 2.0)  # every round counts as drift but the first
    log = []
    residue.fit(rows, log=log)
    assert len(log) == 3

"""Problems 2 to 5: accepted postings, canonical values, formatting copies, look-alikes."""

import datetime as dt
import itertools
import unicodedata
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarisk.llm import batches, formatting, graph, lookalikes, places
from tamarisk.llm.common import COMPATIBLE, INVISIBLE, LOOKALIKE, SPACES

DAY = dt.datetime(2025, 1, 1)
JOB = "id long, title string, company string, location string, canonical_url string, content_hash string, first_seen_at timestamp, job_type string, source string"


def jobs(spark, *rows, extra=""):
    base = dict(id=0, title="Dev", company="Acme", location="X", canonical_url=None, content_hash=None, first_seen_at=DAY, job_type=None, source="a")
    full = [{**base, "id": i + 1, **r} for i, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(r[f.split()[0]] for f in JOB.split(", ")) for r in full], JOB)
    return df.withColumn("n", F.lit(1)).withColumn("key", F.lit("k")).withColumn("h", F.lit(0)) if extra else df


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def components(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {(x, find(x)) for x in list(up)}


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7)], [(9, i) for i in range(1, 9)] + [(9, 50), (50, 40)], [(1, 3), (3, 2), (5, 4), (2, 5), (7, 8), (8, 7), (7, 8)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    assert pairs(graph.components(df)) == components([x for x in links if x[0] != x[1]])


H = "ab" * 32


def test_accepted_rows(spark):
    rows = [
        dict(content_hash=H, first_seen_at=DAY + dt.timedelta(5)), dict(content_hash="sha256:" + H.upper() + " ", first_seen_at=DAY), dict(content_hash="", canonical_url=""), dict(content_hash=None, canonical_url=" "),
        dict(canonical_url="https://www.w.example/jobs/view/dev-12?trk=1"), dict(canonical_url="http://EG.w.example/jobs/view/12/#x\n"), dict(canonical_url="https://w.example/jobs/view/13"),
        dict(canonical_url="https://n.example/jobs/p/ab1%2Ddev", content_hash="c1", first_seen_at=DAY + dt.timedelta(9)), dict(canonical_url="https://m.n.example/jobs/p/ab1", content_hash="c2", first_seen_at=DAY + dt.timedelta(3)), dict(content_hash="c2", first_seen_at=None),
        dict(canonical_url="https://g.example/vacancy?x=1&vid=5", first_seen_at=DAY), dict(canonical_url="https://g.example/vacancy?vid=5&pageNum=2", first_seen_at=DAY),
    ]
    want = {(1, 2), (5, 6), (8, 9), (9, 10), (11, 12)}
    df = batches.prepare(jobs(spark, *rows, extra="x"))
    for windows in (1, 3):
        assert pairs(batches.replay(df, windows)) == want
    assert pairs(batches.replay(df.limit(0))) == set()


def test_batch_after_batch_equals_all_at_once(spark):
    # Chains that join postings of the history later on.
    rows = [dict(content_hash=h, canonical_url=f"https://w.example/jobs/view/{u}", first_seen_at=DAY + dt.timedelta(d)) for d, h, u in [(0, "a", 1), (1, "b", 2), (2, "c", 3), (3, "a", 2), (4, "d", 4), (5, "b", 3), (6, "a", 9), (6, "e", 9), (9, "z", 4)]]
    df = batches.prepare(jobs(spark, *rows))
    want = {(1, x) for x in (2, 3, 4, 6, 7, 8)} | {(5, 9)}
    assert pairs(batches.replay(df, 1)) == want == pairs(batches.replay(df, 10))


def test_pivot_join_is_the_true_neighbourhood(spark):
    points = [(i, *p) for i, p in enumerate([(0, 0, 0, 0), (3, 0, 0, 0), (0, 2, 2, 0), (100, 5, 5, 5), (103, 5, 5, 5), (2**32 - 1, 0, 0, 1)])]
    df = spark.createDataFrame(points, "id long, x0 long, x1 long, x2 long, x3 long")
    for j, pivot in enumerate(batches.PIVOTS):
        p = [int(pivot[8 * i : 8 * i + 8], 16) for i in range(4)]
        df = df.withColumn(f"d{j}", sum((F.abs(F.col(f"x{i}") - p[i]) for i in range(4)), F.lit(0)))
    for radius in (0, 1, 3, 4):
        want = {(a[0], b[0]) for a in points for b in points if sum(abs(x - y) for x, y in zip(a[1:], b[1:])) <= radius}
        assert {(r.id, r.h_id) for r in batches.pivot_join(df, df, radius).select("id", "h_id").distinct().collect()} == want


def test_every_day_is_a_batch(spark, monkeypatch):
    """The query's batches are the days, all of them, and give what one call for each day against the kept history gives."""
    rows = [(d, f"h{i % 9}", f"https://w.example/jobs/view/{100 + i % 6}") for i, d in enumerate([2, 1, 1, 2, 4, 4, None, 0, 2, 4, 1, 0, 2, 4])]
    df = batches.prepare(jobs(spark, *(dict(content_hash=h, canonical_url=u, first_seen_at=None if d is None else DAY + dt.timedelta(d)) for d, h, u in rows)))
    met = []
    monkeypatch.setattr(batches, "accept", lambda rows, *more, own=batches.accept: met.append(rows) or own(rows, *more))
    made = pairs(batches.replay(df))
    monkeypatch.undo()
    assert sum(x.select("w").distinct().count() for x in met) == 4
    history, links = None, []
    for w, day in enumerate([0, 1, 2, 4]):
        batch = df.where(F.coalesce(F.datediff("seen", F.lit(DAY)), F.lit(4)) == day)
        repeats, append = batches.accept(batch.withColumn("w", F.lit(w)), history)
        links += [(r.id, r.accepted) for r in repeats.collect()]
        history = append if history is None else history.unionByName(append)
    keys = {k for _, h, u in rows for k in (h, u)}
    assert history.count() == len(keys)  # each key once
    order = {i: (d is None, d or 0, i) for i, (d, _, _) in enumerate(rows, 1)}
    parts = defaultdict(set)
    for x, c in components(links):
        parts[c].add(x)
    heads = {x: min(xs, key=order.get) for xs in parts.values() for x in xs}
    assert made == {tuple(sorted((x, h))) for x, h in heads.items() if x != h} and len(made) > 8


def test_near_keys_are_met_and_are_no_repeats(spark):
    urls = [f"https://w.example/jobs/view/31{n}" for n in (491411, 491412, 491414, 491419, 491411)] + ["https://w.example/jobs/view/AB1", "https://w.example/jobs/p/ab1", "https://w.example/jobs/p/AB1"]
    df = batches.prepare(jobs(spark, *(dict(canonical_url=u, first_seen_at=DAY + dt.timedelta(i)) for i, u in enumerate(urls))))
    points = batches.pivot_rows(batches.points(df.select("id", "seen", F.col("page").alias("key"))))
    near = {(r.id, r.h_id): r.distance for r in batches.pivot_join(points, points).collect() if r.id < r.h_id <= 5}
    assert batches.RADIUS == 4 and near == {(1, 2): 1, (1, 3): 3, (2, 3): 2, (1, 5): 0, (2, 5): 1, (3, 5): 3}
    assert pairs(batches.replay(df)) == {(1, 5)}


def test_points_tell_keys_apart(spark):
    keys = ["", "0", "1", "01", "a", "A", "a1", "a 1", "a01", "100000000", "1", "a-", "x" * 20, "X" * 20, "é9", "w 31491418", "w 031491418"]
    rows = batches.points(spark.createDataFrame([(k, k) for k in keys], "id string, key string")).collect()
    assert len({(r.x0, r.x1, r.x2, r.x3) for r in rows}) == len(set(keys)) == len({r.id for r in rows})


PLACES = [(1, "Kuhoji", "Egypt", "EG", "KHB", None), (2, "Kuhoji", "Saudi Arabia", "SA", "KHJ", None), (3, "Dunujon", "Jordan", "JO", "DNJ", "دونوجون"), (4, "New Dunujon", "Jordan", "JO", "NDN", None), (5, "Firakel", "Kenya", "KE", "FRK", None)]
VALUES = {
    "Kuhoji, Egypt": 1, "KUHOJI/SA": 2, "Kuhoji": 0, "khb": 1, "KHJ SA": 2, "New Dunujon": 4, "new dunjon": 4, "Dunujon (Hybrid)": 3, "دونوجون، Jordan": 3, "Greater Firakel Area, Kenya": 5, "Frakel": 5, "Fiarkel - KE": 5,
    "Fira​kel": 5, "Ｆirаkel": 5, "Firakel, Egypt": 0, "Egypt": 0, "Remote": 0, "-": 0, "x" * 5000: 0, "Some Heights, Dunujon, Jordan": 3,
}


def test_places(spark):
    ref = spark.createDataFrame(PLACES, "location_id int, city string, country string, country_code string, city_code string, local_name string")
    df = jobs(spark, *({"location": v} for v in [*VALUES, None, "", " \t", "​", "Kuhoji, Egypt"]), extra="x")
    made = [tuple(r) for r in places.match_locations(spark, df, ref).collect()]
    assert len(made) == len(VALUES) and {r[1]: r[2] for r in made} == VALUES and {r[0] for r in made} == {"location"}
    assert places.match_locations(spark, df.limit(0), ref).count() == 0
    assert {r[2] for r in places.match_locations(spark, df, ref.limit(0)).collect()} == {0}


def test_misspelt_places_beside_exact_ones(spark):
    ref = spark.createDataFrame([*PLACES, (6, "Dunujona", "Jordan", "JO", "DNA", None)], "location_id int, city string, country string, country_code string, city_code string, local_name string")
    want = {"Nwe Dunujon": 4, "Frakel (KHB)": 5, "Kuhoji, Frakel, Kenya": 5, "Dunujon": 3, "Dunujona": 6, "Dunujon, Jordan": 3}
    df = jobs(spark, *({"location": v} for v in want))
    assert {r.raw_value: r.ref_id for r in places.match_locations(spark, df, ref).collect()} == want


def test_job_types(spark):
    ref = spark.createDataFrame([(1, "Full Time", ""), (2, "Contract", ""), (3, "Internship", ""), (4, "Shift Based", "")], "job_type_id int, label string, meaning string")
    want = {"FULL-TIME": 1, "F/T": 1, "Ful Time": 1, "fulltime job": 1, "12-month contract": 2, "Contractor": 2, "Cont.": 2, "Cotnract, hybrid": 2, "Intern": 3, "intenrship": 3, "rotating shifts": 4, "Other": 0, "2 vacancies": 0, "n/a": 0}
    df = jobs(spark, *({"job_type": v} for v in [*want, None, " "]))
    assert {r.raw_value: r.ref_id for r in places.match_job_types(spark, df, ref).collect()} == want


def test_pigeonhole_finds_all_within_the_edits(spark):
    from tamarisk.llm.pigeonhole import pigeonhole

    names = ["abcdef", "abcdefgh", "abxdef", "hgfedcba", "aaaaaaaa", "bcdef"]
    grams = ["abcdef", "abcdeg", "bacdef", "abdcefgh", "abcdfgh", "aaaaaaa", "aaaabaaaa", "abcde", "zzzzz", "xabcdef"]

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) <= 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
        s, l = sorted((a, b), key=len)
        return any(l[:i] + l[i + 1 :] == s for i in range(len(l)))

    want = {(g, n) for g in grams for n in names if near(g, n) and len(n) >= 5}
    df = spark.createDataFrame([(g, g) for g in grams], "owner string, gram string")
    assert {(r.gram, r.name) for r in pigeonhole(spark, df, spark.createDataFrame([(n,) for n in names], "name string")).collect()} == want


def canon(s):
    for a, b in (LOOKALIKE | COMPATIBLE | dict.fromkeys(SPACES, " ") | dict.fromkeys(INVISIBLE, "")).items():
        s = s.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFC", s).lower() if c in "+#" or unicodedata.category(c)[0] in "LN")


ODD = ["C++ Dev", "c++dev", "C# Dev", "DEV, C++", "Café", "Café", "CAFÉ", "Cafe", "oﬃce", "Office", "Ｄｅｖ", "d​ev!", "Dеv", "مطور أول", "مطور.أول", "", "--", "x" * 70_000, "X" * 70_000 + "!", "🙂 dev", "é́x", "\U00030000 x", "\U00030001 x", "x", "e\u200b\u0301x", "éx", "e\u0334\u0301x", "e\u0334x", "o\u0302\u0301", "\u1ed1", "\uff76\uff9e", "\u30ac", "\ud55c", "\u1112\u1161\u11ab", "㎏ 5", "kg 5"]


def test_formatting_copies(spark):
    rows = [dict(title=a, company=b) for a, b in itertools.product(ODD, ["Acme", "ACME.", "Café", "", None])] + [dict(title="Acme", company="C++ Dev"), dict(title=None, company=None)]
    groups = defaultdict(list)
    for i, r in enumerate(rows, 1):
        x, y = canon(r["title"] or ""), canon(r["company"] or "")
        if x and y:
            groups[tuple(sorted((x, y)))].append(i)
    want = {(i, min(m)) for m in groups.values() for i in m if i != min(m)}
    df = jobs(spark, *rows, extra="x")
    assert pairs(formatting.copies(formatting._rows(df))) == want and len(want) > 30
    assert formatting.copies(formatting._rows(df.limit(0))).count() == 0


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    import pyarrow as pa

    # All rows of the first round in one hash: the comparison and the next rounds must still part them.
    def blunt(round_):
        def run(it):
            for b in it:
                zero = pa.array([0] * b.num_rows, pa.int64())
                kept = zero if round_ == 0 else pa.array([len([*formatting._steps(x)]) for x in b.column("x").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("id"), kept, zero], names=["id", "k0", "k1"])

        return run

    monkeypatch.setattr(formatting, "_hash_batches", blunt)
    df = jobs(spark, dict(title="a"), dict(title="bb"), dict(title="A"), dict(title="BB!"), dict(title="ccc"))
    assert pairs(formatting.copies(formatting._rows(df))) == {(3, 1), (4, 2)}


ALPHABET = "aAéÉe\u0301\u0334\u200bｅеﬁfi +#-!.١\u0302\U00030000㎏\u1112\u1161한"


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=ALPHABET, max_size=12), st.text(alphabet=ALPHABET, max_size=12))
def test_two_pointers_hashes_and_the_definition_agree(a, b):
    import pyarrow as pa

    h0, h1, n = formatting.field_hashes(pa.array([a, b]))
    equal = canon(a) == canon(b)
    assert formatting.same(a, b) == ((h0[0], h1[0]) == (h0[1], h1[1])) == equal and list(n) == [len(list(formatting._steps(x))) for x in (a, b)]


@pytest.mark.parametrize(("a", "b", "equal"), [("\U00030000 x", "\U00030001 x", False), ("\U00030000 x", "x", False), ("e\u200b\u0301", "é", True), ("e\u0334\u0301", "é", True), ("e\u0334\u0301", "e\u0334", False), ("ı", "i", False), ("ι", "i", False)])
def test_former_mistakes(a, b, equal):
    import pyarrow as pa

    h0, _, _ = formatting.field_hashes(pa.array([a, b]))
    assert formatting.same(a, b) == equal == (h0[0] == h0[1])


def test_forms_by_rule(spark):
    import duckdb

    texts = ["①", "m²", "𝐀𝐛", "㎏", "ｶﾞ", "ﻻ", "Ⅳ", "ıι", "… №", "ѐ", "Dеv\u200b", "ﬃ e\u200b\u0301", "\u00a0x\u3000", "plain  text", "\u0675", ""]
    want = ["①", "m²", "Ab", "kg", "ガ", "لا", "IV", "ıι", "... No", "è", "Dev", "ffi é", "x", "plain text", "\u0627\u0674", ""]
    with duckdb.connect() as db:
        assert [db.execute(f"SELECT {lookalikes.form_sql('x')} FROM (SELECT ? AS x)", [t]).fetchone()[0] for t in texts] == want


def test_lookalikes(spark):
    rows = [
        dict(title="Dev Ops"), dict(title="Dev Ops"), dict(title="Dev  Ops "), dict(title="Dеv Ops"), dict(title="dev Ops"), dict(title="Dév Ops"), dict(title="Dév Ops"), dict(title="Ｄev Ops"), dict(title="Dev​ Ops"),
        dict(title="Dev Ops", company=None, location=""), dict(title="Dev Ops", company="", location=None), dict(title="Dev Ops", company="​", location=None), dict(title="A – B"), dict(title="A - B"), dict(title="oﬃce " + "y" * 50_000), dict(title="office " + "y" * 50_000),
    ]
    plain = {1: "s", 3: "s"}
    same = [1, 2, 3, 4, 8, 9]
    want = {p for p in itertools.combinations(same, 2) if not (p[0] in plain and p[1] in plain)} | {(6, 7), (10, 12), (11, 12), (15, 16)}
    df = jobs(spark, *rows, extra="x")
    assert pairs(lookalikes.same_looking(df)) == want
    assert lookalikes.same_looking(df.limit(0)).count() == 0
    form = {r.id: r.title for r in lookalikes.forms(df).collect()}
    assert form[2] == form[4] == form[8] == "Dev Ops" and form[7] == "Dév Ops" and form[13] == "A – B"

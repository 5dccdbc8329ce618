"""Problem 1: openings that several sites advertise without a common id.

Method: similarity vectors of candidate pairs, two regularised Gaussians separating matched from unmatched vectors without
labels, transitivity enforced during expectation-maximisation, posteriors as confidences.

Rows are first reduced to classes that read the same: organisation (the spellings linked as in `names`), canonical words
of the title, reference number, place (as in `places`).  Candidates are classes of one organisation that share a reference
number, all words, or all words but one at one place; classes with different references never meet.  So the copies of a
posting are no pairs, and a large employer splits into its references, titles and places.

A similarity vector holds: common words of the titles, their letters, the names' letters, the place, the reference.  The
vectors lie on a grid, so their histogram is of bounded size; the mixture is fitted to it, and only posteriors by vector
go back to the pairs.  For two links with a common class, the product of their posteriors bounds that of the third pair
from below (a third pair that was no candidate is scored, too); where it is exceeded the weaker link gives way.  That is done once after each expectation, and the next
maximisation takes the reduced posteriors; the last ones are reduced until no triangle is broken.

Defined results: rows without an organisation, or with no word in the title, match nothing; title and company exchanged
are put back; equal classes are matched by the posterior of their own vector; a place missing on both sides agrees less
than a named one, missing on one side hardly; the same source (case and padding ignored) never matches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixture, names, places, titles
from .common import key_sql, materialise, release, sql, table

STEP = 0.05  # the grid of similarities
FEATURES = ["s_words", "s_letters", "s_name", "s_place", "s_ref"]
GROUPS = [[0, 1], [2], [3], [4]]  # features that may depend on each other
SLACK = 1e-6  # by which a product of posteriors can exceed the third
SMALL_ROWS = 500_000  # of (hash, flag): 8 MB at most when broadcast
# Words for work that is not tied to a place.
ANYWHERE = r"\b(?:remote(?:ly)?|anywhere|worldwide|work from home|home ?office|wfh|telecommute|عن بعد|من المنزل)\b"


def _if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def arranged(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, src, title, company, location) with exchanged fields put back, and the names (name, n)."""
    spelt = materialise(names.spellings(jobs), "p1-names")
    wrong = spelt.where("title_like").select(F.xxhash64("name").alias("wrong")).distinct()
    rows = jobs.select("id", F.lower(F.trim("source")).alias("src"), "title", "company", "location", F.xxhash64("company").alias("h"))
    rows = rows.where("company IS NOT NULL").join(_if_small(wrong), F.col("h") == F.col("wrong"), "left")
    turned = F.col("wrong").isNotNull()
    rows = rows.select("id", "src", F.when(turned, F.col("company")).otherwise(F.col("title")).alias("title"), F.when(turned, F.col("title")).otherwise(F.col("company")).alias("company"), "location", turned.alias("turned"))
    rows = materialise(rows, "p1-rows")
    more = rows.where("turned AND company IS NOT NULL").groupBy(F.col("company").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return rows, spelt.where("NOT title_like").select("name", "n").unionByName(more).groupBy("name").agg(F.sum("n").alias("n"))


def place_keys(spark: SparkSession, rows: DataFrame, ref: DataFrame) -> DataFrame:
    """(hl, place): the entry of the list; else work from anywhere; else the words that name no country."""
    split = materialise(places._values(spark, rows, "location"), "p1-values")
    fits = places.locations_of(spark, split, ref)
    # Words of the few countries of the reference list.
    names_ = sql(spark, f"SELECT DISTINCT {key_sql('country')} AS country, {key_sql('country_code')} AS code FROM {{ref}}", ref=ref)
    countries = names_.select(F.explode(F.concat(F.split("country", " "), F.array("code"))).alias("w")).agg(F.collect_set("w").alias("c"))
    return sql(
        spark,
        f"""SELECT xxhash64(raw_value) AS hl,
                   CASE WHEN ref_id > 0 THEN concat('#', ref_id)
                        WHEN regexp_like(form, r"{ANYWHERE}") THEN concat('anywhere ', array_join(array_intersect(words, c), ' '))
                        ELSE nullif(array_join(array_sort(IF(size(own) > 0, own, array_distinct(words))), ' '), '') END AS place
            FROM (SELECT s.raw_value, s.form, s.words, f.ref_id, c, array_except(s.words, c) AS own
                  FROM {{split}} s LEFT JOIN {{fits}} f ON s.raw_value = f.raw_value CROSS JOIN {{countries}})""",
        split=split,
        fits=fits,
        countries=countries,
    )


def classes(spark: SparkSession, jobs: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (id, src, cls) and classes (cls, org, core, tk, ref, place)."""
    rows, spelt = arranged(jobs)
    release(spark)
    orgs = materialise(names.link(spelt, "p1").select(F.xxhash64("name").alias("hc"), "org", "core"), "p1-orgs")
    release(spark)
    spots = materialise(place_keys(spark, rows, ref), "p1-places")
    release(spark)
    text = rows.select("id", "src", F.xxhash64("company").alias("hc"), F.when(F.col("location").isNotNull(), F.xxhash64("location")).alias("hl"), titles.reference("title").alias("ref"), titles.words("title").alias("words"))
    text = materialise(text.withColumn("h", F.xxhash64("words")), "p1-text")
    heads = titles.canonical(materialise(text.groupBy("h").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n")), "p1-titles"))
    heads = materialise(heads.where("tk <> ''").select("h", "tk", F.xxhash64("tk").alias("ht")), "p1-heads")
    release(spark)
    full = text.drop("words").join(orgs.select("hc", "org", F.xxhash64("core").alias("hn")), "hc").join(spots, "hl", "left").join(heads.select("h", "ht"), "h")
    full = full.withColumn("cls", F.xxhash64("org", "ht", "ref", "place"))
    full = materialise(full.select("id", "src", "cls", "org", "hn", "ht", "ref", "place"), "p1-full")
    made = full.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("org", "ht", "ref", "place")), F.min("hn").alias("hn"), F.count(F.lit(1)).alias("n"))
    made = made.join(heads.select("ht", "tk").distinct(), "ht").join(orgs.select(F.xxhash64("core").alias("hn"), "core").distinct(), "hn")
    return full.select("id", "src", "cls"), materialise(made.select("cls", "org", "core", "tk", "ref", "place", "n"), "p1-classes")


def _grid(c: Column) -> Column:
    return (F.round(c / STEP) * STEP).cast("float")


def candidates(made: DataFrame) -> DataFrame:
    """(a, b, similarities): pairs of classes, a < b, and each class with itself.

    Classes without reference meet by all words, or all but one at one place.  Classes with one meet by it, and otherwise
    only those without, at the same place or where one names none: so their number doesn't square under one title."""
    words = F.split("tk", " ")
    both, one, other = F.lit(2), F.lit(0), F.lit(1)
    link = lambda side, *parts: F.struct(F.xxhash64(*parts).alias("k"), side.alias("side"))
    near = F.transform(words, lambda w: link(both, F.lit("n"), "place", F.array_join(F.array_remove(words, w), " ")))
    spot = lambda side, place: link(side, F.lit("o"), "tk", place)
    anywhere = lambda side: link(side, F.lit("a"), "tk")
    place = F.coalesce("place", F.lit(""))
    bare = F.concat(F.array(link(both, F.lit("t"), "tk"), spot(one, place), anywhere(one)), near)
    given = F.concat(F.array(link(both, F.lit("r"), "ref"), spot(other, place), spot(other, F.lit(""))), F.when(F.col("place").isNull(), F.array(anywhere(other))).otherwise(F.array().cast("array<struct<k:bigint,side:int>>")))
    keyed = made.select("cls", "org", F.explode(F.array_distinct(F.when(F.col("ref").isNull(), bare).otherwise(given))).alias("x")).select("cls", "org", "x.*")
    left = keyed.where("side <> 1").select("org", "k", F.col("cls").alias("x"), F.col("side").alias("sx"))
    right = keyed.where("side <> 0").select("org", "k", F.col("cls").alias("y"), F.col("side").alias("sy"))
    pairs = left.join(right, ["org", "k"]).where("sx = 2 AND sy = 2 AND x < y OR sx = 0 AND sy = 1").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return similarities(made, pairs.unionByName(made.where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))))


def similarities(made: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarities) of pairs(a, b) of classes."""
    for side in "ab":
        pairs = pairs.join(made.select(F.col("cls").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("core", "tk", "ref", "place"))), side)
    wa, wb = F.split("tk_a", " "), F.split("tk_b", " ")
    likeness = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))

    def agree(name: str, both: float, one: float) -> Column:
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        return F.when(a.isNull() & b.isNull(), both).when(a.isNull() | b.isNull(), one).when(a == b, 1.0).otherwise(0.0)

    return pairs.select(
        "a",
        "b",
        _grid(F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))).alias("s_words"),
        _grid(F.when(F.col("tk_a") == F.col("tk_b"), 1.0).otherwise(likeness(F.col("tk_a"), F.col("tk_b")))).alias("s_letters"),
        _grid(F.when(F.col("core_a") == F.col("core_b"), 1.0).otherwise(F.greatest(likeness(F.col("core_a"), F.col("core_b")), F.lit(0.5)))).alias("s_name"),
        _grid(agree("place", 0.85, 0.4)).alias("s_place"),
        _grid(agree("ref", 0.9, 0.5)).alias("s_ref"),
    )


def _histogram(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The vectors on the grid (a bounded number), and how many pairs have each."""
    rows = pairs.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")).orderBy(*FEATURES).collect()
    return np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r.n for r in rows], float)


def _by_vector(gamma: np.ndarray, v: Column) -> Column:
    """The posterior of vector number v; 0 where that is null, for a pair that was no candidate."""
    return F.coalesce(F.get(F.split(F.lit(" ".join(map(repr, gamma.tolist()))), " ").cast("array<double>"), v), F.lit(0.0))


class Bound:
    """Mean posteriors by vector after `transitive`, for the posteriors of an expectation.

    What a link is lowered to depends on its vector and on those of the other link and the third pair of its wedges.  So
    the wedges are made once and reduced to how many links have which vector and set of such pairs of vectors; each call
    is one pass over that table.  They are made of the vectors that exceeded one half so far, and anew for more of them."""

    def __init__(self, numbered: DataFrame, n: np.ndarray, linked: np.ndarray):
        self.numbered, self.n, self.linked, self.kinds = numbered, n, linked, None

    def _kinds(self) -> DataFrame:
        wedges = _wedges(_links(self.numbered, self.linked), self.numbered, "v")
        ends = F.array(F.struct("m", F.col("x").alias("o"), F.col("vx").alias("v"), F.col("vy").alias("w"), F.col("vxy").alias("t")), F.struct("m", F.col("y").alias("o"), F.col("vy").alias("v"), F.col("vx").alias("w"), F.col("vxy").alias("t")))
        ends = wedges.select(F.explode(ends).alias("e")).select(F.least("e.m", "e.o").alias("a"), F.greatest("e.m", "e.o").alias("b"), "e.v", F.struct("e.w", "e.t").alias("k"))
        sets = ends.groupBy("a", "b", "v").agg(F.array_sort(F.collect_set("k")).alias("ks"))
        return materialise(sets.groupBy("v", "ks").agg(F.count(F.lit(1)).alias("n")), "p1-wedges")

    def __call__(self, gamma: np.ndarray) -> np.ndarray:
        if self.kinds is None or ((gamma > 0.5) & ~self.linked).any():
            self.linked = self.linked | (gamma > 0.5)
            self.kinds = self._kinds()
            self.any = not self.kinds.isEmpty()
        if not self.any:
            return gamma
        p = lambda v: _by_vector(gamma, v)
        # Null, which array_min leaves out, where the wedge is kept or the other link gives way.
        broken = lambda k: (p(k.w) > 0.5) & (p(F.col("v")) <= p(k.w)) & (p(F.col("v")) * p(k.w) > p(k.t) + SLACK)
        most = F.array_min(F.transform("ks", lambda k: F.when(broken(k), p(k.t) / p(k.w))))
        lost = F.when(p(F.col("v")) > 0.5, p(F.col("v")) - F.least(p(F.col("v")), most)).otherwise(0.0)
        held = self.n * gamma
        for r in self.kinds.groupBy("v").agg(F.sum(F.col("n") * lost).alias("lost")).collect():
            held[r.v] -= r.lost
        return np.clip(held / self.n, 0, 1)


def lacking(made: DataFrame, links: DataFrame, numbered: DataFrame) -> DataFrame:
    """(a, b): third pairs of the links' wedges that were no candidates, except where the references conflict."""
    third = _wedges(links, numbered, "v").where("vxy IS NULL").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    for side in "ab":
        third = third.join(made.select(F.col("cls").alias(side), F.col("ref").alias(f"r{side}")), side)
    return materialise(third.where("ra IS NULL OR rb IS NULL OR ra = rb").select("a", "b"), "p1-lacking")


def posteriors(spark: SparkSession, pairs: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """(a, b, p): pairs with the confidence p of a match, and the third pairs of their wedges, if the classes are given."""
    while True:
        x, n = _histogram(pairs)
        if not len(x):
            return pairs.select("a", "b", F.lit(0.0).alias("p"))
        vectors = spark.createDataFrame([(*map(float, v), i) for i, v in enumerate(x)], ", ".join(f"{f} float" for f in FEATURES) + ", v int")
        numbered = materialise(pairs.join(F.broadcast(vectors), FEATURES).select("a", "b", "v"), "p1-numbered")
        # Expectation-maximisation starts from the vectors that agree nearly wholly in every feature.
        start = (x.min(axis=1) >= 0.8).astype(float)
        # A run without the bound gives it posteriors to begin with: the start is none, and its zeros would lower links to
        # nothing.  It also tells which vectors' wedges are likely to be asked for.
        free = mixture.fit(x, n, start, GROUPS)
        linked = free > 0.5
        more = made and lacking(made, _links(numbered, linked), numbered)
        if not more or more.isEmpty():
            bound = Bound(numbered, n, linked)
            gamma = mixture.fit(x, n, free, GROUPS, bound=bound)
            more = made and (bound.linked & ~linked).any() and lacking(made, _links(numbered, bound.linked), numbered)
            if not more or more.isEmpty():
                return consistent(materialise(numbered.select("a", "b", _by_vector(gamma, F.col("v")).alias("p")), "p1-scored"))
        pairs = materialise(pairs.unionByName(similarities(made, more)), "p1-pairs")


def _links(numbered: DataFrame, linked: np.ndarray) -> DataFrame:
    return numbered.where("a <> b").where(F.col("v").isin(np.flatnonzero(linked).tolist()))


def _wedges(links: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """(m, x, y and the values of m-x, m-y, x-y): two links with a common class, x < y; null where x-y is no pair."""
    one = links.select(F.col("a").alias("m"), F.col("b").alias("x"), F.col(value).alias(f"{value}x"))
    both = one.unionByName(links.select(F.col("b").alias("m"), F.col("a").alias("x"), F.col(value).alias(f"{value}x")))
    other = both.select("m", F.col("x").alias("y"), F.col(f"{value}x").alias(f"{value}y"))
    third = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col(value).alias(f"{value}xy"))
    return both.join(other, "m").where("x < y").join(third, ["x", "y"], "left")


def _broken(scored: DataFrame) -> DataFrame:
    wedges = _wedges(scored.where("p > 0.5 AND a <> b"), scored, "p")
    return wedges.withColumn("pxy", F.coalesce("pxy", F.lit(0.0))).where(f"px * py > pxy + {SLACK}")


def _lowered(scored: DataFrame, broken: DataFrame) -> DataFrame:
    lowered = broken.select(F.explode(F.array(
        F.struct(F.least("m", "x").alias("a"), F.greatest("m", "x").alias("b"), F.when(F.col("px") <= F.col("py"), F.col("pxy") / F.col("py")).otherwise(1.0).alias("most")),
        F.struct(F.least("m", "y").alias("a"), F.greatest("m", "y").alias("b"), F.when(F.col("py") <= F.col("px"), F.col("pxy") / F.col("px")).otherwise(1.0).alias("most")),
    )).alias("l")).select("l.*").groupBy("a", "b").agg(F.min("most").alias("most"))
    return scored.join(lowered, ["a", "b"], "left").withColumn("p", F.least("p", F.coalesce("most", F.lit(1.0)))).drop("most")


def transitive(scored: DataFrame) -> DataFrame:
    """Posteriors that keep p(a, b) p(b, c) <= p(a, c), by lowering the weaker of two links (both, if they are equal).

    Only links above one half can break it noticeably; a pair that is missing has posterior 0: after `lacking`, only
    where the references conflict.  A lowered link can break another triangle."""
    return _lowered(scored, _broken(scored))


def consistent(scored: DataFrame) -> DataFrame:
    """`transitive`, until no triangle is broken.  A link is never lowered below the third pair that asks for it, so the
    least ones are final first and it ends."""
    while not (broken := materialise(_broken(scored), "p1-broken")).isEmpty():
        scored = materialise(_lowered(scored, broken), "p1-held")
    return scored


def matched(spark: SparkSession, jobs: DataFrame, ref: DataFrame, least: float = 0.5) -> DataFrame:
    """(id_a, id_b, confidence): rows of different sources that advertise the same opening."""
    rows, made = classes(spark, jobs.select("id", "source", "title", "company", "location"), ref)
    pairs = materialise(candidates(made), "p1-pairs")
    release(spark)
    links = posteriors(spark, pairs, made).where(F.col("p") >= least).select("a", "b", "p")
    left = rows.select(F.col("cls").alias("a"), F.col("id").alias("x"), F.col("src").alias("sx"))
    right = rows.select(F.col("cls").alias("b"), F.col("id").alias("y"), F.col("src").alias("sy"))
    out = links.join(left, "a").join(right, "b").where("sx <> sy AND (a <> b OR x < y)")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.col("p").alias("confidence"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidences(spark, sf_dir).select("id_a", "id_b")


def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, table(spark, sf_dir, "jobs"), table(spark, sf_dir, "ref_locations"))

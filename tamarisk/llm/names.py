"""Problem 6: variant spellings of organisations' names, linked.

Method: a pigeonhole segment join.  Of each spelling only the distinctive words are kept (legal forms, generic business
words and their abbreviations, branch words, acronyms in front and what stands in brackets at the end are set aside) and
joined in each order of the words.  The joined words of all spellings are cut into k + 1 segments in an inverted index,
position-shifted substrings look them up, a banded edit distance verifies (see `pigeonhole`).  A shortened last word
("Tangan Sel." or the blend "Tangansel") is looked up by equality among the shortened forms of the full names.  Links
are closed to components.

The work is on distinct spellings, so a name that a third of all rows holds costs one row of the index.

Defined results: null, empty and mark-only values and values of generic words alone name none; a value is taken for a
job title, not a name, if its words are likelier under the words of `title` than under those of `company`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key, materialise, release, sql, table
from .graph import components
from .pigeonhole import MIN_FUZZY, near_sql, pigeonhole

# Legal forms of organisations, without dots and spaces.
LEGAL = (
    "ab ag as asa bv co company corp corporation cv eg ek eurl ev fze fzc gbr gmbh holding holdings inc incorporated kg "
    "kgaa limited llc llp lp ltd ltda mbh nv ohg oy oyj plc pjsc psc pte pty sa sab sac sae sal sarl sas sca se sl spa sprl srl "
    "ug wll jsc bsc ooo dwc group"
).split()

# Generic words of English organisation names.
GENERIC = (
    "academy aerospace agency airlines analytics apparel architects associates automotive aviation bank banking beverages "
    "biotech brands broadcasting capital care chemicals clinic college commerce communications computing construction "
    "consulting consultants contracting design developments digital distribution education electric electronics energy "
    "engineering enterprises entertainment equipment estates events export fashion finance financial foods foundation "
    "freight furniture games global health healthcare hospital hospitality hotels import industrial industries information "
    "institute insurance interactive international investment investments labs laboratories leasing learning logistics "
    "machinery management manufacturing marine marketing materials media medical metals mining mobility motors network "
    "networks oil partners payments petroleum pharma pharmaceuticals photography plastics power printing productions "
    "products properties publishing real recruitment renewables research resources restaurants retail robotics school "
    "science sciences security semiconductor services shipping software solutions sports steel stores studio studios "
    "supplies systems technologies technology telecom textiles tourism trade trading transport travel university utilities "
    "ventures warehousing water wholesale works"
).split()

# Words of branches and offices, and words that stand where a name is missing.
BRANCH = "head main central regional local north south east west northern southern eastern western office offices branch hq headquarters division department and the of".split()
MISSING = "na none null unknown confidential anonymous undisclosed unnamed private tba tbd various company employer organisation organization".split()

LEAST_CORE = 8  # shorter joined words are linked over an edit only in the order written and beside the same generic word
LEAST_SHORT = 5  # letters of a shortened name; the cut is in the last two words, two letters or more before the end


def _words(column: Column) -> Column:
    # One-letter abbreviations in a row are one word: "w.l.l." is wll; an ampersand is no word.
    text = F.regexp_replace(F.replace(column, F.lit("_"), F.lit(" ")), r"(?<=\b[a-z])\.(?=[a-z]\b)", "")
    return F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def spellings(jobs: DataFrame) -> DataFrame:
    """(name, n, title_like): distinct stored values that name something, with their rows."""
    # Word counts of both columns, in one pass over the distinct values of each.
    both = jobs.select(F.explode(F.array(F.struct(F.lit(0).alias("f"), F.col("company").alias("v")), F.struct(F.lit(1).alias("f"), F.col("title").alias("v")))).alias("x"))
    values = materialise(both.where("x.v IS NOT NULL").groupBy("x.f", "x.v").agg(F.count(F.lit(1)).alias("n")), "p6-values")
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    words = values.select("f", "n", F.explode(split(F.col("v"))).alias("w")).groupBy("w").agg(
        F.sum(F.when(F.col("f") == 0, F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(F.col("f") == 1, F.col("n")).otherwise(0)).alias("t")
    )
    names = values.where("f = 0").select(F.col("v").alias("name"), "n")
    used = names.select("name", F.explode(split(F.col("name"))).alias("w"))
    total = words.agg(F.sum("c").alias("cs"), F.sum("t").alias("ts"))
    odds = F.log((F.col("t") + 0.5) / (F.col("ts") + 1)) - F.log((F.col("c") + 0.5) / (F.col("cs") + 1))
    scored = used.join(words, "w").crossJoin(F.broadcast(total)).groupBy("name").agg(F.sum(odds).alias("odds"))
    return names.join(scored, "name", "left").select("name", "n", (F.coalesce("odds", F.lit(0.0)) > 0).alias("title_like"))


def _like(word: str, short: str) -> str:
    """SQL: `short` has some letters of `word`, in order, the first among them."""
    step = f"aggregate(split({short}, ''), 0, (p, c) -> IF(p < 0, -1, coalesce(nullif(locate(c, {word}, p + 1), 0), -1)))"
    return f"(length({short}) < length({word}) AND left({short}, 1) = left({word}, 1) AND {step} > 0)"


def cores(names: DataFrame, what: str = "p6") -> DataFrame:
    """(name, n, words, core, trade, brief): the distinctive words in order, joined; the generic word or its abbreviation."""
    text = key("name")
    text = F.when(F.regexp_like(text, F.lit(r"[\p{L}\p{N}].*\(.*\)\W*$")), F.regexp_replace(text, r"\([^()]*\)(\W*)$", "$1")).otherwise(text)
    split = names.select("name", "n", _words(text).alias("all"))
    listed = lambda xs: f"split('{' '.join(xs)}', ' ')"
    fixed = lambda xs: F.expr(listed(xs))
    generic = sorted({*GENERIC} - {*LEGAL, *BRANCH})
    split = split.where((F.size("all") > 0) & ~F.array_join("all", "").isin(MISSING))
    split = split.withColumn("trade", F.get(F.filter("all", lambda w: F.array_contains(fixed(generic), w)), F.lit(0)))
    split = split.withColumn("words", F.array_except("all", fixed(LEGAL + BRANCH + generic)))
    # Without a generic word, the last word may be an abbreviated or misspelt one, or end in one.
    split = split.withColumn("last", F.when(F.col("trade").isNull(), F.element_at("words", -1)))
    # Each step is written: one plan of all of them would be planned anew as a whole after each of its many stages.
    split = materialise(split.drop("all"), f"{what}-split")
    # The generic words are a fixed list, so what the last words mean is no join.
    kinds = split.select(F.col("last").alias("owner")).where("owner IS NOT NULL").distinct().select(
        "owner",
        F.expr(f"array_max(filter({listed(generic)}, w -> length(w) >= {MIN_FUZZY} AND abs(length(w) - length(owner)) <= 1 AND {near_sql('owner', 'w')}))").alias("wrong"),
        F.expr(f"array_max(transform(filter({listed(generic)}, w -> endswith(owner, w) AND length(owner) >= length(w) + 4), w -> struct(length(w) AS n, w AS w))).w").alias("tail"),
        F.expr(f"IF(length(owner) <= 5 AND exists({listed(generic)}, w -> {_like('w', 'owner')}), owner, NULL)").alias("brief"),
    )
    kinds = materialise(kinds.where("coalesce(wrong, tail, brief) IS NOT NULL").selectExpr("owner", "greatest(wrong, tail) AS meant", "left(owner, length(owner) - length(tail)) AS head", "brief"), f"{what}-kinds")
    split = split.join(kinds, F.col("last") == F.col("owner"), "left")
    several, front = F.size("words") > 1, F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0)))
    split = split.withColumns({
        "full": F.when(F.col("meant").isNull() & F.col("brief").isNotNull() & several, F.col("words")),
        "words": F.when(F.col("head").isNotNull(), F.concat(front, F.array("head"))).when(F.col("owner").isNotNull() & several, front).otherwise(F.col("words")),
        "trade": F.coalesce("trade", F.when(F.col("head").isNotNull() | several, F.col("meant"))),
        "brief": F.when(F.col("meant").isNull() & several, F.col("brief")),
    })
    split = split.withColumns({"words": _without_acronym("words"), "full": _without_acronym("full")})
    split = split.where((F.size("words") > 0) & ~F.arrays_overlap("words", fixed(MISSING)))
    split = split.withColumns({"core": F.array_join("words", ""), "full_core": F.array_join("full", "")})
    split = materialise(split.select("name", "n", "words", "full", "core", "full_core", "trade", "brief"), f"{what}-parts")
    # What looks like an abbreviation is a word of the name where the name is known with it.
    known = split.where("full IS NULL").select(F.col("core").alias("known")).distinct()
    odd = split.where("full_core IS NOT NULL").join(known.hint("merge"), F.col("full_core") == F.col("known"), "left")
    whole = F.col("known").isNotNull()
    odd = odd.select(
        "name", "n", F.when(whole, F.col("full")).otherwise(F.col("words")).alias("words"), F.when(whole, F.col("known")).otherwise(F.col("core")).alias("core"), "trade",
        F.when(~whole, F.col("brief")).alias("brief"),
    )
    return split.where("full_core IS NULL").select("name", "n", "words", "core", "trade", F.lit(None).cast("string").alias("brief")).unionByName(odd)


def _without_acronym(words: str) -> Column:
    """The words without an acronym in front or behind: the initials of the words that it stands with."""

    def without(first: bool) -> Column:
        word = F.get(words, F.lit(0)) if first else F.element_at(words, -1)
        rest = F.slice(words, F.lit(2), F.size(words)) if first else F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
        initials = F.array_join(F.transform(rest, lambda x: F.substring(x, 1, 1)), "")
        return F.when(F.length(word).between(2, 4) & F.startswith(word, initials) & (F.length(word) - F.length(initials) <= 2), rest)

    return F.coalesce(F.when(F.size(words) > 1, F.coalesce(without(True), without(False))), F.col(words))


def link(names: DataFrame, what: str = "p6") -> DataFrame:
    """names(name, n) -> (name, org, core): each name with the number of its organisation and its distinctive words joined."""
    spark = names.sparkSession
    parts = materialise(cores(names, what), f"{what}-cores")
    best = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
    forms = parts.groupBy("core").agg(F.sum("n").alias("n"), F.max_by("words", F.struct(F.size("words"), "n", "name")).alias("words"), best("trade").alias("trade"), best("brief").alias("brief"))
    forms = materialise(forms.withColumn("form", F.xxhash64("core")), f"{what}-forms")
    release(spark)
    # The joined words from each word on, the first ones at the end.
    turn = lambda i: F.array_join(F.concat(F.slice("words", i, F.size("words")), F.slice("words", 1, i - 1)), "")
    turned = forms.select(F.col("core").alias("owner"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words")), turn)).alias("gram")).distinct()
    near = pigeonhole(spark, turned, forms.select(F.col("core").alias("name")))
    agree = f"""(a.trade = b.trade OR a.trade IS NULL AND (a.brief IS NULL OR b.trade IS NULL OR {_like("b.trade", "a.brief")})
                 OR b.trade IS NULL AND (b.brief IS NULL OR {_like("a.trade", "b.brief")}))"""
    # The sides grow with the names: no join is a broadcast.
    equal = sql(
        spark,
        f"""SELECT /*+ MERGE(x, a, b) */ DISTINCT a.form AS a, b.form AS b
            FROM (SELECT owner, name, owner = gram AS plain, true AS misspelt FROM {{near}} UNION ALL SELECT owner, gram, false, false FROM {{turned}} WHERE gram <> owner) x
            JOIN {{forms}} a ON a.core = x.owner JOIN {{forms}} b ON b.core = x.name
            WHERE a.form <> b.form AND {agree} AND (NOT misspelt OR least(length(a.core), length(b.core)) >= {LEAST_CORE} OR plain AND a.trade = b.trade)""",
        near=near,
        turned=turned,
        forms=forms,
    )
    # A shortened name: the start of the joined words of a whole one (the last word's first letters, alone or run in with
    # the first word).  It goes to the name of most rows among those that it fits.
    short = forms.where("trade IS NOT NULL OR brief IS NOT NULL OR size(words) > 1")
    last_two = F.array_join(F.slice("words", F.greatest(F.size("words") - 1, F.lit(1)), F.lit(2)), "")
    whole_words = F.length("core") - F.length(last_two)
    low, high = F.greatest(F.lit(LEAST_SHORT), whole_words + 1), F.length("core") - 2
    cuts = F.when(low <= high, F.sequence(low, high))
    cut = forms.where(F.length("core") >= LEAST_CORE).select("core", F.explode(F.transform(cuts, lambda i: F.substring(F.col("core"), F.lit(1), i))).alias("short"))
    shortened = sql(
        spark,
        f"""SELECT a.form AS a, max_by(b.form, struct(b.n, b.form)) AS b
            FROM (SELECT /*+ MERGE(c, s) */ s.*, c.core AS whole FROM {{cut}} c JOIN {{short}} s ON s.core = c.short) a
            JOIN {{forms}} b ON b.core = a.whole
            WHERE {agree} GROUP BY a.form""",
        cut=cut,
        short=short,
        forms=forms,
    )
    orgs = materialise(components(equal.unionByName(shortened), f"{what}-links"), f"{what}-orgs")
    return parts.join(forms.select("core", "form"), "core").join(orgs, F.col("form") == F.col("node"), "left").select("name", F.coalesce("component", "form").alias("org"), "core")


def organisations(jobs: DataFrame) -> DataFrame:
    """(name, org) of every distinct value of `company` that names an organisation."""
    return link(spellings(jobs).where("NOT title_like").select("name", "n")).select("name", "org")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    orgs = materialise(organisations(table(spark, sf_dir, "jobs").select("title", "company")), "p6-names")
    other = orgs.select(F.col("org"), F.col("name").alias("name_b"))
    return orgs.select(F.col("name").alias("name_a"), "org").join(other, "org").where("name_a < name_b").select("name_a", "name_b")

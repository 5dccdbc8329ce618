"""Job titles as sets of canonical words: notices off, abbreviations spelt out, misspelt and run-in words led to known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key, materialise, sql
from .pigeonhole import pigeonhole

# Usual abbreviations in job titles.
SHORT = {
    "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "princ": "principal", "grad": "graduate", "dep": "deputy",
    "mid": "midlevel", "dev": "developer", "eng": "engineer", "engr": "engineer", "mgr": "manager", "mngr": "manager", "admin": "administrator",
    "arch": "architect", "spec": "specialist", "ops": "operations", "db": "database", "sys": "systems", "tech": "technical",
    "ml": "machine learning", "sre": "site reliability engineer", "swe": "software engineer", "qa": "qa", "asst": "assistant",
    "exec": "executive", "dir": "director", "rep": "representative", "coord": "coordinator", "mktg": "marketing",
}

# Words written as one or as two.
RUN_IN = ["full stack", "front end", "back end", "node js", "vue js", "react js", "next js", "mid level", "dev ops", "entry level"]

# Notices that say nothing about the opening, as patterns over words with single spaces.
NOTICES = [
    r"m f d", r"f m d", r"m w d", r"w m d", r"m f x", r"all genders", r"all levels", r"any level", r"apply now", r"apply today", r"closing soon", r"urgent(?:ly)?",
    r"immediate start", r"now hiring", r"we are hiring", r"hiring", r"\d+ vacanc(?:y|ies)", r"\d+ positions?", r"updated", r"reposted", r"new", r"hot", r"generalist", r"team",
]

REF_DIGITS = 4  # a number of so many digits or more is a reference
RATIO = 4  # a word is a misspelling of one within an edit or swap of it that so many times as many titles hold


def reference(column: str) -> Column:
    """The reference number, null where none is given."""
    return F.nullif(F.regexp_extract(F.col(column), rf"(?<!\d)(\d{{{REF_DIGITS},}})(?!\d)", 1), F.lit(""))


def words(column: str) -> Column:
    """Words in order, without reference and notices; a place named with "in" behind is left off."""
    text = F.regexp_replace(key(column), rf"\W*(?:\b(?:ref(?:erence)?|id|no)\b[\W_]*)?(?<!\d)\d{{{REF_DIGITS},}}(?!\d)", " ")
    text = F.regexp_replace(text, r"(?<=[a-z])\.(?=[a-z])", " ")
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}+#]+", " ")), F.lit(" "))
    text = F.regexp_replace(text, rf"(?<= )(?:{'|'.join(NOTICES)})(?= )", " ")
    text = F.regexp_replace(F.regexp_replace(text, " +", " "), r" in (?:[\p{L}]+ ?){1,3}$", " ")
    for pair in RUN_IN:
        text = F.replace(text, F.lit(f" {pair} "), F.lit(f" {pair.replace(' ', '')} "))
    pattern = rf"(?<= )(?:{'|'.join(SHORT)})(?= )"
    long = F.regexp_replace(text, pattern, "<$0>")
    for short, whole in SHORT.items():
        long = F.replace(long, F.lit(f"<{short}>"), F.lit(whole))
    long = F.when(text.rlike(pattern), long).otherwise(text)  # few titles hold an abbreviation
    return F.split(F.trim(long), " ")


def canonical(titles: DataFrame, what: str = "titles") -> DataFrame:
    """titles(h, words, n) -> (h, tk): the distinct canonical words, sorted and joined by spaces.

    A word is led to one within an edit or swap of it that RATIO times as many titles hold, or cut into two such words that
    were run together; else it stays.  Only the proportion of the two counts, not the number of titles."""
    spark = titles.sparkSession
    counts = titles.select("n", F.explode(F.array_distinct("words")).alias("w")).where("w <> ''").groupBy("w").agg(F.sum("n").alias("n"))
    counts = materialise(counts, f"{what}-counts")
    usual = counts.where(F.col("n") >= RATIO).select(F.col("w").alias("name"), F.col("n").alias("weight"))
    words = counts.where(F.length("w") > 3).select(F.col("w").alias("owner"), F.col("w").alias("gram"), "n")
    near = pigeonhole(spark, words, usual, least=4)
    halves = words.select("owner", "n", F.explode(F.sequence(F.lit(1), F.length("owner") - 1)).alias("i"))
    halves = halves.select("owner", "n", F.expr("left(owner, i)").alias("l"), F.expr("substring(owner, i + 1)").alias("r"))
    fixes = sql(
        spark,
        f"""SELECT owner, max_by(fixed, struct(kind, weight, fixed)) AS fixed FROM (
               SELECT n.owner, n.name AS fixed, 1 AS kind, k.weight FROM {{near}} n JOIN {{usual}} k ON n.name = k.name
               JOIN {{words}} w ON n.owner = w.owner WHERE k.weight >= {RATIO} * w.n
               UNION ALL
               SELECT h.owner, concat(l.name, ' ', r.name), 0, least(l.weight, r.weight)
               FROM {{halves}} h JOIN {{usual}} l ON h.l = l.name JOIN {{usual}} r ON h.r = r.name
               WHERE least(l.weight, r.weight) >= {RATIO} * h.n)
           GROUP BY owner""",
        near=near,
        usual=usual,
        halves=halves,
        words=words,
    )
    fixes = materialise(fixes, f"{what}-fixes")
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), " ")
    # Only the titles that hold a word to be led on are changed.
    odd = titles.select("h", F.explode(F.array_distinct("words")).alias("owner")).join(fixes, "owner").groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("owner", "fixed"))).alias("fixes"))
    led = titles.join(odd, "h", "left")
    text = F.concat(F.lit(" "), F.array_join(F.transform("words", lambda w: F.coalesce(F.get(F.map_values(F.map_filter("fixes", lambda k, v: k == w)), F.lit(0)), w)), " "), F.lit(" "))
    for pair in RUN_IN:
        text = F.replace(text, F.lit(f" {pair} "), F.lit(f" {pair.replace(' ', '')} "))
    return led.select("h", F.when(F.col("fixes").isNull(), join("words")).otherwise(join(F.split(F.trim(text), " "))).alias("tk"))

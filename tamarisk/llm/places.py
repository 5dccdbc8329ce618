"""Problem 3: free-typed values to the entries of a reference list.

Method: a partition-based pigeonhole join, in SQL only.  A reference string is cut into k + 1 segments, so k edits leave
at least one whole; the segment is found by equality on (length, segment number, text) at the few positions a value can
hold it, and built-in levenshtein verifies.  What has no entry comes from an anti join with id 0.

The values typed are reduced to the distinct ones first, so a value that a third of all rows holds costs one row.

Defined results: null and blank values (white space or invisible characters only) give no row; every other value gives
exactly one, the entry's id or 0.  A name that covers more of the value beats one that covers less, then an exact one a
misspelt one, then a longer one a shorter one.
A value that names a country fits only entries of that country; a name of two entries without a country gives 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_sql, materialise, sql, table
from .pigeonhole import pigeonhole

# Words of a value and each n-gram, joined without spaces, that is one word or short enough for a name with one letter more; its place
# and number of words.
GRAMS = """
    SELECT * FROM (
        SELECT field_name, raw_value, n_words, at, n, longest, array_join(slice(words, at, n), '') AS gram,
               at + n - 1 = n_words AS at_end
        FROM (SELECT *, explode(sequence(1, least(longest, n_words - at + 1))) AS n
              FROM (SELECT field_name, raw_value, words, longest, size(words) AS n_words, explode(sequence(1, size(words))) AS at
                    FROM (SELECT *, {longest} AS longest FROM {split}) WHERE size(words) > 0)))
    WHERE length(gram) <= longest OR n = 1
"""


def _grams(spark: SparkSession, split: DataFrame, *lists: DataFrame) -> DataFrame:
    """The n-grams of values that may be a name of the reference lists."""
    longest = max(x.agg(F.coalesce(F.max(F.length("name")), F.lit(0)).alias("n")).first().n for x in lists)
    return sql(spark, GRAMS.replace("{longest}", str(longest + 1)), split=split)


def _values(spark: SparkSession, jobs: DataFrame, field: str) -> DataFrame:
    """Distinct values with their words; a letter-case or look-alike difference is none for the words."""
    return sql(
        spark,
        rf"""SELECT '{field}' AS field_name, raw_value, form,
                    filter(split(regexp_replace(form, '[^\\p{{L}}\\p{{N}}]+', ' '), ' '), x -> x <> '') AS words
             FROM (SELECT raw_value, {key_sql('raw_value')} AS form
                   FROM (SELECT DISTINCT `{field}` AS raw_value FROM {{jobs}} WHERE `{field}` IS NOT NULL))
             WHERE form <> ''""",
        jobs=jobs,
    )


NAME = r"regexp_replace(%s, '[^\\p{L}\\p{N}]+', '')"


def match_locations(spark: SparkSession, jobs: DataFrame, places: DataFrame) -> DataFrame:
    """(field_name, raw_value, ref_id) of `location`."""
    split = materialise(_values(spark, jobs, "location"), "p3-values")
    return _with_unmatched(spark, split, locations_of(spark, split, places))


def locations_of(spark: SparkSession, split: DataFrame, places: DataFrame) -> DataFrame:
    """(raw_value, ref_id) of the values that have an entry (0: of several entries, none of which is named)."""
    squeeze = lambda c: NAME.replace("%s", key_sql(c))
    names = sql(
        spark,
        f"""SELECT location_id, name, kind, {squeeze("country")} AS country
            FROM (SELECT location_id, country, {squeeze("city")} AS name, 'city' AS kind FROM {{places}}
                  UNION ALL SELECT location_id, country, {squeeze("local_name")}, 'local' FROM {{places}}
                  UNION ALL SELECT location_id, country, {squeeze("city_code")}, 'code' FROM {{places}})
            WHERE name <> ''""",
        places=places,
    )
    countries = sql(
        spark,
        f"""SELECT DISTINCT {squeeze("country")} AS country, {squeeze("country")} AS name, false AS is_code FROM {{places}}
            UNION SELECT DISTINCT {squeeze("country")}, {squeeze("country_code")}, true FROM {{places}}""",
        places=places,
    )
    # Written, since each step below plans them again.
    names, countries = materialise(names.coalesce(1), "p3-names"), materialise(countries.coalesce(1), "p3-countries")
    grams = _grams(spark, split, names, countries)
    # The country a value names: by name anywhere, by code only as its last word.
    named = sql(
        spark,
        """SELECT g.raw_value, collect_set(c.country) AS countries
           FROM {grams} g JOIN {countries} c ON g.gram = c.name
           WHERE NOT c.is_code OR (g.n = 1 AND g.at_end AND g.n_words > 1)
           GROUP BY g.raw_value""",
        grams=grams,
        countries=countries,
    )
    exact = sql(
        spark,
        """SELECT g.raw_value, n.location_id, n.country, length(g.gram) AS covered, true AS exact, length(n.name) AS len
           FROM {grams} g JOIN {names} n ON g.gram = n.name""",
        grams=grams,
        names=names,
    )
    exact = materialise(exact, "p3-exact")
    rest = sql(
        spark,
        """SELECT g.raw_value AS owner, g.gram FROM {grams} g
           LEFT ANTI JOIN {countries} c ON g.gram = c.name""",
        grams=grams,
        countries=countries,
    )
    near = pigeonhole(spark, rest, sql(spark, "SELECT name FROM {names} WHERE kind <> 'code'", names=names))
    close = sql(
        spark,
        """SELECT v.owner AS raw_value, n.location_id, n.country, length(v.gram) AS covered, false AS exact, length(v.name) AS len
           FROM {near} v JOIN {names} n ON v.name = n.name AND n.kind <> 'code'""",
        near=near,
        names=names,
    )
    close = materialise(close, "p3-close")
    fits = sql(
        spark,
        """SELECT raw_value, IF(min(location_id) = max(location_id), min(location_id), 0) AS ref_id
           FROM (SELECT f.*, rank() OVER (PARTITION BY f.raw_value ORDER BY f.covered DESC, f.exact DESC, f.len DESC) AS r
                 FROM (SELECT * FROM {exact} UNION ALL SELECT * FROM {close}) f
                 LEFT JOIN {named} c ON f.raw_value = c.raw_value
                 WHERE c.countries IS NULL OR array_contains(c.countries, f.country))
           WHERE r = 1 GROUP BY raw_value""",
        exact=exact,
        close=close,
        named=named,
    )
    return materialise(fits, "p3-fits")


def match_job_types(spark: SparkSession, jobs: DataFrame, types: DataFrame) -> DataFrame:
    """(field_name, raw_value, ref_id) of `job_type`: a label; its initials; the label's stem; else a misspelt label."""
    squeeze = lambda c: NAME.replace("%s", key_sql(c))
    split = materialise(_values(spark, jobs, "job_type"), "p3-values")
    names = sql(
        spark,
        f"""SELECT job_type_id, {squeeze("label")} AS name,
                   IF(size(words) > 1, array_join(transform(words, x -> left(x, 1)), ''), NULL) AS initials
            FROM (SELECT job_type_id, label, split({key_sql("label")}, ' ') AS words FROM {{types}})""",
        types=types,
    )
    names = materialise(names.coalesce(1), "p3-names")
    grams = _grams(spark, split, names)
    exact = sql(
        spark,
        """SELECT g.raw_value, n.job_type_id, 1 AS how, g.at FROM {grams} g JOIN {names} n ON g.gram = n.name
           UNION ALL
           SELECT g.raw_value, n.job_type_id, 2, g.at FROM {grams} g JOIN {names} n ON g.gram = n.initials""",
        grams=grams,
        names=names,
    )
    near = pigeonhole(spark, grams.selectExpr("raw_value AS owner", "gram"), names)
    close = sql(
        spark,
        """SELECT v.owner AS raw_value, n.job_type_id, 3 AS how, 1 AS at FROM {near} v JOIN {names} n ON v.name = n.name""",
        near=near,
        names=names,
    )
    # A word of four letters or more that starts a label, or that a label or its stem starts (plural -s is no difference).
    stems = sql(
        spark,
        """SELECT g.raw_value, n.job_type_id, 4 AS how, g.at
           FROM (SELECT raw_value, at, regexp_replace(gram, 's$', '') AS stem FROM {grams} WHERE n = 1) g
           JOIN {names} n ON left(g.stem, 4) = left(n.name, 4)
           WHERE length(g.stem) >= 4 AND (startswith(n.name, g.stem) OR startswith(g.stem, n.name))""",
        grams=grams,
        names=names,
    )
    fits = sql(
        spark,
        """SELECT raw_value, IF(min(job_type_id) = max(job_type_id), min(job_type_id), 0) AS ref_id
           FROM (SELECT *, rank() OVER (PARTITION BY raw_value ORDER BY how, at) AS r
                 FROM (SELECT * FROM {exact} UNION ALL SELECT * FROM {close} UNION ALL SELECT * FROM {stems}))
           WHERE r = 1 GROUP BY raw_value""",
        exact=exact,
        close=close,
        stems=stems,
    )
    return _with_unmatched(spark, split, materialise(fits, "p3-fits"))


def _with_unmatched(spark: SparkSession, split: DataFrame, fits: DataFrame) -> DataFrame:
    return sql(
        spark,
        """SELECT s.field_name, s.raw_value, CAST(f.ref_id AS INT) AS ref_id
           FROM {split} s JOIN {fits} f ON s.raw_value = f.raw_value
           UNION ALL
           SELECT s.field_name, s.raw_value, CAST(0 AS INT) FROM {split} s LEFT ANTI JOIN {fits} f ON s.raw_value = f.raw_value""",
        split=split,
        fits=fits,
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs")
    return match_locations(spark, jobs, table(spark, sf_dir, "ref_locations")).unionByName(
        match_job_types(spark, jobs, table(spark, sf_dir, "ref_job_types"))
    )

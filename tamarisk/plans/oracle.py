"""The same results in SQL for DuckDB, built from the same rule data."""

from __future__ import annotations

from functools import reduce

from tamarisk import rules as R
from tamarisk.plans.queries import BASE_A, HOST_B, SPLIT_DAY
from tamarisk.rules import EXAMPLE as RULES

WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(map(s, xs)) + "]"


def any_in(text: str, patterns) -> str:
    return f"(len(list_filter({lst(patterns)}, lambda p: contains({text}, p))) > 0)" if patterns else "false"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {s(WS)}, ' ', 'g'), ' ')"


def nt(x: str) -> str:
    return collapse(f"lower(coalesce({x}, ''))")


def nc(x: str) -> str:
    bare = f"regexp_replace({nt(x)}, {s(chr(92) + 'b(' + '|'.join(R.COMPANY_SUFFIXES) + ')' + chr(92) + 'b')}, '', 'g')"
    return f"trim(regexp_replace({bare}, {s(WS)}, ' ', 'g'), ' ,.-')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {s('^' + WS + '|' + WS + '$')}, '', 'g')"


def esc(x: str) -> str:
    return f"replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def kept_query(query: str, keys, prefix: str = R.TRACKING_PREFIX) -> str:
    key = "lower(split_part(x, '=', 1))"
    kept = f"list_filter(string_split({query}, '&'), lambda x: x <> '' AND NOT list_contains({lst(keys)}, {key}) AND NOT starts_with({key}, {s(prefix)}))"
    return f"array_to_string(list_transform({kept}, lambda y: CASE WHEN contains(y, '=') THEN y ELSE y || '=' END), '&')"


def canonical(x: str) -> str:
    u = strip(f"coalesce({x}, '')")
    part = lambda i: f"regexp_extract({u}, {s(URL)}, {i})"
    path = f"CASE WHEN rtrim({part(3)}, '/') = '' THEN {part(3)} ELSE rtrim({part(3)}, '/') END"
    query = kept_query(part(4), R.TRACKING_KEYS)
    return f"""CASE WHEN coalesce({x}, '') = '' THEN '' ELSE
        CASE WHEN {part(1)} = '' THEN 'https' ELSE lower({part(1)}) END || ':' || CASE WHEN {part(2)} <> '' THEN '//' || lower({part(2)}) ELSE '' END
        || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"""


def numbered(x: str) -> str:
    return f"regexp_extract(coalesce({x}, ''), '(?i)/jobs/view/(?:[^/?#]*-)?([0-9]+)(?:[/?#]|\\n?$)', 1)"


def site(x: str) -> str:
    u = strip(f"coalesce({x}, '')")
    part = lambda i: f"regexp_extract({u}, {s(URL)}, {i})"
    path = f"CASE WHEN rtrim({part(3)}, '/') = '' THEN {part(3)} ELSE rtrim({part(3)}, '/') END"
    query = kept_query(part(4), R.VOLATILE_KEYS)
    there = f"contains(lower({part(2)}), 'worklink.example')"
    host = f"CASE WHEN {there} THEN '{HOST_B}' ELSE lower({part(2)}) END"
    number = f"coalesce(nullif({numbered(path)}, ''), {numbered(x)})"
    return f"""CASE WHEN coalesce({x}, '') = '' THEN '' WHEN {number} <> '' AND {there} THEN 'https://{HOST_B}/jobs/view/' || {number}
        ELSE 'https:' || CASE WHEN {part(2)} <> '' THEN '//' || {host} ELSE '' END || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"""


TAGS = "coalesce(array_to_string(tags, ' '), '')"
KEYWORDS = f"lower(coalesce(title, '') || ' ' || {TAGS})"
INCLUDED = f"({any_in(KEYWORDS, RULES.include)} AND NOT {any_in(KEYWORDS, RULES.exclude)})"
PLACE = "lower(coalesce(location, ''))"
COUNTRY = "(" + " OR ".join(any_in(PLACE, c) for c in RULES.countries) + ")"
REMOTE_TEXT = f"lower(concat_ws(' ', coalesce(title, ''), coalesce(location, ''), coalesce(job_type, ''), {TAGS}))"
REMOTE = f"(coalesce(is_remote, false) OR {any_in(REMOTE_TEXT, RULES.remote)})"
GEO = f"(coalesce(list_contains({lst(RULES.remote_only)}, source), false) OR {COUNTRY} OR {REMOTE})"
REQUIRED = "(coalesce(title, '') <> '' AND coalesce(url, '') <> '')"
SOURCE = "lower(trim(coalesce(source, ''), ' '))"
RUNTIME = f"({REQUIRED} AND ({SOURCE} = '{RULES.site_b}' OR {INCLUDED}) AND {GEO})"
WORDS = f"lower(concat_ws(' ', coalesce(title, ''), coalesce(company, ''), {TAGS}))"


def _routes() -> str:
    parts = []
    for i, r in enumerate(RULES.topics):
        test = {"all": "true", "source": f"list_contains({lst(r.values)}, {SOURCE})", "geo": any_in(PLACE, r.values), "keywords": any_in(WORDS, r.values)}[r.kind]
        parts.append(f"SELECT id, {i} AS ord, {s(r.topic_key)} AS topic_key FROM jobs WHERE {test}")
    return " UNION ALL ".join(parts)


ROUTES = _routes()
LABEL_TEXT = f"lower(concat_ws(' ', coalesce(title, ''), coalesce(location, ''), {TAGS}))"
LABEL = "CASE " + " ".join(f"WHEN contains({LABEL_TEXT}, {s(w)}) THEN {s(label)}" for w, label in RULES.labels) + f" ELSE {s(RULES.default_label)} END"
TITLED = "array_to_string(list_transform(regexp_extract_all(lower(coalesce(source, '')), '\\p{L}+|[^\\p{L}]+'), lambda p: upper(p[1]) || p[2:]), '')"
SHOWN = f"coalesce(nullif(original_source, ''), CASE source {' '.join(f'WHEN {s(k)} THEN {s(v)}' for k, v in RULES.display)} END, {TITLED})"
IDENTITY = f"(SELECT * EXCLUDE (canonical_url, content_hash), {canonical('url')} AS canonical_url, sha256(concat_ws('|', {nt('title')}, {nc('company')}, {nt('location')}, {canonical('url')})) AS content_hash FROM jobs)"
HALVES = f"""rows_ AS (SELECT * FROM {IDENTITY} WHERE title IS NOT NULL AND url <> ''),
    stored AS (SELECT * FROM rows_ WHERE first_seen_at < TIMESTAMPTZ '{SPLIT_DAY} 00:00:00+00' QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY id) = 1),
    incoming AS (SELECT * FROM rows_ WHERE first_seen_at >= TIMESTAMPTZ '{SPLIT_DAY} 00:00:00+00' AND title <> ''),
    last_ AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY id DESC) = 1),
    firsts AS (SELECT content_hash, min(id) AS first_seq FROM incoming GROUP BY 1),
    new_ AS (SELECT l.*, (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY f.first_seq) AS new_id
             FROM last_ l JOIN firsts f USING (content_hash) WHERE l.content_hash NOT IN (SELECT content_hash FROM stored))"""
LATEST = """(SELECT job_id, topic_key, status = 'sent' AS ok, CASE WHEN status = 'sent' THEN 'sent' ELSE 'failed' END AS status,
        CASE WHEN status = 'sent' THEN updated_at END AS sent_at, coalesce(error, '') AS error, updated_at FROM job_sends
        QUALIFY row_number() OVER (PARTITION BY job_id, topic_key ORDER BY updated_at DESC, job_sends.status DESC, coalesce(error, '') DESC, coalesce(sent_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC) = 1)"""
HEALTH = """(SELECT lower(trim(source, ' ')) AS source, coalesce(last_run_at, updated_at) AS last_run_at, status, coalesce(error, '') AS error, updated_at FROM source_runs WHERE source IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY lower(trim(source, ' ')) ORDER BY updated_at DESC, last_run_at DESC NULLS LAST, status DESC, coalesce(error, '') DESC) = 1)"""
STATUS = """CASE WHEN n_topics = 0 THEN 'skipped' WHEN n_left = 0 THEN 'sent' WHEN n_sent > 0 THEN 'partial' ELSE 'retry' END"""
AGE_CARD = "CASE WHEN id % 13 = 0 THEN 'just now' ELSE 'posted ' || (id % 40) || ' ' || ['minutes','hours','day','weeks','months'][id % 5 + 1] || ' ago' END"
AGE = f"""CASE WHEN contains({AGE_CARD}, 'just now') THEN 0 ELSE coalesce(
    try_cast(nullif(regexp_extract({AGE_CARD}, '([0-9]+) (?:minute|minutes|min|mins) ago', 1), '') AS BIGINT) * 60,
    try_cast(nullif(regexp_extract({AGE_CARD}, '([0-9]+) (?:hour|hours|hr|hrs) ago', 1), '') AS BIGINT) * 3600,
    try_cast(nullif(regexp_extract({AGE_CARD}, '([0-9]+) (?:day|days) ago', 1), '') AS BIGINT) * 86400,
    try_cast(nullif(regexp_extract({AGE_CARD}, '([0-9]+) (?:week|weeks) ago', 1), '') AS BIGINT) * 604800) END"""
_TYPES = ["Full Time", "Part Time", "Contract", "Hybrid", "Remote", "Shift"]

# What the pages of site A and B hold, by the parsers' rules, straight from the postings.
TYPES_A = list(dict.fromkeys(R.A_JOB_TYPES + R.A_WORKPLACES))
_present = lambda text, types: f"array_to_string(list_filter({lst(types)}, lambda p: contains(lower({text}), lower(p)))[1:3], ' | ')"
_PLACE_A = f"trim({collapse('coalesce(location, ' + chr(39) * 2 + ')')}, ' -')"
_TAG_A = "coalesce(tags[1], '3 - 5 yrs of exp')"
PAGE_A = f"""SELECT id // {R.PAGE_SIZE_A} AS page_id, id, {collapse("coalesce(title, '')")} AS title, trim({collapse("coalesce(company, '')")}, ' -') AS company,
    {_PLACE_A} AS place, '{BASE_A}' || regexp_extract(url, {s(URL)}, 3) AS url,
    {collapse("coalesce(company, '') || ' - ' || coalesce(location, '') || ' Apply ' || coalesce(job_type, '') || ' ' || " + _TAG_A + " || ' posted 2 days ago'")} AS whole,
    [{collapse("coalesce(company, '') || ' -'")}, {collapse("coalesce(location, '')")}, 'Apply', {collapse("coalesce(job_type, '')")}, {_TAG_A}] AS texts
    FROM jobs WHERE contains(url, '/jobs/p/')"""
GOOD_TAG = "t <> '' AND NOT list_contains(" + lst(R.A_BLOCKED_TAGS) + r", lower(t)) AND length(t) <= 70 AND NOT contains(lower(t), 'jobs and careers at') AND NOT ends_with(lower(t), 'ago') AND NOT regexp_matches(lower(t), '\b[0-9]+\s*-\s*[0-9]+\s+yrs?\b')"
PAGE_B = f"""SELECT id // {R.PAGE_SIZE_B} AS page_id, id, trim({collapse("coalesce(title, '')")}, ' -') AS title, trim({collapse("coalesce(company, '')")}, ' -') AS company,
    coalesce(nullif(trim({collapse("coalesce(location, '')")}, ' -'), ''), 'Somewhere') AS location, {site(strip('url'))} AS url, url AS raw,
    trim({collapse("'x ' || coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || coalesce(location, '') || ' ' || coalesce(job_type, '') || ' ' || (id % 5 + 1) || CASE WHEN id % 2 = 0 THEN ' minutes ago' ELSE ' hours ago' END")}, ' -') AS whole,
    coalesce(title, '') AS t0, coalesce(company, '') AS c0, coalesce(location, '') AS l0, coalesce(job_type, '') AS j0
    FROM jobs WHERE contains(url, '/jobs/view/') AND id % 11 > 0 AND (id % 2 = 0 OR id % 5 + 1 <= 2)"""

ORACLE = {
    "route_topics_count": f"SELECT topic_key, count(*) AS n FROM ({ROUTES}) GROUP BY 1",
    "route_topics_ordered": f"SELECT id, string_agg(topic_key, ',' ORDER BY ord) AS topics FROM ({ROUTES}) GROUP BY 1",
    "topic_name_lookup": f"SELECT r.topic_key, coalesce(t.topic_name, r.topic_key) AS topic_name, count(*) AS n FROM ({ROUTES}) r LEFT JOIN topics t ON r.topic_key = t.topic_key GROUP BY 1, 2",
    "required_fields": f"SELECT count(*) AS n FROM jobs WHERE {REQUIRED}",
    "include_exclude_filter": f"SELECT id FROM jobs WHERE {INCLUDED}",
    "any_substring": "SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'load tests') OR contains(lower(coalesce(text, '')), 'cache layers')",
    "country_filter": f"SELECT id FROM jobs WHERE {COUNTRY}",
    "remote_filter": f"SELECT id FROM jobs WHERE {REMOTE}",
    "geo_or_filter": f"SELECT id FROM jobs WHERE {GEO}",
    "library_filter": f"SELECT id FROM jobs WHERE {REQUIRED} AND {INCLUDED} AND {GEO}",
    "runtime_filter_by_source": f"SELECT lower(trim(source, ' ')) AS src, count(*) AS n FROM jobs WHERE {RUNTIME} GROUP BY 1",
    "first_match_label": f"SELECT id, {LABEL} AS label FROM jobs",
    "display_name": f"SELECT id, {SHOWN} AS shown FROM jobs",
    "normalize_text": f"SELECT id, {nt('title')} AS title, {nt('location')} AS location FROM jobs",
    "normalize_company": f"SELECT id, {nc('company')} AS company FROM jobs",
    "flatten_tags": f"SELECT id, {TAGS} AS tags FROM jobs",
    "tags_json_roundtrip": "SELECT id, '[' || array_to_string(list_transform(coalesce(tags, []), lambda t: '\"' || t || '\"'), ', ') || ']' AS raw, coalesce(array_to_string(tags, '|'), '') AS tags FROM jobs",
    "canonical_url": f"SELECT id, {canonical('url')} AS url FROM jobs",
    "site_url": f"SELECT id, {site('url')} AS url FROM jobs",
    "url_ids": f"SELECT id, {numbered('url')} AS number, regexp_extract(coalesce(url, ''), '/jobs/p/([^/?#]+)', 1) AS slug FROM jobs",
    "url_query_params": f"""SELECT split_part(x, '=', 1) AS key, count(*) AS n, count(DISTINCT substr(x, strpos(x, '=') + 1)) AS n_values
        FROM (SELECT unnest(string_split(regexp_extract(url, {s(URL)}, 4), '&')) AS x FROM jobs) WHERE x <> '' GROUP BY 1""",
    "resolve_links": f"SELECT id, split_part(CASE WHEN starts_with(p, '/') THEN '{BASE_A}' || p ELSE '{BASE_A}/' || p END, '?', 1) AS url FROM (SELECT id, regexp_replace(coalesce(url, ''), '^https?://[^/]*', '') AS p FROM jobs)",
    "page_offsets": f"""SELECT id, CAST(start AS INT) AS start, CASE WHEN start = 0 THEN u ELSE regexp_replace(u, '\\?.*$', '') || '?' || CASE WHEN contains(u, '?') THEN split_part(u, '?', 2) || '&' ELSE '' END || 'start=' || start END AS url
        FROM (SELECT id, {canonical('url')} AS u FROM jobs), (SELECT unnest([0, {R.PAGE_SIZE_A}, {2 * R.PAGE_SIZE_A}]) AS start)""",
    "search_params_merge": f"SELECT id, 'r3600' AS f_tpr, CASE WHEN id % 3 = 0 THEN 'R' ELSE 'DD' END AS sortby, coalesce(location, '') AS location, CAST(id % 3 * {R.PAGE_SIZE_B} AS VARCHAR) AS start FROM jobs",
    "log_redaction": "SELECT id, 'location' AS keys FROM jobs",
    "content_hash": f"SELECT id, content_hash FROM {IDENTITY}",
    "title_case": f"SELECT DISTINCT {SOURCE} AS s, {TITLED.replace('coalesce(source, ' + chr(39) * 2 + ')', SOURCE)} AS shown FROM jobs",
    "html_escape": f"SELECT id, {esc('title')} AS title, {esc(chr(97) + 'rray_to_string(tags, ' + s(', ') + ')')} AS tags FROM jobs",
    "html_clean": f"""SELECT id, {collapse("translate(coalesce(title, ''), '<>', '') || ' <i> - ' || translate(coalesce(company, ''), '<>', '') || ' -'")} AS tags_first,
        trim({collapse("regexp_replace('var a = ''&''; ' || translate(coalesce(title, ''), '<>', '') || '   p {} - ' || translate(coalesce(company, ''), '<>', '') || ' -', '&', ' ')")}, ' -') AS entities_first FROM jobs""",
    "render_card": f"""SELECT id, concat_ws(chr(10), {LABEL} || ' <b>' || {esc('title')} || '</b>', '🏢 ' || CASE WHEN coalesce(company, '') <> '' THEN {esc('company')} ELSE 'Unknown' END,
        '📍 ' || CASE WHEN coalesce(location, '') <> '' THEN {esc('location')} ELSE 'Not specified' END, CASE WHEN coalesce(salary, '') <> '' THEN '💰 ' || {esc('salary')} END,
        CASE WHEN coalesce(job_type, '') <> '' THEN '📋 ' || {esc('job_type')} END, CASE WHEN coalesce(is_remote, false) THEN '🌍 Remote' END, '',
        '🔗 <a href="' || {esc('url')} || '">Apply Now</a>', '📡 Source: ' || {esc(SHOWN)}) AS card FROM jobs""",
    "link_counts": f"SELECT page_id, CAST(sum(CASE WHEN id % 7 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM ({PAGE_A}) GROUP BY 1",
    "li_cards": f"SELECT id // {R.PAGE_SIZE_B} AS page_id, count(*) AS n FROM jobs WHERE contains(url, '/jobs/view/') GROUP BY 1",
    "dedup_first_by_url": f"SELECT rtrim(lower({canonical('url')}), '/') AS u, min(id) AS id FROM jobs WHERE url <> '' GROUP BY 1",
    "pattern_types": f"SELECT id, {_present(f'''concat_ws(' ', coalesce(job_type, ''), coalesce(title, ''), coalesce(array_to_string(tags, ' '), ''))''', _TYPES)} AS types FROM jobs",
    "noise_tags": f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE {GOOD_TAG.replace('t <> ' + chr(39) * 2 + ' AND NOT list_contains(' + lst(R.A_BLOCKED_TAGS) + ', lower(t)) AND ', '')} GROUP BY 1",
    "location_markers": f"SELECT id FROM jobs WHERE {any_in(PLACE, R.A_PLACES)}",
    "relative_age": f"SELECT id, CAST({AGE} AS BIGINT) AS age FROM jobs",
    "freshness_filter": f"SELECT id FROM jobs WHERE coalesce({AGE} <= 3600, true)",
    "closed_cards": f"SELECT doc_id FROM documents WHERE {any_in('lower(coalesce(text, ' + chr(39) * 2 + '))', R.B_CLOSED)}",
    "service_messages": "SELECT id AS update_id, '-100' AS chat_id, id AS message_id FROM jobs WHERE id % 10 > 0 AND id % 3 > 0 AND id % 4 > 0",
    "deleted_messages": "SELECT count(*) AS n FROM jobs WHERE id % 10 > 0 AND id % 3 > 0 AND id % 4 > 0 AND id % 7 > 0",
    "legacy_ids": f"""SELECT id, concat({strip("lower(coalesce(title, ''))")}, '|', {reduce(lambda c, noise: strip(f"replace({c}, {s(noise)}, '')"), R.LEGACY_NOISE, strip("lower(coalesce(company, ''))"))}) AS unique_id,
        lower(regexp_replace(split_part(split_part(coalesce(url, ''), '?utm', 1), '&utm', 1), '/+$', '')) AS url_id FROM jobs""",
    "upsert_jobs": f"""WITH {HALVES}
        SELECT s.id, s.content_hash, coalesce(l.title, s.title) AS title, CASE WHEN l.id IS NULL THEN s.company ELSE l.company END AS company, s.send_status,
               CAST(epoch(s.first_seen_at) AS BIGINT) AS first_seen, CASE WHEN l.id IS NULL THEN CAST(epoch(s.last_seen_at) AS BIGINT) ELSE 1767225600 END AS last_seen
        FROM stored s LEFT JOIN last_ l ON s.content_hash = l.content_hash
        UNION ALL SELECT new_id, content_hash, title, company, 'pending', 1767225600, 1767225600 FROM new_""",
    "upsert_new_ids": f"WITH {HALVES} SELECT new_id AS id, content_hash FROM new_",
    "upsert_counts": f"WITH {HALVES} SELECT (SELECT count(*) FROM new_) AS inserted, (SELECT count(*) FROM incoming) - (SELECT count(*) FROM new_) AS refreshed",
    "dedup_last_wins": f"SELECT id, content_hash, title, location FROM {IDENTITY} QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY id DESC) = 1",
    "ledger_latest": f"SELECT job_id, topic_key, status, error, CAST(epoch(sent_at) AS BIGINT) AS sent, CAST(epoch(updated_at) AS BIGINT) AS updated FROM {LATEST}",
    "sent_topics_set": f"SELECT job_id, string_agg(topic_key, ',' ORDER BY topic_key) AS sent FROM {LATEST} WHERE ok GROUP BY 1",
    "unsent_topics_anti": f"SELECT id, topic_key FROM ({ROUTES}) r WHERE NOT EXISTS (SELECT 1 FROM {LATEST} l WHERE l.ok AND l.job_id = r.id AND l.topic_key = r.topic_key)",
    "send_status_rollup": f"""SELECT {STATUS} AS status, count(*) AS n FROM (SELECT j.id, count(r.topic_key) AS n_topics, count(r.topic_key) - count(l.topic_key) AS n_left, coalesce(max(x.n), 0) AS n_sent
        FROM jobs j LEFT JOIN ({ROUTES}) r ON r.id = j.id LEFT JOIN (SELECT * FROM {LATEST} WHERE ok) l ON l.job_id = r.id AND l.topic_key = r.topic_key
        LEFT JOIN (SELECT job_id, count(*) AS n FROM {LATEST} WHERE ok GROUP BY 1) x ON x.job_id = j.id GROUP BY 1) GROUP BY 1""",
    "retry_queue_topk": f"SELECT id, send_status, CAST(epoch(first_seen_at) AS BIGINT) AS first_seen FROM (SELECT * FROM jobs WHERE send_status IN ('pending', 'retry', 'partial') ORDER BY first_seen_at, id LIMIT {R.QUEUE_LIMIT})",
    "send_counters": "SELECT count(*) AS attempts, count_if(status = 'sent') AS successes, count_if(status <> 'sent') AS failures FROM job_sends",
    "topic_success_count": "SELECT topic_key, CAST(sum(CASE WHEN status = 'sent' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM job_sends GROUP BY 1",
    "result_default_false": f"SELECT r.topic_key, count_if(coalesce(l.ok, false)) AS n_true, count_if(NOT coalesce(l.ok, false)) AS n_false FROM ({ROUTES}) r LEFT JOIN {LATEST} l ON l.job_id = r.id AND l.topic_key = r.topic_key GROUP BY 1",
    "seed_skip_all": "SELECT CASE WHEN send_status IN ('pending', 'retry', 'partial') THEN 'skipped' ELSE send_status END AS send_status, count(*) AS n FROM jobs GROUP BY 1",
    "status_update": "SELECT CASE WHEN send_status = 'pending' THEN 'retry' ELSE send_status END AS send_status, count(*) AS n FROM jobs GROUP BY 1",
    "source_health": f"SELECT source, CAST(epoch(last_run_at) AS BIGINT) AS last_run, status, error, CAST(epoch(updated_at) AS BIGINT) AS updated FROM {HEALTH}",
    "source_last_run": f"SELECT CAST(epoch(last_run_at) AS BIGINT) AS last_run FROM {HEALTH} WHERE source = 'worklink'",
    "source_union": f"SELECT CAST(list_position(['nilehire', 'worklink', 'gulfboard'], {SOURCE}) - 1 AS INT) AS source_ord, {SOURCE} AS s, count(*) AS n FROM jobs WHERE {SOURCE} IN ('nilehire', 'worklink', 'gulfboard') GROUP BY 1, 2",
    "count_jobs": "SELECT count(*) AS n FROM jobs",
    "run_summary": f"""WITH {HALVES} SELECT (SELECT count(*) FROM jobs) AS fetched, (SELECT count(*) FROM jobs WHERE {RUNTIME}) AS kept, (SELECT count(*) FROM new_) AS inserted,
        (SELECT count(*) FROM incoming) - (SELECT count(*) FROM new_) AS refreshed, (SELECT count(*) FROM job_sends) AS attempts,
        (SELECT count(*) FROM job_sends WHERE status = 'sent') AS successes, (SELECT count(*) FROM job_sends WHERE status <> 'sent') AS failures""",
    "constraint_problems": """SELECT problem, count(*) AS n FROM (SELECT 'null in sent_at' AS problem FROM job_sends WHERE sent_at IS NULL
        UNION ALL SELECT 'repeated job_id, topic_key' FROM (SELECT 1 FROM job_sends GROUP BY job_id, topic_key HAVING count(*) > 1)) GROUP BY 1""",
    "late_data_filter": """SELECT id, CAST(epoch(last_seen_at) AS BIGINT) - CASE WHEN id % 9 > 0 THEN age ELSE 0 END AS event_time
        FROM (SELECT *, CAST(epoch(last_seen_at) AS BIGINT) - CAST(epoch(first_seen_at) AS BIGINT) AS age FROM jobs) WHERE id % 9 = 0 OR coalesce(age <= 604800, true)""",
    "parse_links": f"""WITH p AS ({PAGE_A}), f AS (SELECT * FROM p WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY id) = 1),
        x AS (SELECT *, CASE WHEN {any_in('lower(place)', R.A_PLACES)} THEN place WHEN {any_in("lower(texts[4])", R.A_PLACES)} THEN trim(texts[4], ' -') ELSE '' END AS loc, regexp_extract(whole, '(?i)([^\\n|]+?)\\s+-\\s+([^\\n]+?(?:{'|'.join(R.A_COUNTRIES)}))', 1) AS fc,
              regexp_extract(whole, '(?i)([^\\n|]+?)\\s+-\\s+([^\\n]+?(?:{'|'.join(R.A_COUNTRIES)}))', 2) AS fl FROM f)
        SELECT page_id, title, CASE WHEN company = '' THEN trim(fc, ' ') ELSE company END AS company, CASE WHEN loc = '' THEN trim(fl, ' ') ELSE loc END AS location, url, {_present('whole', TYPES_A)} AS job_type,
          (SELECT coalesce(string_agg(t, '|' ORDER BY i), '') FROM (SELECT t, min(i) AS i FROM (SELECT unnest(texts) AS t, unnest(range(5)) AS i) WHERE {GOOD_TAG} GROUP BY t)) AS tags,
          {any_in('lower(whole)', R.A_REMOTE)} AS is_remote, regexp_extract(url, '/jobs/p/([^/?#]+)', 1) AS source_job_id FROM x""",
    "parse_items": f"""WITH p AS ({PAGE_B}), f AS (SELECT * FROM p WHERE title <> '' AND NOT {any_in('lower(whole)', R.B_CLOSED)} QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY id) = 1),
        x AS (SELECT *, list_filter({lst(R.B_JOB_TYPES)}, lambda p: contains(lower(whole), lower(p)))[1:3] AS types, page_id % 4 = 0 OR {any_in("lower(concat_ws(' ', raw, t0, c0, l0, j0, location))", R.B_REMOTE)} AS is_remote FROM f)
        SELECT page_id, title, company, location, url, array_to_string(types, ' | ') AS job_type,
          array_to_string(CASE WHEN is_remote AND NOT list_contains(types, 'Remote') THEN list_append(types, 'Remote') ELSE types END, '|') AS tags, is_remote, {numbered('url')} AS source_job_id FROM x""",
    "dedup_across_pages": f"WITH p AS ({PAGE_A}) SELECT arg_min(url, page_id) AS url, min(page_id) AS page_id FROM p WHERE title <> '' GROUP BY rtrim(lower(url), '/')",
}

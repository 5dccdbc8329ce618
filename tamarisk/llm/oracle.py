"""SQL for DuckDB, for the queries that SQL can express on the test tables."""

from __future__ import annotations

from .batches import VISIT_PARAMETERS
from .common import INVISIBLE, SPACES
from .lookalikes import FIELDS, form_sql, plain_sql

BLANKS = rf"[\s{SPACES}{INVISIBLE}]+"


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _got(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {_s(pattern)}, {group})"


COUNTED = "regexp_replace(lower(%s), '[^\\pL\\pN+#]+', '', 'g')"
CANONICAL = f"""c AS (SELECT id, title, company, {COUNTED % form_sql('title')} AS x, {COUNTED % form_sql('company')} AS y FROM jobs),
    k AS (SELECT id, title, company, CASE WHEN x <> '' AND y <> '' THEN least(x, y) || chr(31) || greatest(x, y) END AS k FROM c),
    g AS (SELECT *, min(id) OVER (PARTITION BY coalesce(k, 'row ' || id)) AS head FROM k)"""

LOOKS = f"f AS (SELECT id, {', '.join(f'{form_sql(f)} AS f_{f}, {plain_sql(f)} AS v_{f}' for f in FIELDS)} FROM jobs)"

# Address by address: site and posting number, else site, path and what parameters remain.
PAGES = f"""u0 AS (SELECT id, first_seen_at, content_hash, regexp_replace(regexp_replace(canonical_url, {_s(BLANKS)}, '', 'g'), '#.*$', '') AS u FROM jobs),
    u1 AS (SELECT id, first_seen_at, content_hash, regexp_replace(url_decode(u), '^(?i:[a-z][a-z0-9+.-]*:)?//', '') AS u FROM u0),
    u2 AS (SELECT *, lower({_got('u', '^(?:[^/?@]*@)?([^/?:]*)')}) AS host, regexp_replace({_got('u', '^[^/?]*([^?]*)')}, '/+$', '') AS path, '&' || regexp_replace({_got('u', r'[?](.*)$')}, '/+$', '') AS query FROM u1),
    u3 AS (SELECT *, {_got('host', r'([^.]+[.][^.]+)[.]?$')} AS site, coalesce(nullif({_got('path', r'(?i)/jobs/view/(?:[^/]*-)?(\d+)$')}, ''), nullif({_got('path', r'(?i)/jobs/p/([a-z0-9]+)(?:-[^/]*)?$')}, ''),
        CASE WHEN lower(path) LIKE '%/vacancy' THEN nullif({_got('query', r'(?i)&vid=([^&]+)')}, '') END) AS number,
        list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, {_s(f"(?i)^(?:{VISIT_PARAMETERS})(?:=|$)")}))) AS kept FROM u2),
    keys AS (SELECT id, 'page ' || CASE WHEN site <> '' THEN coalesce(site || ' ' || number, CASE WHEN path <> '' OR len(kept) > 0 THEN host || path || '?' || array_to_string(kept, '&') END) END AS key FROM u3
        UNION ALL SELECT id, 'hash ' || nullif(regexp_replace(regexp_replace(lower(content_hash), {_s(BLANKS)}, '', 'g'), '^sha-?256[:=]|^0x', ''), '') FROM u0)"""

ORACLE = {
    "p2_found": f"""WITH RECURSIVE {PAGES},
        near AS (SELECT id AS a, min(id) OVER (PARTITION BY key) AS b FROM keys WHERE key IS NOT NULL),
        links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        parts AS (SELECT a AS id, min(b) AS part FROM reach GROUP BY 1),
        heads AS (SELECT j.id, first_value(j.id) OVER (PARTITION BY part ORDER BY first_seen_at NULLS LAST, j.id) AS head FROM parts p JOIN jobs j ON j.id = p.id)
        SELECT least(id, head) AS id_a, greatest(id, head) AS id_b FROM heads WHERE id <> head""",
    "p4_found": f"WITH {CANONICAL} SELECT head AS id_a, id AS id_b FROM g WHERE k IS NOT NULL AND id <> head",
    "p4_copies": f"WITH {CANONICAL}, n AS (SELECT head, count(*) AS n FROM g GROUP BY 1) SELECT id, title, company, n AS n_copies FROM g JOIN n USING (head) WHERE id = head",
    "p5_forms": f"SELECT id, {', '.join(f'{form_sql(f)} AS {f}' for f in FIELDS)} FROM jobs",
    "p5_found": f"""WITH {LOOKS} SELECT a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON {' AND '.join(f'a.f_{f} = b.f_{f}' for f in FIELDS)} AND a.id < b.id
        WHERE {' OR '.join(f'a.v_{f} <> b.v_{f}' for f in FIELDS)}""",
}

"""SQL twins of the registered queries, for DuckDB over the given tables."""

from __future__ import annotations

from pagequarry import rules
from pagequarry.plans.fixtures import PROGRAM, TYPE_WORDS

SQL: dict[str, str] = {}


def registry() -> dict[str, str]:
    return dict(SQL)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def unescape(x: str) -> str:
    """The character references the given pages use."""
    for code, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{code}', '{char}')"
    return x


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def no_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


# ── page text of the given pages ──────────────────────────────────────────────

TITLE = f"trim({unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")})"
ARTICLE = unescape(no_tags("regexp_extract(html, '(?s)<article>(.*)</article>', 1)"))
BODY = collapse(ARTICLE)
H1 = f"trim({unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")})"
CLEAN = collapse(
    "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
)

# ── sources and caches ────────────────────────────────────────────────────────

SQL["read_pages"] = "SELECT page_id, url, md5(html) AS html_md5, length(html) AS chars FROM pages"
SQL["paste_pages"] = """
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ' ' || chr(10) || '<p>' || text || '</p>' ELSE text END AS text FROM documents)
SELECT doc_id AS page_id, '' AS url, md5(CASE WHEN starts_with(ltrim(text, ' ' || chr(10)), '<') THEN text ELSE '<html><body>' || text || '</body></html>' END) AS html_md5,
  md5(text) AS content_hash FROM t WHERE length(text) > 0"""

AS_OF = "TIMESTAMP '2024-01-29 12:00:00'"
REQUESTS = """requests AS (SELECT event_id, ts, user_id, event_type, md5('https://example.org/u/' || user_id) AS url_hash, md5('content ' || user_id % 97) AS content_hash,
  md5('name ' || user_id % 41) AS entity_hash, event_type = 'error' AS clear_cache FROM events)"""


def cache(name: str, kind: str, key: str, ttl: str) -> str:
    return f"""{name} AS (SELECT {key}, max(ts) AS written_at, max_by(event_id, (ts, event_id)) AS payload, max(ts) + INTERVAL {ttl} AS expires_at
  FROM requests WHERE event_type = '{kind}' AND ts < {AS_OF} GROUP BY {key})"""


SQL["cache_hits"] = f"""WITH {REQUESTS}, {cache("c", "view", "url_hash", "24 HOURS")}
SELECT r.event_id, r.url_hash, c.payload, c.expires_at FROM requests r JOIN c USING (url_hash) WHERE c.expires_at > {AS_OF}"""
SQL["cache_misses"] = f"""WITH {REQUESTS}, {cache("c", "view", "url_hash", "24 HOURS")}
SELECT event_id, url_hash FROM requests WHERE url_hash NOT IN (SELECT url_hash FROM c WHERE expires_at > {AS_OF})"""
SQL["cache_lookup_batch"] = """
WITH c AS (SELECT md5(lower(p_name)) AS k, min(p_brand) AS data FROM part WHERE p_type <> 'SMALL' GROUP BY 1)
SELECT p_partkey, lower(' ' || p_name) AS lower_name, CASE WHEN data < 'Brand#2' THEN data END AS data FROM part LEFT JOIN c ON k = md5(lower(p_name))"""
SQL["cache_upsert"] = f"""WITH {REQUESTS}, {cache("c", "view", "url_hash", "24 HOURS")},
n AS (SELECT url_hash, ts AS written_at, event_id AS payload, ts + INTERVAL 1 HOUR AS expires_at, 1 AS new FROM requests WHERE event_type = 'click' AND user_id % 9 <> 0),
a AS (SELECT url_hash, written_at, payload, expires_at, 0 AS new FROM c UNION ALL SELECT * FROM n)
SELECT url_hash, written_at, payload, expires_at FROM a QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY written_at DESC, new DESC) = 1"""

COMMON = f"name IN {in_list(rules.COMMON_WORDS)} OR regexp_matches(name, '^\\d+$|^[A-Z]$|^[A-Z]\\s*[A-Z]$')"
PHRASE = r"\b[A-Z][a-zA-Z&]+(?:\s+[A-Z][a-zA-Z&]+)*\b"
PRODUCT = r"(?i)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:" + "|".join(rules.PRODUCT_SUFFIXES) + r")\b"


def mentions(source: str, key: str = "page_id", cap: int | None = 40) -> str:
    """CTEs ending in ``m(key, pos, name)``; ``source`` yields ``(key, t)``."""
    limit = f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY min(i)) <= {cap}" if cap else ""
    return f"""src AS ({source}),
lists AS (SELECT {key}, regexp_extract_all(t, '{PHRASE}') AS c1, regexp_extract_all(t, '{PRODUCT}') AS c2 FROM src),
hits AS (
  SELECT {key}, i, trim(c1[i]) AS name FROM lists, unnest(range(1, len(c1) + 1)) AS u(i) WHERE length(trim(c1[i])) BETWEEN 3 AND 49
  UNION ALL SELECT {key}, 10000000 + i, trim(c2[i]) FROM lists, unnest(range(1, len(c2) + 1)) AS u(i)),
m AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY min(i)) - 1 AS pos, name FROM hits WHERE NOT ({COMMON}) GROUP BY {key}, name {limit})"""


M = mentions(f"SELECT page_id, {CLEAN} AS t FROM pages")
SCORED = """e AS (SELECT page_id, pos, name,
  CASE length(name) % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' WHEN 2 THEN 'Place' ELSE 'Thing' END AS type,
  CASE WHEN length(name) % 3 = 0 THEN 'https://en.wikipedia.org/wiki/' || replace(name, ' ', '_') END AS wikipedia_url,
  CASE WHEN length(name) % 5 = 0 THEN 'https://www.wikidata.org/wiki/Q' || pos END AS wikidata_url,
  CASE WHEN length(name) % 2 = 0 THEN 'https://www.google.com/search?kgmid=/m/' || pos ELSE 'https://www.google.com/search?q=' || replace(name, ' ', '%20') END AS google_kg_url,
  CASE WHEN length(name) % 7 = 0 THEN 'http://www.productontology.org/id/' || name END AS product_ontology_url,
  (length(name) * 13 + pos * 7) % 101 AS confidence FROM m)"""

SQL["cache_upsert_entities"] = f"""WITH {M}, {SCORED},
w AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) + to_milliseconds(pos) AS written_at FROM e)
SELECT md5(lower(name)) AS entity_hash, lower(name) AS entity_name, CAST(confidence AS INT) AS confidence, written_at + INTERVAL 7 DAYS AS expires_at
FROM w QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY written_at DESC) = 1"""

REPLAY = """
WITH RECURSIVE r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT event_id, user_id, n, false AS hit, event_id AS entry_id, ts AS opened FROM r WHERE n = 1
  UNION ALL
  SELECT r.event_id, r.user_id, r.n, r.ts < w.opened + INTERVAL 7 DAYS, CASE WHEN r.ts < w.opened + INTERVAL 7 DAYS THEN w.entry_id ELSE r.event_id END,
    CASE WHEN r.ts < w.opened + INTERVAL 7 DAYS THEN w.opened ELSE r.ts END
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)"""
SQL["replay_ttl"] = REPLAY + " SELECT event_id, hit, entry_id FROM walk"
SQL["cache_hit_counts"] = REPLAY + " SELECT user_id, entry_id, sum(hit::INT) AS hit_count FROM walk GROUP BY 1, 2"

CACHES = {
    "entity": ("signup", "entity_hash", "7 DAYS"),
    "analysis": ("view", "url_hash", "1 HOURS"),
    "url": ("click", "url_hash", "6 HOURS"),
    "extraction": ("purchase", "content_hash", "24 HOURS"),
    "fanout": ("error", "content_hash", "1 HOURS"),
}
CACHE_CTES = ", ".join(cache("c_" + n, *spec) for n, spec in CACHES.items())
SQL["purge_expired"] = f"WITH {REQUESTS}, {CACHE_CTES} " + " UNION ALL ".join(
    f"SELECT '{n}_cache' AS cache_name, count(*) AS deleted FROM c_{n} WHERE {'false AND ' if n == 'fanout' else ''}expires_at < {AS_OF}" for n in CACHES
)
SQL["purge_kept"] = f"WITH {REQUESTS}, {CACHE_CTES} SELECT url_hash, payload FROM c_url WHERE NOT expires_at < {AS_OF}"
SQL["store_purge"] = f"WITH {REQUESTS}, {CACHE_CTES} " + " UNION ALL ".join(
    f"SELECT '{n}_cache' AS cache_name, {CACHES[n][1]} AS key, payload, (SELECT count(*) FROM c_{n} WHERE expires_at < {AS_OF}) AS deleted FROM c_{n} WHERE NOT expires_at < {AS_OF}"
    for n in CACHES if n != "fanout"
)
SQL["store_upsert"] = f"""WITH {REQUESTS}, {cache("c", "view", "url_hash", "1 HOUR")},
n AS (SELECT url_hash, ts AS written_at, event_id AS payload, ts + INTERVAL 1 HOUR AS expires_at, 1 AS new FROM requests WHERE event_type = 'click' AND user_id % 9 <> 0),
a AS (SELECT url_hash, written_at, payload, expires_at, 0 AS new FROM c UNION ALL SELECT * FROM n)
SELECT url_hash, written_at, payload, expires_at FROM a QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY written_at DESC, new DESC) = 1"""
SQL["store_lookup"] = f"""WITH {REQUESTS}, {cache("c", "signup", "entity_hash", "7 DAYS")}
SELECT r.event_id, r.entity_hash, c.payload, c.expires_at FROM requests r LEFT JOIN c ON c.entity_hash = r.entity_hash AND c.expires_at > {AS_OF}"""
SQL["cache_tiers"] = (
    f"WITH {REQUESTS}, {CACHE_CTES} SELECT event_id, CASE "
    + " ".join(
        f"WHEN {'true' if n == 'entity' else 'NOT clear_cache'} AND {CACHES[n][1]} IN (SELECT {CACHES[n][1]} FROM c_{n} WHERE expires_at > {AS_OF}) THEN '{n}'"
        for n in ("analysis", "url", "extraction", "entity", "fanout")
    )
    + " ELSE 'none' END AS tier FROM requests"
)
SQL["fanout_cacheable"] = "SELECT event_id, props AS analysis FROM events WHERE user_id % 7 NOT IN (0, 1) AND event_type <> 'error' AND props <> ''"

# ── usage ─────────────────────────────────────────────────────────────────────

RUNS = """runs AS (SELECT user_id, 'https://example.org/u/' || user_id AS url,
  CASE event_type WHEN 'view' THEN 'full' WHEN 'click' THEN 'fanout_only' WHEN 'purchase' THEN 'paste' WHEN 'signup' THEN 'full' END AS analysis_type,
  CASE WHEN event_id % 3 = 0 THEN 'byok' ELSE 'free_tier' END AS key_source,
  CASE WHEN event_id % 5 <> 0 THEN (event_id % 20)::INT ELSE 0 END AS entities_found,
  CASE WHEN event_id % 7 <> 0 THEN trunc(value * 10)::INT ELSE 0 END AS processing_time_ms, ts AS created_at, date_trunc('month', ts)::DATE AS month FROM events),
log AS (SELECT * FROM runs WHERE analysis_type IS NOT NULL)"""
PROFILES = """profiles AS (SELECT user_id, 'u' || user_id || CASE WHEN user_id % 10 = 0 THEN '@Partner.example' ELSE '@mail.example' END AS email,
  (user_id % 8)::INT AS free_analyses_used, TIMESTAMP '2024-01-01' + to_days((user_id % 40)::INT) AS free_analyses_reset_at
  FROM (SELECT user_id, min_by(event_type, (ts, event_id)) AS first FROM events GROUP BY 1) WHERE first <> 'error')"""
SQL["append_log"] = f"WITH {RUNS} SELECT * FROM log"
SQL["check_usage"] = f"""WITH {PROFILES}, u AS (SELECT DISTINCT user_id FROM events), j AS (SELECT u.user_id, p.email IS NULL AS missing,
  coalesce(split_part(lower(email), '@', 2) = 'partner.example', false) AS un, coalesce({AS_OF} > free_analyses_reset_at, false) AS due, greatest(0, 5 - free_analyses_used) AS left_
  FROM u LEFT JOIN profiles p USING (user_id))
SELECT user_id, NOT missing AND (un OR due OR left_ > 0) AS allowed, CASE WHEN missing THEN 0 WHEN un THEN NULL WHEN due THEN 5 ELSE left_ END AS remaining,
  CASE WHEN missing THEN 'Profile not found' WHEN NOT un AND NOT due AND left_ <= 0 THEN {lit(rules.REASON_LIMIT)} END AS reason, NOT missing AND un AS unlimited FROM j"""
SQL["quota_replay"] = """SELECT event_id, user_id, date_trunc('month', ts)::DATE AS month,
  row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) <= 5 AS allowed FROM events"""
SQL["unlimited_users"] = f"WITH {PROFILES} SELECT user_id, split_part(lower(email), '@', 2) AS domain, split_part(lower(email), '@', 2) = 'partner.example' AS unlimited FROM profiles"
SQL["monthly_reset"] = f"""WITH {PROFILES} SELECT user_id, email, CASE WHEN {AS_OF} > free_analyses_reset_at THEN 0 ELSE free_analyses_used END AS free_analyses_used,
  CASE WHEN {AS_OF} > free_analyses_reset_at THEN TIMESTAMP '2024-02-01' ELSE free_analyses_reset_at END AS free_analyses_reset_at FROM profiles"""
SQL["increment_usage"] = f"""WITH {PROFILES}, n AS (SELECT user_id, count(*) AS c FROM events GROUP BY 1)
SELECT user_id, (free_analyses_used + CASE WHEN email ILIKE '%@partner.example' THEN 0 ELSE c END)::INT AS free_analyses_used FROM profiles JOIN n USING (user_id)"""
SQL["insert_profiles"] = f"""WITH {PROFILES} SELECT * FROM profiles UNION ALL
SELECT DISTINCT user_id, 'new' || user_id || '@mail.example', 0::INT, TIMESTAMP '2024-02-01' FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM profiles)"""
SQL["usage_report"] = f"""WITH {RUNS} SELECT month, analysis_type, key_source, count(*) AS runs, sum(entities_found)::BIGINT AS entities, sum(processing_time_ms)::BIGINT AS total_ms
FROM log GROUP BY ROLLUP (month, analysis_type, key_source)"""
SQL["user_report"] = f"WITH {RUNS} SELECT user_id, month, count(*) AS runs, sum(entities_found)::BIGINT AS entities, sum(processing_time_ms)::BIGINT AS total_ms FROM log GROUP BY 1, 2"

# ── keys and page text ────────────────────────────────────────────────────────

SQL["url_key"] = "SELECT page_id, md5(lower(trim(url))) AS url_hash FROM pages"
SQL["entity_key"] = "SELECT p_partkey, md5(lower(trim(p_name))) AS entity_hash FROM part"
SQL["clean_text"] = f"SELECT page_id, {CLEAN} AS clean_text FROM pages"
SQL["content_hash"] = f"SELECT page_id, md5({CLEAN}) AS content_hash FROM pages"
SQL["content_groups"] = f"""WITH p AS (SELECT doc_id AS page_id, CASE WHEN starts_with(trim(text), '<') THEN text ELSE '<html><body>' || text || '</body></html>' END AS html FROM documents WHERE length(text) > 0),
h AS (SELECT page_id, md5({CLEAN}) AS content_hash FROM p), g AS (SELECT content_hash, min(page_id) AS representative, count(*) AS copies FROM h GROUP BY 1)
SELECT page_id, content_hash, representative, copies FROM h JOIN g USING (content_hash)"""
SQL["page_title"] = f"SELECT page_id, {TITLE} AS title FROM pages"
SQL["page_description"] = "SELECT page_id, 'About page ' || page_id AS description FROM pages"
ANNOTATED_HEADINGS = """(SELECT page_id, 0 AS pos, 3 AS level, 'What is item ' || page_id AS text FROM pages UNION ALL SELECT page_id, 1, 3, 'Q: How big is it?' FROM pages
UNION ALL SELECT page_id, 2, 2, 'How to file page ' || page_id FROM pages UNION ALL SELECT page_id, 3, 4, 'Step 1: Open' FROM pages
UNION ALL SELECT page_id, 4, 1, %s FROM pages)""" % H1
SQL["page_headings"] = f"SELECT * FROM {ANNOTATED_HEADINGS} WHERE text <> ''"
SQL["strip_boilerplate"] = f"""SELECT page_id, 5 AS removed_subtrees, md5({unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")} || {ARTICLE}) AS kept_md5 FROM pages"""
SQL["main_content"] = f"SELECT page_id, trim({ARTICLE}, ' ' || chr(10) || chr(9) || chr(13)) AS content FROM pages"
SQL["body_text"] = f"SELECT page_id, {BODY} AS body FROM pages"
SQL["full_text"] = f"""SELECT page_id, concat_ws('. ', nullif({TITLE}, ''), 'About page ' || page_id, 'What is item ' || page_id, 'Q: How big is it?', 'How to file page ' || page_id,
  'Step 1: Open', nullif({H1}, ''), nullif({BODY}, '')) AS full_text FROM pages"""
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
SQL["site_ids"] = f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 10 = 3 THEN 'no url' WHEN page_id % 10 = 4 THEN '' ELSE url END AS url FROM pages), o AS (SELECT *, {ORIGIN} AS origin FROM u)
SELECT page_id, origin, CASE WHEN origin = '' THEN '' ELSE origin || '/#organization' END AS organization_id, CASE WHEN url = '' THEN '' ELSE url || '#webpage' END AS webpage_id,
  CASE WHEN origin = '' THEN '' ELSE origin || '/#website' END AS website_id FROM o"""
SQL["name_from_title"] = r"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '- ' ELSE '' END || p_name || CASE p_size % 4 WHEN 0 THEN ' | ' WHEN 1 THEN '-' WHEN 2 THEN ' ' ELSE ' - a | ' END || p_brand || CASE WHEN p_size = 7 THEN '' ELSE ' x' END AS t FROM part)
SELECT p_partkey, coalesce(nullif(trim(regexp_replace(t, '\s*[-|]\s*.+$', '')), ''), t) AS name FROM t"""
SQL["name_in"] = "SELECT p_partkey, p_size % 3 <> 2 AS found FROM part"
SQL["count_occurrences"] = """WITH d AS (SELECT doc_id, lower(text) AS t, lang FROM documents)
SELECT doc_id, ((length(t) - length(replace(t, 'the', ''))) / 3)::INT AS n_the, ((length(t) - length(replace(t, 'ee', ''))) / 2)::INT AS n_ee, 0 AS n_empty,
  ((length(t) - length(replace(t, lang, ''))) / length(lang))::INT AS n_lang FROM d"""

# ── mentions ──────────────────────────────────────────────────────────────────

ONE_LIST = "FROM {t}, unnest(range(1, len(l) + 1)) AS u(i)"
SQL["capitalised_phrases"] = f"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{PHRASE}'), lambda x: trim(x)), lambda x: length(x) BETWEEN 3 AND 49) AS l FROM documents)
SELECT doc_id, i - 1 AS pos, l[i] AS phrase {ONE_LIST.format(t="l")}"""
PART_TEXT = "'The ' || p_name || ' ' || p_type || CASE p_size % 3 WHEN 0 THEN ' pro edition' WHEN 1 THEN ' Air, mini max' ELSE ' plus1 Lite' END"
SQL["product_names"] = f"""WITH l AS (SELECT p_partkey, regexp_extract_all({PART_TEXT}, '{PRODUCT}') AS l FROM part) SELECT p_partkey, i - 1 AS pos, trim(l[i]) AS name {ONE_LIST.format(t="l")}"""
SQL["product_names_documents"] = f"""WITH l AS (SELECT doc_id, regexp_extract_all(replace(text, 'the', 'studio'), '{PRODUCT}') AS l FROM documents) SELECT doc_id, i - 1 AS pos, trim(l[i]) AS name {ONE_LIST.format(t="l")}"""
SQL["drop_common"] = f"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS w FROM documents),
n AS (SELECT doc_id, CASE WHEN length(w) = 1 THEN upper(w) WHEN length(w) = 2 THEN upper(w[1]) || ' ' || upper(w[2]) ELSE upper(w[1]) || lower(w[2:]) END AS name FROM w)
SELECT name, count(*) AS docs FROM n WHERE NOT ({COMMON}) GROUP BY name"""
SQL["mentions"] = f"WITH {M} SELECT page_id, pos, name FROM m"
EVERY = mentions(f"SELECT page_id, {CLEAN} AS t FROM pages", cap=None)
SQL["top_mentions"] = f"WITH {EVERY} SELECT name, count(*) AS pages, min(page_id) AS first_page FROM m GROUP BY name ORDER BY pages DESC, name LIMIT 100"
DM = mentions("SELECT doc_id, text AS t FROM documents", "doc_id")
SQL["extract_entities"] = f"""WITH {DM}, n AS (SELECT doc_id, string_agg(name, '|' ORDER BY pos) AS names FROM m GROUP BY 1)
SELECT d.doc_id AS page_id, CASE d.doc_id % 5 WHEN 1 THEN 'Topic ' || d.doc_id WHEN 4 THEN 'T' ELSE '' END AS main_topic, CASE WHEN d.doc_id % 5 IN (1, 2, 4) THEN 0.85 ELSE 0 END::DOUBLE AS confidence,
  CASE d.doc_id % 5 WHEN 1 THEN 'A' || d.doc_id || '|B' WHEN 2 THEN 'C' || d.doc_id WHEN 4 THEN '' ELSE coalesce(names, '') END AS names FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""
SQL["extraction_requests"] = """SELECT md5(text) AS content_hash, md5('Name the entities.' || chr(10) || substring(any_value(text), 1, 8000)) AS prompt_md5, 'gpt-4o' AS model, 1000 AS max_tokens, 0.3::DOUBLE AS temperature
FROM documents GROUP BY 1"""
PARSED = """x AS (SELECT doc_id, lang, md5('doc ' || doc_id) AS content_hash, CASE doc_id % 5 WHEN 1 THEN 'Topic ' || doc_id WHEN 2 THEN '' WHEN 4 THEN 'T' END AS main_topic,
  CASE WHEN doc_id % 5 IN (1, 2, 4) THEN 0.85::DOUBLE END AS confidence, CASE doc_id % 5 WHEN 1 THEN 'A' || doc_id || '|B' WHEN 2 THEN 'C' || doc_id WHEN 4 THEN '' END AS names,
  CASE doc_id % 5 WHEN 2 THEN n_chars + doc_id WHEN 4 THEN n_chars + 11 END AS tokens,
  CASE doc_id % 5 WHEN 2 THEN n_chars * 0.000005::DOUBLE + doc_id * 0.000015::DOUBLE WHEN 4 THEN n_chars * 0.000005::DOUBLE + 10 * 0.000015::DOUBLE END AS cost_usd FROM documents)"""
SQL["parse_extraction"] = f"WITH {PARSED} SELECT content_hash, main_topic, confidence, names, tokens, cost_usd FROM x"
SQL["cost_rollup"] = f"WITH {PARSED} SELECT lang, count(*) AS calls, sum(tokens)::BIGINT AS tokens, sum(cost_usd) AS cost_usd FROM x GROUP BY lang"
ALIAS = "CASE p_partkey % 6 WHEN 0 THEN 'seo' WHEN 1 THEN 'college' WHEN 2 THEN 'social media marketing' WHEN 3 THEN 'pay per click' WHEN 4 THEN 'content marketing' ELSE p_name END"
SQL["canonical_entity"] = f"""SELECT p_partkey, CASE {ALIAS} WHEN 'college' THEN 'higher education' WHEN 'social media marketing' THEN 'smm' WHEN 'pay per click' THEN 'ppc' ELSE {ALIAS} END AS canonical FROM part"""
SQL["entity_variants"] = f"""WITH v AS (SELECT p_partkey, CASE {ALIAS} WHEN 'seo' THEN ['search engine optimization', 'seo'] WHEN 'college' THEN ['higher education', 'university', 'college']
  WHEN 'social media marketing' THEN ['social media marketing', 'smm'] WHEN 'pay per click' THEN ['pay per click', 'ppc'] ELSE [{ALIAS}] END AS l FROM part)
SELECT p_partkey, i - 1 AS variant_pos, l[i] AS variant {ONE_LIST.format(t="v")}"""

# ── linking ───────────────────────────────────────────────────────────────────

WORDS = "string_split_regex({x}, '\\s+')"
SKIPPED = f"""(len(string_split_regex(name, '\\s+')) > 5 OR lower(name) IN {in_list(rules.TEMPLATE_ENTITIES)}
  OR (len(string_split_regex(name, '\\s+')) = 1 AND lower(name) IN {in_list(rules.GENERIC_SINGLE_WORDS)})
  OR regexp_matches(lower(name), '{"|".join(rules.UNLIKELY_ENTITIES + rules.NON_ENTITIES)}'))"""
SQL["skip_filter"] = f"""WITH n AS (SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'Local SEO' WHEN 1 THEN p_name || ' Pricing' WHEN 2 THEN 'Newsletter' WHEN 3 THEN 'Areas' WHEN 4 THEN 'Public'
  WHEN 5 THEN 'a b c d ' || p_name WHEN 6 THEN 'Meet & Greet' WHEN 7 THEN 'Wonder' WHEN 8 THEN 'Wonder ' || p_name WHEN 9 THEN p_name || ' report' WHEN 10 THEN 'Schema Markups' ELSE p_name END AS name FROM part)
SELECT p_partkey, name, {SKIPPED} AS skipped FROM n"""
SQL["base_score"] = f"""WITH {M}, b AS (SELECT page_id, pos, (pos // 5)::INT AS batch FROM m WHERE length(name) % 6 <> 0 AND NOT {SKIPPED})
SELECT page_id, pos, batch, (count(*) OVER w - row_number() OVER (w ORDER BY pos) + 1) / count(*) OVER w * 70 AS base FROM b WINDOW w AS (PARTITION BY page_id, batch)"""
SQL["base_score_page"] = f"""WITH {M}, b AS (SELECT page_id, pos FROM m WHERE pos < 20 AND NOT {SKIPPED})
SELECT page_id, pos, (count(*) OVER w - row_number() OVER (w ORDER BY pos) + 1) / count(*) OVER w * 70 AS base FROM b WINDOW w AS (PARTITION BY page_id)"""
KNOWN = "CASE p_partkey % 5 WHEN 0 THEN ' Instagram' WHEN 1 THEN 'X (formerly Twitter)' WHEN 2 THEN 'MOZ' WHEN 3 THEN 'Machine Learning' ELSE p_name END AS name"
SQL["known_entities"] = f"""SELECT p_partkey, {KNOWN}, 'https://en.wikipedia.org/wiki/' || CASE p_partkey % 5 WHEN 0 THEN 'Instagram' WHEN 1 THEN 'Twitter' WHEN 2 THEN 'Moz_(marketing_software)' WHEN 3 THEN 'Machine_learning' END AS known_wikipedia,
  'https://www.wikidata.org/wiki/' || CASE p_partkey % 5 WHEN 0 THEN 'Q209330' WHEN 1 THEN 'Q918' WHEN 2 THEN 'Q6913421' WHEN 3 THEN 'Q2539' END AS known_wikidata,
  CASE p_partkey % 5 WHEN 3 THEN 'Thing' WHEN 4 THEN NULL ELSE 'Organization' END AS known_type FROM part"""
SQL["wiki_search_terms"] = """WITH n AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size > 25 THEN 'SEO' ELSE 'SEOx' END WHEN 1 THEN 'O''Hare' WHEN 2 THEN
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' Airport' WHEN 3 THEN 'Academic Programs' ELSE p_name END AS name,
    p_partkey % 6 = 3 AND p_size % 2 = 0 AS academic FROM part),
l AS (SELECT name, academic, CASE WHEN academic THEN ['Academic program education'] WHEN name = 'SEO' THEN ['Search Engine Optimization', 'SEO Search Engine Optimization', 'Search engine optimization', 'SEO']
  WHEN name = 'O''Hare' THEN ['O''Hare International Airport'] WHEN name LIKE '% Airport' THEN [replace(name, ' Airport', '') || ' International Airport'] ELSE [name] END AS l FROM n)
SELECT name, academic, i - 1 AS term_pos, l[i] AS term FROM l, unnest(range(1, len(l) + 1)) AS u(i)"""

# Knowledge base from documents, as in the fixtures.
KB = f"""ph AS (SELECT phrase, min(doc_id) AS doc_id FROM (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '{PHRASE}'), lambda x: trim(x)), lambda x: length(x) BETWEEN 3 AND 49)) AS phrase FROM documents) GROUP BY 1),
kb AS (SELECT phrase, ph.doc_id, ('0x' || substring(md5(phrase), 1, 12))::BIGINT AS num, lpad(length(phrase)::VARCHAR, 3, '0') || phrase AS rank, lower(text) AS extract,
  list_filter(string_split_regex(lower(phrase), '\\s+'), lambda w: w <> '') AS tok, 'https://en.wikipedia.org/wiki/' || replace(phrase, ' ', '_') AS url FROM ph JOIN documents d ON d.doc_id = ph.doc_id),
keyed AS (SELECT *, unnest(list_transform(range(1, len(tok) + 1), lambda n: array_to_string(tok[1:n], ' '))) AS key FROM kb),
n AS (SELECT DISTINCT name, lower(name) AS e, array_to_string(list_filter(string_split_regex(lower(name), '\\s+'), lambda w: w <> ''), ' ') AS key FROM m)"""


def index(name: str, condition: str = "true") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank) AS hit FROM keyed WHERE {condition} QUALIFY hit <= 5)"


SHARE = "coalesce(len(list_filter(list_filter({w}, lambda x: length(x) > 2), lambda x: contains({t}, x))) / nullif({d}, 0), 0)"


def label(entity: str, lab: str, desc: str) -> str:
    ew, lw = (f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')" for x in (entity, lab))
    bonus = f"CASE WHEN {desc} <> '' THEN {SHARE.format(w=ew, t=f'lower({desc})', d=f'greatest(len({ew}), 1)')} * 20 ELSE 0 END"
    return f"""(CASE WHEN {entity} = {lab} THEN 100 WHEN contains({lab}, {entity}) THEN 80 WHEN contains({entity}, {lab}) THEN 70
      ELSE len(list_filter({ew}, lambda w: list_contains({lw}, w))) / greatest(len({ew}), len({lw})) * 60 END + {bonus})"""


LONG_WORDS = "list_filter(string_split_regex(e, '\\s+'), lambda w: length(w) > 2)"
WIKI = f"""{KB}, {index("pidx")},
cand AS (SELECT n.name, n.e, p.phrase AS title, lower(p.phrase) AS t, p.url, p.num, p.extract, p.hit FROM n JOIN pidx p USING (key)),
sc AS (SELECT *, greatest(0, CASE WHEN e = t THEN 100 WHEN contains(t, e) THEN CASE WHEN len(string_split_regex(t, '\\s+')) - len(string_split_regex(e, '\\s+')) <= 2 THEN 85 ELSE 60 END WHEN contains(e, t) THEN 75 ELSE 0 END
  + CASE WHEN regexp_matches(title, '^[A-Z][a-z]') THEN 5 ELSE 0 END - CASE WHEN length(title) > length(e) * 2.5 THEN 30 ELSE 0 END) AS score FROM cand),
ver AS (SELECT * REPLACE (score + CASE WHEN score <= 70 THEN 0 WHEN contains(extract, e) OR {SHARE.format(w=LONG_WORDS, t="extract", d=f"len({LONG_WORDS})")} >= 0.5 THEN 10 ELSE -30 END AS score) FROM sc),
best AS (SELECT * REPLACE (score - CASE WHEN contains(t, 'disambiguation') THEN 50 ELSE 0 END - CASE WHEN contains(t, 'redirect') OR contains(t, 'stub') THEN 30 ELSE 0 END AS score) FROM ver
  WHERE score - CASE WHEN contains(t, 'disambiguation') THEN 50 ELSE 0 END - CASE WHEN contains(t, 'redirect') OR contains(t, 'stub') THEN 30 ELSE 0 END >= 65
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, hit) = 1),
items AS (SELECT num, CASE WHEN length(phrase) % 11 = 0 THEN '' ELSE phrase END AS label, CASE WHEN length(phrase) % 2 = 0 THEN 'the ' || lower(phrase) || ' of page ' || doc_id ELSE '' END AS description,
  CASE length(phrase) % 6 WHEN 0 THEN 'Q5' WHEN 1 THEN 'Q43229' WHEN 2 THEN 'Q571' WHEN 3 THEN 'Q12737077' END AS p31 FROM kb),
pg AS (SELECT b.name, b.url, b.extract, CASE WHEN label <> '' AND {label("lower(replace(b.title, ' ', '_'))", "lower(label)", "''")} >= 50 THEN 'https://www.wikidata.org/wiki/Q' || b.num END AS page_item FROM best b JOIN items USING (num))"""
SQL["search_index"] = f"""WITH {KB.split("n AS (SELECT DISTINCT")[0].rstrip().rstrip(",")}, {index("pidx")} SELECT key, hit, phrase AS title FROM pidx"""
SQL["wiki_candidates"] = f"WITH {M}, {WIKI} SELECT name, hit, title, url FROM cand"
SQL["wiki_score"] = f"WITH {M}, {WIKI} SELECT name, title, score::DOUBLE AS score FROM sc"
SQL["wiki_verify"] = f"WITH {M}, {WIKI} SELECT name, title, score::DOUBLE AS score FROM ver"
SQL["wiki_best"] = f"WITH {M}, {WIKI} SELECT name, title, url, score::DOUBLE AS score FROM best"
SQL["wikidata_from_page"] = f"WITH {M}, {WIKI} SELECT name, page_item FROM pg"
DIRECT = f"""{index("iidx")}, isc AS (SELECT n.name, i.num, i.hit, {label("n.e", "lower(it.label)", "it.description")} AS score FROM n JOIN iidx i USING (key) JOIN items it ON it.num = i.num),
direct AS (SELECT name, 'https://www.wikidata.org/wiki/Q' || num AS direct_item, num AS direct_num, score FROM isc WHERE score >= 75 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, hit) = 1)"""
SQL["wikidata_direct"] = f"WITH {M}, {WIKI}, {DIRECT} SELECT name, direct_item, score::DOUBLE AS score FROM direct"
GRAPH = f"""{index("gidx", "length(phrase) % 3 <> 1")}, gsc AS (SELECT *, {label("e", "lower(phrase)", "kg_description")} AS kg_score FROM (
  SELECT n.name, n.e, g.phrase, g.num, g.hit, CASE WHEN length(g.phrase) % 2 = 0 THEN 'a singer of ' || lower(g.phrase) ELSE '' END AS kg_description FROM n JOIN gidx g USING (key))),
graph AS (SELECT name, 'kg:/m/' || num AS mid, kg_description, kg_score FROM gsc WHERE kg_score > 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY kg_score DESC, hit) = 1)"""
SQL["google_kg"] = f"WITH {M}, {KB}, {GRAPH} SELECT name, mid, kg_description, kg_score::DOUBLE AS kg_score FROM graph"
PERSON = "regexp_matches(trim({x}), '^[A-Z][a-z]+(?:\\s+[A-Z]\\.?)?\\s+[A-Z][a-z]+$')"
SLUGS = """[array_to_string(list_transform(string_split_regex(e, '\\s+'), lambda w: upper(w[1]) || w[2:]), '_'), regexp_replace(e, '\\s+', '-', 'g'), regexp_replace(e, '\\s+', '_', 'g'), upper(e[1]) || e[2:], upper(name)]"""
PRODUCT_PAGES = f"""urls AS (SELECT DISTINCT 'http://www.productontology.org' || CASE WHEN length(phrase) % 2 = 0 THEN '/id/' ELSE '/doc/' END || CASE WHEN length(phrase) % 3 = 0 THEN replace(lower(phrase), ' ', '-') ELSE upper(phrase) END AS url
  FROM kb WHERE length(phrase) % 5 <> 0),
sl AS (SELECT name, {SLUGS} AS s FROM n WHERE NOT {PERSON.format(x="name")}),
probes AS (SELECT name, i, 'http://www.productontology.org' || CASE WHEN i <= 5 THEN '/id/' ELSE '/doc/' END || s[(i - 1) % 5 + 1] AS url FROM sl, unnest(range(1, 11)) AS u(i)),
product AS (SELECT name, min_by(url, i) AS product_ontology_url FROM probes SEMI JOIN urls USING (url) GROUP BY name)"""
SQL["product_ontology"] = f"WITH {M}, {KB}, {PRODUCT_PAGES} SELECT * FROM product"


def fits(words: str, text: str, single: str) -> str:
    pairs = f"len(list_filter(range(1, len({words})), lambda i: contains({text}, {words}[i] || ' ' || {words}[i + 1]))) > 0"
    return f"CASE WHEN len({words}) >= 2 THEN {pairs} WHEN len({words}) = 1 THEN {single} ELSE true END"


TOPIC_WORDS = f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(topic), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 4 AND w NOT IN {in_list(rules.TOPIC_STOP_WORDS)})"
PROFESSION = "regexp_matches(txt, '" + "|".join(rules.PROFESSIONS) + "')"
SQL["person_context"] = f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS name,
  CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'the services' WHEN 2 THEN 'The ' || p_type || '!' WHEN 3 THEN 'Ring & ' || lower(p_type) || ' widget-world' ELSE p_name || ' ' || p_name || ' solutions' END AS topic,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a poet of ' || lower(p_type) || ' things' WHEN 2 THEN 'about ' || p_name || ' ' || p_name ELSE lower(p_type) || ' widget world' END AS txt FROM part), w AS (SELECT *, {TOPIC_WORDS} AS w FROM p)
SELECT p_partkey, NOT {PERSON.format(x="name")} OR topic = '' OR (txt <> '' AND {fits("w", "txt", "contains(txt, w[1])")}) AS by_extract,
  NOT {PERSON.format(x="name")} OR topic = '' OR txt = '' OR {fits("w", "txt", f"contains(txt, w[1]) AND NOT {PROFESSION}")} AS by_description FROM w"""
SQL["wiki_reject"] = """SELECT p_partkey, CASE p_partkey % 7
  WHEN 0 THEN p_size % 6 IN (0, 3, 5) WHEN 1 THEN p_size % 6 IN (1, 3, 5) WHEN 2 THEN p_size % 6 IN (0, 3, 5) WHEN 3 THEN p_size % 6 IN (2, 3, 5) ELSE p_size % 6 IN (3, 5) END AS rejected FROM part"""
SQL["wiki_score_forms"] = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 100 WHEN 1 THEN 85 WHEN 2 THEN CASE WHEN p_brand = 'Brand' THEN 0 ELSE 5 END WHEN 3 THEN 80 WHEN 4 THEN 75
  WHEN 5 THEN CASE WHEN length(p_name) * 1.5 < 14 THEN 15 ELSE 45 END WHEN 6 THEN 50 ELSE CASE WHEN length(p_name) * 1.5 < 36 THEN 35 ELSE 65 END END::DOUBLE AS score FROM part"""
SQL["label_score"] = f"""WITH p AS (SELECT p_partkey, p_name AS e, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'a ' || p_name WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 3 THEN '' ELSE split_part(p_name, ' ', 2) || ' xx' END AS l,
  CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'some ' || split_part(p_name, ' ', 2) ELSE upper(p_name) END AS d FROM part) SELECT p_partkey, {label("e", "l", "d")}::DOUBLE AS score FROM p"""
SQL["academic_mismatch"] = """SELECT p_partkey, p_size % 4 IN (0, 1) OR (p_partkey % 4 = 0 AND (length(p_name) + 1) * 6 > 100) AS mismatch FROM part"""
SQL["entity_type"] = """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'Product' WHEN p_size % 4 = 0 THEN 'CreativeWork' WHEN p_partkey % 3 = 0 THEN 'Person' WHEN p_partkey % 3 = 1 THEN 'Organization' ELSE 'Thing' END AS type FROM part"""


def confidence(base: str) -> str:
    kg = "contains(google_kg_url, 'kgmid=')"
    n = f"((wikipedia_url IS NOT NULL)::INT + (wikidata_url IS NOT NULL)::INT + {kg}::INT + (product_ontology_url IS NOT NULL)::INT)"
    bonus = f"(wikipedia_url IS NOT NULL)::INT * 15 + (wikidata_url IS NOT NULL)::INT * 10 + {kg}::INT * 15 + (product_ontology_url IS NOT NULL)::INT * 5"
    kind = "CASE WHEN type IN ('Person', 'Organization') THEN 10 WHEN type = 'Place' THEN 8 WHEN type IN ('Product', 'Service') THEN 6 ELSE 3 END"
    return f"least(100, floor({base} + {bonus} + CASE WHEN {n} >= 3 THEN 20 WHEN {n} = 2 THEN 10 ELSE 0 END + {kind} + 0.5))::INT"


SQL["confidence"] = f"WITH {M}, {SCORED} SELECT page_id, pos, {confidence('(40 - pos) / 40 * 70')} AS score FROM e"
TOPIC = f"coalesce(nullif(trim(regexp_replace({TITLE}, '\\s*[-|]\\s*.+$', '')), ''), {TITLE})"
SQL["linked_entities"] = f"""WITH {M}, {WIKI}, {DIRECT}, {GRAPH}, {PRODUCT_PAGES},
topics AS (SELECT page_id, topic, {TOPIC_WORDS} AS w FROM (SELECT page_id, {TOPIC} AS topic FROM pages)),
bs AS (SELECT *, (count(*) OVER g - row_number() OVER (g ORDER BY pos) + 1) / count(*) OVER g * 70 AS base FROM (SELECT *, pos // 5 AS batch FROM m WHERE NOT {SKIPPED}) WINDOW g AS (PARTITION BY page_id, batch)),
j AS (SELECT bs.page_id, pos, bs.name, base, {PERSON.format(x="bs.name")} AND topic <> '' AS person, w, pg.url, pg.extract, page_item, direct_item, direct_num, mid, coalesce(kg_description, '') AS txt, kg_score, product_ontology_url
  FROM bs JOIN topics USING (page_id) LEFT JOIN pg USING (name) LEFT JOIN direct USING (name) LEFT JOIN graph USING (name) LEFT JOIN product USING (name)),
u AS (SELECT *, CASE WHEN NOT person OR (extract <> '' AND {fits("w", "extract", "contains(extract, w[1])")}) THEN url END AS wikipedia_url,
  CASE WHEN kg_score >= 60 AND (NOT person OR txt = '' OR {fits("w", "lower(txt)", "contains(lower(txt), w[1]) AND NOT " + PROFESSION)})
    THEN 'https://www.google.com/search?kgmid=' || replace(mid, 'kg:', '') ELSE 'https://www.google.com/search?q=' || url_encode(name) END AS google_kg_url FROM j),
v AS (SELECT *, coalesce(CASE WHEN wikipedia_url IS NOT NULL THEN page_item END, direct_item) AS wikidata_url FROM u),
t AS (SELECT v.*, coalesce(CASE p31 WHEN 'Q5' THEN 'Person' WHEN 'Q43229' THEN 'Organization' WHEN 'Q571' THEN 'CreativeWork' WHEN 'Q12737077' THEN 'Service' END,
  CASE WHEN regexp_matches(name, '^[A-Z][a-z]+ [A-Z][a-z]+$') THEN 'Person' WHEN regexp_matches(name, '(?i)university|school') THEN 'Organization' ELSE 'Thing' END) AS type
  FROM v LEFT JOIN items ON 'https://www.wikidata.org/wiki/Q' || items.num = wikidata_url)
SELECT page_id, pos, name, type, wikipedia_url, wikidata_url, google_kg_url, product_ontology_url, {confidence("base")} AS confidence FROM t"""
SQL["rank_entities"] = f"WITH {M}, {SCORED} SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, pos) AS rank FROM e"
SQL["merge_cached"] = f"""WITH {M}, {SCORED},
c AS (SELECT lower(name) AS k, max_by(struct_pack(name := name, type := type, confidence := confidence, g := google_kg_url), (page_id, pos)) AS v FROM e WHERE length(name) <= 5 GROUP BY 1),
f AS (SELECT page_id, pos // 5 AS batch, lower(name) AS k, min_by(struct_pack(name := name, type := type, confidence := confidence, g := google_kg_url), (-confidence, pos)) AS v FROM e WHERE length(name) BETWEEN 6 AND 9 GROUP BY 1, 2, 3),
x AS (SELECT m.page_id, m.pos, coalesce(c.v, f.v, struct_pack(name := m.name, type := 'Thing', confidence := 0, g := NULL::VARCHAR)) AS v
  FROM m LEFT JOIN c ON c.k = lower(m.name) LEFT JOIN f ON f.page_id = m.page_id AND f.batch = m.pos // 5 AND f.k = lower(m.name))
SELECT page_id, pos, v.name AS name, v.type AS type, v.confidence AS confidence, v.g AS google_kg_url FROM x"""
SQL["linkedin_person"] = "SELECT page_id, 'https://linkedin.com/in/ada-byron-' || page_id AS ada, NULL AS alan, NULL AS lower_case FROM pages"
SQL["linkedin_company"] = "SELECT p_partkey AS page_id, 'https://linkedin.com/company/part-' || p_partkey AS company, NULL AS nobody FROM part"

# ── salience and recommendations ──────────────────────────────────────────────

SALIENCE = "floor(sum(confidence) / count(*) * 0.5 + sum((confidence >= 85)::INT) / count(*) * 100 * 0.35 + sum(contains(google_kg_url, 'kgmid=')::INT) / count(*) * 100 * 0.15 + 0.5)::INT"
SQL["salience_score"] = f"WITH {M}, {SCORED} SELECT page_id, {SALIENCE} AS salience FROM e GROUP BY page_id"
SQL["salience_score_page"] = f"WITH {M}, {SCORED}, s AS (SELECT page_id, {SALIENCE} AS salience FROM e GROUP BY page_id) SELECT page_id, coalesce(salience, 0) AS salience FROM pages LEFT JOIN s USING (page_id)"
PATTERNS = ["|".join(p) for _, p in rules.TOPIC_PATTERNS]
SQL["topic_patterns"] = f"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '{PATTERNS[0]}' WHEN 1 THEN '{PATTERNS[1]}' WHEN 2 THEN '{PATTERNS[2]}' WHEN 3 THEN '{PATTERNS[1]}' END AS pattern FROM part"


def occurrences(hay: str, needle: str) -> str:
    return f"((length({hay}) - length(replace({hay}, {needle}, ''))) / length({needle}))"


ROWS = f"""pt AS (SELECT page_id, url, {TITLE} AS title, {H1} AS h1, {BODY} AS body, lower({BODY}) AS lbody FROM pages),
first AS (SELECT page_id, name FROM e WHERE pos = 0),
pr AS (SELECT pt.*, coalesce(CASE page_id % 4 WHEN 0 THEN 'SEO Search' WHEN 1 THEN 'Limo Hire' WHEN 2 THEN 'Higher Education' END, first.name, title) AS topic FROM pt LEFT JOIN first USING (page_id)),
ep AS (SELECT e.*, pr.title, pr.h1, pr.topic, {occurrences("pr.lbody", "lower(e.name)")} AS n FROM e JOIN pr USING (page_id)),
irr AS (SELECT * FROM ep WHERE confidence < 80 AND ((NOT contains(lower(title), lower(name)) AND NOT contains(lower(h1), lower(name)) AND n <= 1)
  OR (page_id % 4 <> 3 AND confidence < 40 AND NOT regexp_matches(name, '(?i)' || CASE page_id % 4 WHEN 0 THEN '{PATTERNS[1]}' WHEN 1 THEN '{PATTERNS[0]}' ELSE '{PATTERNS[2]}' END))
  OR (page_id % 4 = 0 AND regexp_matches(name, '(?i){rules.EXAMPLE_SCHOOL}') AND NOT regexp_matches(name, '(?i){rules.SEO_NAME}')))),
irrelevant AS (SELECT page_id, string_agg(name, '|' ORDER BY pos) AS bar, string_agg(name, ', ' ORDER BY pos) AS comma FROM irr GROUP BY 1)"""
SQL["irrelevant_entities"] = f"WITH {M}, {SCORED}, {ROWS} SELECT page_id, coalesce(bar, '') AS irrelevant FROM pr LEFT JOIN irrelevant USING (page_id)"
SQL["irrelevant_by_topic"] = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'University ' || p_name || '|' || p_name || '|Absent' WHEN 1 THEN p_name || '|Absent' WHEN 2 THEN p_name || '|Absent' ELSE 'Absent' END AS irrelevant FROM part"""


def fill(template: str, value: str) -> str:
    before, after = template.split("%s")
    return f"{lit(before)} || {value} || {lit(after)}"


TIPS = f"""ctx AS (SELECT page_id, string_agg(name, ', ' ORDER BY pos) FILTER (type IN {in_list(rules.CONTEXT_TYPES)}) AS ctx FROM e GROUP BY 1),
subject AS (SELECT ep.page_id, arg_min(type, pos) AS type FROM ep WHERE lower(name) = lower(topic) GROUP BY 1),
tips AS (SELECT pr.page_id, [{fill(rules.TIP_FREQUENCY, "topic")}, CASE WHEN subject.type = 'Person' THEN {fill(rules.TIP_CONTEXT, "ctx")} ELSE {fill(rules.TIP_ALIGN, "comma")} END, {fill(rules.TIP_DETAIL, "topic")}] AS l
  FROM pr LEFT JOIN irrelevant USING (page_id) LEFT JOIN ctx USING (page_id) LEFT JOIN subject USING (page_id))"""
SQL["salience_tips"] = f"WITH {M}, {SCORED}, {ROWS}, {TIPS} SELECT page_id, array_to_string(list_filter(l, lambda x: x IS NOT NULL), chr(10)) AS tips FROM tips"
RECS = f"""rec AS (SELECT page_id, pos AS o, 'Entity Coverage' AS category, {fill(rules.ADVICE_ENTITY[1], "name")} AS advice FROM ep WHERE n <= 1
  UNION ALL SELECT page_id, 1000, {lit(rules.ADVICE_TITLE[0])}, {lit(rules.ADVICE_TITLE[1])} FROM pr WHERE title = ''
  UNION ALL SELECT page_id, 1001, {lit(rules.ADVICE_DESCRIPTION[0])}, {lit(rules.ADVICE_DESCRIPTION[1])} FROM pr
  UNION ALL SELECT page_id, 1002, {lit(rules.ADVICE_H1[0])}, {lit(rules.ADVICE_H1[1])} FROM pr WHERE h1 = ''
  UNION ALL SELECT page_id, 1003, {lit(rules.ADVICE_FEW[0])}, {lit(rules.ADVICE_FEW[1])} FROM pr LEFT JOIN (SELECT page_id, count(*) AS c FROM e GROUP BY 1) USING (page_id) WHERE coalesce(c, 0) < 3),
ranked AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) AS rank, category, advice FROM rec QUALIFY rank <= 5)"""
SQL["recommend_basic"] = f"WITH {M}, {SCORED}, {ROWS}, {RECS} SELECT * FROM ranked"
BM = mentions(f"SELECT page_id, {BODY} AS t FROM pages")
SQL["main_topic"] = f"""WITH {BM}, pt AS (SELECT page_id, {TITLE} AS title, {TOPIC} AS topic, lower({BODY}) AS lbody FROM pages), h AS (SELECT m.*, {occurrences("lbody", "lower(name)")} AS n, contains(lower(title), lower(name)) AS titled FROM m JOIN pt USING (page_id)),
f AS (SELECT page_id, name AS frequent FROM h QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, pos) = 1), s AS (SELECT page_id, name AS strict FROM h WHERE titled QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, pos) = 1)
SELECT page_id, coalesce(strict, topic) AS strict, topic AS title, coalesce(frequent, topic) AS frequent FROM pt LEFT JOIN f USING (page_id) LEFT JOIN s USING (page_id)"""


def context(body: str) -> str:
    return f"{lit(rules.CONTEXT_HEAD)} || {body} || {lit(rules.CONTEXT_TAIL)}"


SQL["schema_context"] = f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN {context("'Schema types: WebPage, ' || p_type || chr(10) || 'Features: Voice search optimization (speakable)'")}
  WHEN 2 THEN {context("'Schema types: X, Y' || chr(10) || 'Features: FAQ structured data, Entity linking (sameAs)'")}
  WHEN 3 THEN {context("'Features: Provider/organization information, Knowledge domain specification'")} ELSE '' END AS context FROM part"""
SQL["recommendation_requests"] = f"""WITH {M}, {SCORED}, pt AS (SELECT page_id, {BODY} AS body FROM pages), t AS (SELECT page_id, string_agg(name, ', ' ORDER BY pos) AS names FROM (SELECT * FROM e WHERE confidence > 50 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 5) GROUP BY 1)
SELECT page_id, md5('Read:' || chr(10) || substring(body, 1, 2500) || '...' || chr(10) || chr(10) || '**Most Salient Topical Entities Identified:**' || chr(10) || coalesce(names, '') || {context("'Schema types: Article'")} || chr(10) || 'Advise.') AS prompt_md5,
  'gpt-4o' AS model, 1000 AS max_tokens FROM pt LEFT JOIN t USING (page_id)"""
SQL["parse_recommendations"] = """SELECT page_id, i AS rank, CASE WHEN page_id % 3 = 0 THEN 'C' || page_id ELSE 'General' END AS category, CASE WHEN page_id % 3 = 0 THEN 'advice ' || page_id ELSE 'none' END AS advice
FROM pages, unnest(range(1, CASE WHEN page_id % 3 = 0 THEN 7 ELSE 2 END)) AS u(i)"""
SQL["score_bands"] = f"""WITH {M}, {SCORED}, s AS (SELECT page_id, {SALIENCE} AS salience FROM e GROUP BY page_id)
SELECT 'confidence' AS kind, CASE WHEN confidence >= 70 THEN 'high' WHEN confidence >= 40 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM e GROUP BY 2
UNION ALL SELECT 'salience', CASE WHEN salience >= 80 THEN 'Excellent' WHEN salience >= 60 THEN 'Good' WHEN salience >= 40 THEN 'Moderate' ELSE 'Limited' END, count(*) FROM s GROUP BY 2"""

# ── classification ────────────────────────────────────────────────────────────

TYPED = """d AS (SELECT doc_id, lower('Doc ' || lang || ' ' || source || ' About ' || lang || ' More ' || CASE doc_id % 6 WHEN 0 THEN replace(text, ' the ', ' services ') WHEN 1 THEN replace(text, ' the ', ' guide ')
  WHEN 2 THEN replace(replace(text, ' of ', ' tuition '), ' the ', ' shop ') WHEN 3 THEN replace(replace(text, ' of ', ' limo agency '), ' the ', ' partner ') WHEN 4 THEN replace(text, ' of ', ' phd ') ELSE text END) AS t FROM documents)"""
COUNTS = ", ".join(
    " + ".join(f"len(regexp_extract_all(t, '(?i){p.replace(chr(39), chr(39) * 2)}'))" for p in patterns) + f" AS {group}" for group, patterns in rules.PAGE_TYPE_PATTERNS.items()
)
SQL["schema_type"] = f"""WITH {TYPED}, c AS (SELECT doc_id, {COUNTS} FROM d), g AS (SELECT *, greatest(service, business, education, article) AS top FROM c)
SELECT doc_id, service, agency, business, education, article, CASE WHEN service >= 2 AND agency >= 1 THEN 'Service' WHEN article >= 3 AND article > service THEN 'Article' WHEN top < 2 THEN 'WebPage'
  WHEN service = top THEN 'Service' WHEN business = top THEN 'LocalBusiness' WHEN education = top THEN 'EducationalOccupationalProgram' ELSE 'Article' END AS schema_type FROM g"""
SQL["service_type"] = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Search Engine Optimization' WHEN 1 THEN 'Pay-per-click Advertising' WHEN 2 THEN 'Search Engine Optimization' WHEN 3 THEN 'Link Building' WHEN 4 THEN 'Limousine service'
  WHEN 6 THEN 'Web Development' ELSE 'Professional Service' END AS service_type, coalesce(CASE p_partkey % 8 WHEN 0 THEN 'https://en.wikipedia.org/wiki/Search_engine_optimization|https://www.wikidata.org/wiki/Q180711'
  WHEN 1 THEN 'https://en.wikipedia.org/wiki/Pay-per-click|https://www.wikidata.org/wiki/Q836811' WHEN 2 THEN 'https://en.wikipedia.org/wiki/Search_engine_optimization|https://www.wikidata.org/wiki/Q180711'
  WHEN 3 THEN 'https://en.wikipedia.org/wiki/Link_building' WHEN 4 THEN 'https://en.wikipedia.org/wiki/Limousine|https://www.wikidata.org/wiki/Q188475'
  WHEN 6 THEN 'https://en.wikipedia.org/wiki/Web_development|https://www.wikidata.org/wiki/Q386275' END, NULL) AS same_as FROM part"""
SQL["main_topic_pattern"] = f"SELECT p_partkey, CASE WHEN service_type <> {lit(rules.DEFAULT_SERVICE_TYPE)} THEN service_type ELSE p_name END AS topic FROM ({SQL['service_type']}) s JOIN part USING (p_partkey)"
SQL["audience"] = """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Higher Education Institutions' WHEN 1 THEN 'K-12 Schools' WHEN 2 THEN 'Healthcare Organizations' WHEN 3 THEN 'E-commerce Brands' WHEN 5 THEN 'B2B Companies' END AS name,
  CASE WHEN p_size % 6 IN (0, 1) THEN 'EducationalAudience' WHEN p_size % 6 <> 4 THEN 'Audience' END AS type,
  CASE p_size % 6 WHEN 0 THEN 'Higher Education' WHEN 1 THEN 'K-12 Education' WHEN 2 THEN 'Healthcare' WHEN 3 THEN 'E-commerce' WHEN 5 THEN 'B2B' END AS industry,
  CASE WHEN p_size % 6 IN (0, 1) THEN 'Administrator' END AS educational_role, CASE p_size % 6 WHEN 2 THEN 'Healthcare' WHEN 3 THEN 'E-commerce' WHEN 5 THEN 'B2B' END AS audience_type FROM part"""

# ── structured data of the annotated pages ────────────────────────────────────

SQL["contact_info"] = """SELECT page_id, '(312) 555-' || lpad((page_id % 10000)::VARCHAR, 4, '0') AS telephone, lpad((page_id % 100000)::VARCHAR, 5, '0') AS postalCode, 'IL' AS addressRegion, 'US' AS addressCountry,
  (page_id + 1) || ' Main Street' AS streetAddress, 'Springfield' AS addressLocality FROM pages"""
SQL["parse_address"] = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '75460-' || lpad(p_size::VARCHAR, 4, '0') WHEN 1 THEN '12345' END AS postalCode, CASE p_partkey % 6 WHEN 0 THEN 'TX' WHEN 3 THEN 'NY' END AS addressRegion,
  CASE WHEN p_partkey % 6 IN (0, 4) THEN 'US' END AS addressCountry, CASE p_partkey % 6 WHEN 0 THEN p_size || ' ' || p_name || ' road' WHEN 1 THEN p_name || ' lane' WHEN 2 THEN p_name WHEN 4 THEN p_name END AS streetAddress,
  CASE p_partkey % 6 WHEN 0 THEN 'Paris' WHEN 4 THEN p_brand || ' usa' END AS addressLocality FROM part"""
SQL["social_links"] = """SELECT page_id, i AS pos, CASE i WHEN 0 THEN 'https://facebook.com/f' || page_id WHEN 1 THEN 'https://twitter.com/t' || page_id ELSE 'https://www.linkedin.com/in/ada-byron-' || page_id END AS link
FROM pages, unnest(range(0, 3)) AS u(i)"""
AUTHOR = "CASE WHEN page_id % 3 = 0 THEN 'Ada Byron' ELSE 'Grace Brewster Murray' END"
ORGANIZATION = "CASE WHEN page_id % 4 = 0 THEN 'Site ' || page_id ELSE 'Brand ' || page_id END"
SQL["author_and_organization"] = f"SELECT page_id, {AUTHOR} AS author, {ORGANIZATION} AS organization FROM pages"

# Paragraph texts of an article: each opens at <p> and closes at the next </p>, <p> or </article>.
PARAGRAPHS = f"list_transform(string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:], lambda p: trim({unescape(no_tags("split_part(p, '</p>', 1)"))}, ' ' || chr(9) || chr(10) || chr(13)))"
QUESTION = r"\b(what|how|why|when|where|who|which|can|could|should|would|will|is|are|do|does|did)\b"


def clip(x: str, limit: int, floor: int) -> str:
    head = f"substring({x}, 1, {limit})"
    last = f"({limit} - strpos(reverse({head}), '.'))"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} WHEN strpos(reverse({head}), '.') > 0 AND {last} > {floor} THEN substring({head}, 1, {last} + 1) ELSE {head} || '...' END"


FAQ = f"""pp AS (SELECT page_id, html, {H1} AS h1, {PARAGRAPHS} AS ps FROM pages),
ha AS (SELECT page_id, h1, list_filter(ps, lambda p: length(p) > 20)[1] AS a FROM pp),
faq AS (SELECT page_id, 0 AS pos, 'What is item ' || page_id || '?' AS name, 'Item ' || page_id || ' is a part of the corpus of pages.' AS answer FROM pages
  UNION ALL SELECT page_id, 1, 'How big is it?', 'It has ' || length(html) || ' characters of source.' FROM pages
  UNION ALL SELECT page_id, 2, CASE WHEN regexp_matches(h1, '[?!.]$') OR NOT regexp_matches(h1, '(?i){QUESTION}') THEN h1 ELSE h1 || '?' END, {clip(collapse("a"), 1500, 1000)} FROM ha
    WHERE length(h1) BETWEEN 10 AND 300 AND (regexp_matches(h1, '(?i){QUESTION}') OR regexp_matches(h1, '\\?$')) AND length(a) > 50)"""
SQL["faq"] = f"WITH {FAQ} SELECT * FROM faq"
SQL["clean_qa"] = f"""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN '' ELSE '' END || 'how ' || lang || CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '?' END AS question,
  {clip(collapse("text"), 1500, 1000)} AS answer FROM documents"""
SQL["howto"] = """SELECT page_id, 'How to file page ' || page_id AS name, 'Filing takes a moment and needs two tools.' AS description, 'PT' || (page_id % 50 + 1) || 'M' AS "totalTime",
  '1/Open folder number ' || page_id || ' in the cabinet./Open|2/Spend ' || (page_id % 50 + 1) || ' minutes to put page ' || page_id || ' in.' AS steps, 'Folder|Label ' || page_id || '|Pen' AS supply FROM pages"""
SQL["howto_from_headings"] = """SELECT p_partkey AS page_id, 'How to use ' || p_name AS name, '1/Take ' || p_name || '/First take it. Then look.|2/2. Turn/Turn it ' || p_size || ' times.' AS steps FROM part"""
SQL["howto_numbered"] = """SELECT p_partkey AS page_id, 'How to keep ' || p_name AS name, 'Everything here takes a little care and thought.' AS description,
  '1/Take the ' || p_name || ' out of its box|2/Turn it ' || p_size || ' times to the left' AS steps FROM part"""
SQL["faq_accordion"] = """SELECT p_partkey AS page_id, i AS pos, CASE i WHEN 0 THEN 'How is ' || p_name || ' made?' ELSE 'Where is ' || p_name || ' sold?' END AS name,
  CASE i WHEN 0 THEN 'It is made of ' || p_type || ' in boxes of ' || p_size || ' pieces.' ELSE 'Shops of the brand ' || p_brand || ' sell it for a price.' END AS answer FROM part, unnest(range(0, 2)) AS u(i)"""
SQL["howto_time"] = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'PT5M' WHEN 1 THEN 'PT' || p_size || 'H' WHEN 2 THEN 'P' || p_size || 'D' WHEN 3 THEN 'PT' || p_size || 'M' END AS total_time FROM part"""
SQL["clean_step"] = f"SELECT doc_id, {clip(collapse('text'), 1000, 800)} AS step FROM documents"
SQL["program_details"] = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'P18M' WHEN 1 THEN 'P4Y' WHEN 2 THEN 'P12W' END AS "timeToComplete", CASE WHEN p_partkey % 4 = 2 THEN 30 END AS "numberOfCredits",
  CASE p_partkey % 4 WHEN 1 THEN 'Degree' WHEN 2 THEN 'Certificate' END AS credential, CASE p_partkey % 4 WHEN 1 THEN 'hybrid' WHEN 2 THEN 'online' END AS mode FROM part"""


def js(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN to_json({x})::VARCHAR END"


def key(name: str, value: str) -> str:
    """An optional key with a comma before it."""
    return f"coalesce(',\"{name}\":' || {value}, '')"


THINGS = f"""things AS (SELECT page_id, pos, name, confidence, wikipedia_url, '{{"@type":' || {js("type")} || ',"name":' || {js("name")} || {key("additionalType", js("product_ontology_url"))}
  || ',"sameAs":[' || concat_ws(',', {js("wikipedia_url")}, {js("wikidata_url")}, {js("google_kg_url")}) || ']}}' AS thing FROM e),
known AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY e.pos) - 1 AS pos, '{{"@type":"Thing","name":' || {js("lower(name)")} || ',"sameAs":[' || concat_ws(',', {js("wikipedia_url")}, {js("google_kg_url")}) || ']}}' AS thing
  FROM e WHERE confidence > 60 AND wikipedia_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY e.pos) <= 12)"""
SQL["about_things"] = f"WITH {M}, {SCORED}, {THINGS} SELECT page_id, pos, thing FROM things"
SQL["knows_about"] = f"WITH {M}, {SCORED}, {THINGS} SELECT page_id, pos, thing FROM known"
SQL["education_provider"] = f"""WITH {M}, {SCORED}, s AS (SELECT page_id, min_by(CASE WHEN pos = 3 AND page_id % 3 = 0 THEN name || ' Academy' ELSE name END, pos) FILTER ((pos = 3 AND page_id % 3 = 0) OR regexp_matches(name, '(?i){rules.SCHOOL_NAME}')) AS school,
  min_by(name, pos) AS first FROM e GROUP BY 1) SELECT page_id, coalesce(school, CASE WHEN page_id % 2 <> 0 THEN 'T' || page_id END, first, 'Educational Institution') AS provider FROM pages LEFT JOIN s USING (page_id)"""
SPEAKABLE = {n: '\'{"@type":"SpeakableSpecification","xpath":[' + ",".join('"' + p.replace('"', '\\"') + '"' for p in rules.SPEAKABLE[:n]) + "]}'" for n in (4, 5, 6)}
SQL["speakable"] = "SELECT page_id, " + ", ".join(f"{v} AS speakable_{n}" for n, v in SPEAKABLE.items()) + " FROM pages"
LABEL = "split_part(regexp_replace(regexp_extract(origin, '//(.*)$', 1), '^www\\.', ''), '.', 1)"
SITE = f"""site AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN 'Site ' || page_id ELSE array_to_string(list_transform(string_split_regex({LABEL}, '[-_]'), lambda w: upper(w[1]) || w[2:]), ' ') END AS site_name,
  CASE WHEN page_id % 5 <> 0 THEN '/img/' || page_id || '.png' END AS image FROM (SELECT page_id, url, html, {TITLE} AS title, {TOPIC} AS name, 'About page ' || page_id AS description, {ORIGIN} AS origin FROM pages)),
nodes AS (SELECT *, '["https://facebook.com/f' || page_id || '","https://twitter.com/t' || page_id || '","https://www.linkedin.com/in/ada-byron-' || page_id || '"]' AS socials FROM site),
org AS (SELECT *, '{{"@type":"Organization","@id":"' || origin || '/#organization","name":' || {js("site_name")} || ',"url":"' || origin || '/"' || coalesce(',"logo":{{"@type":"ImageObject","url":"' || origin || image || '"}}', '') || ',"sameAs":' || socials || '}}' AS organization,
  '{{"@type":"WebSite","@id":"' || origin || '/#website","url":"' || origin || '/","publisher":{{"@id":"' || origin || '/#organization"}},"name":' || {js("site_name")} || '}}' AS website FROM nodes)"""
SQL["site_nodes"] = f"WITH {SITE} SELECT page_id, organization, website FROM org"


def slice_json(first: int, count: int | None, table: str = "things") -> str:
    upper = f" AND pos < {first + count}" if count else ""
    return f"(SELECT '[' || string_agg(thing, ',' ORDER BY pos) || ']' FROM {table} t WHERE t.page_id = o.page_id AND pos >= {first}{upper})"


DOCS = f"""fj AS (SELECT page_id, '{{"@type":"FAQPage","mainEntity":[' || string_agg('{{"@type":"Question","name":' || {js("name")} || ',"acceptedAnswer":{{"@type":"Answer","text":' || {js("answer")} || '}}}}', ',' ORDER BY pos) || ']}}' AS faq FROM faq GROUP BY 1),
o AS (SELECT org.*, faq, {AUTHOR} AS author, {ORGANIZATION} AS org_name, '{{"@type":"HowTo","name":"How to file page ' || page_id || '","step":[{{"@type":"HowToStep","position":1,"text":"Open folder number ' || page_id || ' in the cabinet.","name":"Open"}},'
  || '{{"@type":"HowToStep","position":2,"text":"Spend ' || (page_id % 50 + 1) || ' minutes to put page ' || page_id || ' in."}}],"description":"Filing takes a moment and needs two tools.","totalTime":"PT' || (page_id % 50 + 1)
  || 'M","supply":[{{"@type":"HowToSupply","name":"Folder"}},{{"@type":"HowToSupply","name":"Label ' || page_id || '"}},{{"@type":"HowToSupply","name":"Pen"}}]}}' AS howto,
  '"(312) 555-' || lpad((page_id % 10000)::VARCHAR, 4, '0') || '"' AS phone, '{{"@type":"PostalAddress","postalCode":"' || lpad((page_id % 100000)::VARCHAR, 5, '0') || '","addressRegion":"IL","addressCountry":"US","streetAddress":"' || (page_id + 1)
  || ' Main Street","addressLocality":"Springfield"}}' AS address FROM org JOIN fj USING (page_id))"""
PAGE_HEAD = f"""'{{"@context":"https://schema.org","@graph":[' || organization || ',' || website || ',{{"@type":"WebPage","@id":"' || url || '#webpage","url":"' || url || '","name":' || {js("title")} || ',"description":"' || description
  || '","publisher":{{"@id":"' || origin || '/#organization"}},"isPartOf":{{"@id":"' || origin || '/#website"}}'"""
JSONLD = f"WITH {M}, {SCORED}, {THINGS}, {FAQ}, {SITE}, {DOCS} SELECT page_id, "
SQL["jsonld_webpage"] = f"""{JSONLD} {PAGE_HEAD} || {key("primaryImageOfPage", js("origin || image"))} || ',"author":{{"@type":"Person","name":"' || author || '"}},"mainEntity":' || howto
  || {key("about", slice_json(0, 4))} || {key("mentions", slice_json(4, 6))} || ',"speakable":' || {SPEAKABLE[4]} || '}}]}}' AS jsonld FROM o"""
SQL["jsonld_service"] = f"""{JSONLD} {PAGE_HEAD} || {key("primaryImageOfPage", js("image"))} || ',"mainEntity":{{"@type":"Service","name":' || {js("name")} || ',"serviceType":"Professional Service","description":"' || description
  || '","provider":{{"@id":"' || origin || '/#organization"}}' || {key("about", slice_json(0, 3))} || {key("mentions", slice_json(3, 5))} || '}},"speakable":' || {SPEAKABLE[4]} || ',"hasPart":[' || faq || ',' || howto || ']}}]}}' AS jsonld FROM o"""
SQL["jsonld_article"] = f"""{JSONLD} '{{"@context":"https://schema.org","@type":"WebPage","url":"' || url || '","name":' || {js("title")} || ',"description":"' || description || '","mainEntity":{{"@type":"Article","headline":' || {js("title")}
  || ',"description":"' || description || '","author":{{"@type":"Person","name":"' || author || '"}}}},"hasPart":[' || faq || ',' || howto || ']' || {key("about", "(SELECT thing FROM things t WHERE t.page_id = o.page_id AND pos = 0)")}
  || {key("mentions", slice_json(1, None))} || ',"publisher":{{"@type":"Organization","name":"' || org_name || '"}},"speakable":' || {SPEAKABLE[6]} || '}}' AS jsonld FROM o"""
OFFERS = f"""(SELECT '{{"@type":"OfferCatalog","name":"Services","itemListElement":[' || string_agg('{{"@type":"Offer","itemOffered":{{"@type":"Service","name":' || {js("name")} || '}}}}', ',' ORDER BY pos) || ']}}'
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM e WHERE confidence > 50 AND regexp_matches(lower(name), '{"|".join(rules.OFFER_WORDS)}')) x WHERE x.page_id = o.page_id AND r <= 5)"""
SQL["jsonld_local_business"] = f"""{JSONLD} '{{"@context":"https://schema.org","@type":"LocalBusiness","name":' || {js("name")} || ',"url":"' || url || '","description":"' || description || '","telephone":' || phone || ',"address":' || address
  || {key("hasOfferCatalog", OFFERS)} || {key("knowsAbout", slice_json(0, 12, "known"))} || ',"sameAs":' || socials || '}}' AS jsonld FROM o"""
PROVIDER = f"""'{{"@type":"CollegeOrUniversity","name":' || {js("name")} || ',"description":"' || description || '","telephone":' || phone || ',"address":' || address || '}}'"""
SQL["jsonld_educational"] = f"""{JSONLD} '{{"@context":"https://schema.org","@type":"WebPage","name":' || {js("title")} || ',"url":"' || url || '","description":"' || description || '","provider":' || {PROVIDER}
  || ',"mainEntity":{{"@type":"EducationalOccupationalProgram","name":' || {js("title")} || ',"url":"' || url || '","description":"' || description || '","provider":' || {PROVIDER} || '}},"hasPart":' || faq
  || {key("about", slice_json(0, 4))} || {key("mentions", slice_json(4, 4))} || ',"publisher":{{"@type":"Organization","name":"' || org_name || '"}},"speakable":' || {SPEAKABLE[5]} || '}}' AS jsonld FROM o"""
ANNOTATED_TYPED = f"d AS (SELECT page_id, lower({TITLE} || ' About page ' || page_id || ' What is item ' || page_id || ' Q: How big is it? How to file page ' || page_id || ' Step 1: Open' || coalesce(' ' || nullif({H1}, ''), '') || ' ' || {BODY}) AS t FROM pages)"
SQL["generate_jsonld"] = f"""WITH {ANNOTATED_TYPED}, c AS (SELECT page_id, {COUNTS} FROM d), g AS (SELECT *, greatest(service, business, education, article) AS top FROM c),
k AS (SELECT CASE WHEN service >= 2 AND agency >= 1 THEN 'Service' WHEN article >= 3 AND article > service THEN 'Article' WHEN top < 2 THEN 'WebPage'
  WHEN service = top THEN 'Service' WHEN business = top THEN 'LocalBusiness' WHEN education = top THEN 'EducationalOccupationalProgram' ELSE 'Article' END AS schema_type FROM g)
SELECT schema_type, count(*) AS pages, count(*) AS documents FROM k GROUP BY 1"""

SERVICE_KEYS = """CASE WHEN page_id % 5 = 1 THEN ',"sameAs":["https://en.wikipedia.org/wiki/Search_engine_optimization","https://www.wikidata.org/wiki/Q180711"],"additionalType":"http://www.productontology.org/id/Search_Engine_Optimization"' ELSE '' END"""
AUDIENCE_KEYS = """CASE WHEN page_id % 5 = 1 THEN ',"audience":{"@type":"EducationalAudience","name":"Higher Education Institutions","educationalRole":"Administrator"},"areaServed":{"@type":"AdministrativeArea","name":"United States"},"category":"Higher Education"' ELSE '' END"""
PROGRAM_KEYS = """CASE WHEN page_id % 5 = 3 THEN ',"timeToComplete":"P18M","numberOfCredits":30,"educationalCredentialAwarded":{"@type":"EducationalOccupationalCredential","credentialCategory":"Certificate"},"educationalProgramMode":"online"' ELSE '' END"""
TYPE_DOCUMENTS = {kind: SQL[f"jsonld_{query}"].removeprefix(JSONLD).removesuffix(" AS jsonld FROM o") for kind, query in (
    ("WebPage", "webpage"), ("Service", "service"), ("Article", "article"), ("LocalBusiness", "local_business"), ("EducationalOccupationalProgram", "educational"))}
TYPE_DOCUMENTS["Service"] = (
    TYPE_DOCUMENTS["Service"]
    .replace('"serviceType":"Professional Service",', """"serviceType":"' || CASE WHEN page_id % 5 = 1 THEN 'Search Engine Optimization' ELSE 'Professional Service' END || '",""")
    .replace("""'","provider":{"@id":"' || origin || '/#organization"}'""", f"""'"' || {SERVICE_KEYS} || ',"provider":{{"@id":"' || origin || '/#organization"}}' || {AUDIENCE_KEYS}""")
)
TYPE_DOCUMENTS["EducationalOccupationalProgram"] = TYPE_DOCUMENTS["EducationalOccupationalProgram"].replace(
    """description || '","provider":' || """ + PROVIDER + """ || '},"hasPart":'""", f"""description || '"' || {PROGRAM_KEYS} || ',"provider":' || {PROVIDER} || '}},"hasPart":'"""
)
TYPED_DESCRIPTION = f"'About page ' || page_id || {TYPE_WORDS}"
TYPED_SITE = SITE.replace("'About page ' || page_id AS description", f"{TYPED_DESCRIPTION} AS description")
TYPED_COUNTS = ANNOTATED_TYPED.replace("' About page ' || page_id", f"' ' || {TYPED_DESCRIPTION}").replace(
    "FROM pages", f"FROM (SELECT page_id, CASE WHEN page_id % 5 = 3 THEN replace(html, '<article>', '{PROGRAM}') ELSE html END AS html FROM pages)"
)
SQL["generate_jsonld_types"] = f"""WITH {M}, {SCORED}, {THINGS}, {FAQ}, {TYPED_SITE}, {DOCS}, {TYPED_COUNTS}, c AS (SELECT page_id, {COUNTS} FROM d), g AS (SELECT *, greatest(service, business, education, article) AS top FROM c),
k AS (SELECT page_id, CASE WHEN service >= 2 AND agency >= 1 THEN 'Service' WHEN article >= 3 AND article > service THEN 'Article' WHEN top < 2 THEN 'WebPage'
  WHEN service = top THEN 'Service' WHEN business = top THEN 'LocalBusiness' WHEN education = top THEN 'EducationalOccupationalProgram' ELSE 'Article' END AS schema_type FROM g)
SELECT page_id, schema_type, CASE schema_type {" ".join(f"WHEN '{kind}' THEN {text}" for kind, text in TYPE_DOCUMENTS.items())} END AS jsonld FROM o JOIN k USING (page_id)"""

# ── fan-out ───────────────────────────────────────────────────────────────────

SQL["semantic_chunks"] = f"""SELECT page_id, 0 AS pos, 'primary_topic' AS type, NULL AS heading, substring(concat_ws(' — ', nullif({TITLE}, ''), nullif({H1}, ''), 'About page ' || page_id), 1, 600) AS content FROM pages
UNION ALL SELECT page_id, 1, 'section', 'What is item ' || page_id, 'Item ' || page_id || ' is a part of the corpus of pages.' FROM pages
UNION ALL SELECT page_id, 2, 'section', 'Q: How big is it?', 'no Answer: It has ' || length(html) || '  characters of source.' FROM pages
UNION ALL SELECT page_id, 3, 'section', 'How to file page ' || page_id, 'Filing takes a moment and needs two tools. Step 1: OpenOpen folder number ' || page_id || ' in the cabinet.Spend ' || (page_id % 50 + 1) || ' minutes to put page ' || page_id
  || ' in. FolderLabel ' || page_id || 'Pen' FROM pages
UNION ALL SELECT page_id, 4, 'list', NULL, 'Folder | Label ' || page_id || ' | Pen' FROM pages"""
SQL["semantic_chunks_fallback"] = f"""WITH pp AS (SELECT page_id, concat_ws(' — ', nullif({TITLE}, ''), nullif({H1}, '')) AS topic, {PARAGRAPHS} AS ps FROM pages),
q AS (SELECT page_id, topic, list_transform(list_filter(list_transform(ps, lambda p: {collapse("p")}), lambda p: length(p) >= 80)[1:6], lambda p: substring(p, 1, 400)) AS paras,
  list_filter(ps, lambda p: length(p) BETWEEN 2 AND 80) AS t FROM pp),
d AS (SELECT *, list_filter(t, lambda x, i: list_position(t, x) = i)[1:20] AS terms FROM q),
a AS (SELECT page_id, 1 AS o, 'primary_topic' AS type, substring(topic, 1, 600) AS content FROM d WHERE topic <> '' UNION ALL SELECT page_id, 2, 'paragraphs', substring(array_to_string(paras, ' | '), 1, 1200) FROM d WHERE len(paras) > 0
  UNION ALL SELECT page_id, 3, 'key_terms', substring(array_to_string(terms, ' | '), 1, 400) FROM d WHERE len(terms) > 0)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS pos, type, NULL AS heading, content FROM a"""
SQL["fanout_requests"] = """SELECT doc_id AS page_id, md5(text) AS content_hash, len(string_split(text, chr(10))) + 1 AS chunks_extracted, md5('Read.' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'URL: https://example.org/' || doc_id || chr(10) || chr(10) ELSE '' END
  || 'SEMANTIC CHUNKS FROM PAGE:' || chr(10) || '[' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: '{"type":"section","heading":' || to_json(lang)::VARCHAR || ',"content":' || to_json(x)::VARCHAR || '}'), ',') || ',{"type":"list","content":' || to_json(source)::VARCHAR || '}]'
  || chr(10) || 'Answer.') AS prompt_md5, 0.3::DOUBLE AS temperature, 12288 AS "maxOutputTokens" FROM documents"""
SQL["parse_fanout"] = """SELECT md5('page ' || page_id) AS content_hash, 'Page ' || page_id AS primary_entity, CASE WHEN page_id % 3 = 0 THEN 5 ELSE 4 END AS n_queries, 'Next ' || page_id || '|Then what' AS follow_ups,
  (page_id % 7) || '/' || (page_id % 5) || ' queries' AS coverage_score, '** add more a table and a list' AS recommendations FROM pages"""
SQL["fanout_queries"] = """SELECT md5('page ' || page_id) AS content_hash, i AS pos, CASE i WHEN 0 THEN 'What is page ' || page_id || '?' WHEN 1 THEN 'How to read ' || page_id || '?' WHEN 2 THEN 'Compare ' || page_id WHEN 3 THEN 'Cost of ' || page_id ELSE 'bare item' END AS query,
  CASE i WHEN 0 THEN 'Yes' WHEN 1 THEN 'Partial' WHEN 2 THEN 'No' WHEN 3 THEN 'Yes' ELSE 'Unknown' END AS coverage, CASE i WHEN 0 THEN 'title ' || page_id || ' names it' WHEN 2 THEN 'nothing there' END AS rationale
FROM pages, unnest(range(0, CASE WHEN page_id % 3 = 0 THEN 5 ELSE 4 END)) AS u(i)"""
_RUN = "SELECT '{run}' AS run, page_id, url, {cached} AS cached, CASE WHEN {changed} THEN 6 ELSE 5 END AS chunks_extracted, {parsed} AS n_parsed, {linked} AS linked FROM pages"
SQL["analyse_again"] = " UNION ALL ".join(
    (
        _RUN.format(run="first", cached="false", changed="false", parsed="(SELECT count(*) FROM pages)", linked="true"),
        _RUN.format(run="same", cached="true", changed="false", parsed="0", linked="false"),
        _RUN.format(run="changed", cached="page_id % 10 <> 3", changed="page_id % 10 = 3", parsed="(SELECT count(*) FROM pages WHERE page_id % 10 = 3)", linked="false"),
    )
)
SQL["coverage_pct"] = "SELECT md5('page ' || page_id) AS content_hash, CASE WHEN page_id % 5 <> 0 THEN floor((page_id % 7) / (page_id % 5) * 100 + 0.5)::INT END AS pct FROM pages"
SQL["coverage_rollup"] = "SELECT md5('page ' || page_id) AS content_hash, 2 AS yes, 1 AS partial, 1 AS no, (page_id % 3 = 0)::INT AS unknown FROM pages"
SQL["coverage_corpus"] = "SELECT count(*) * 2 AS yes, count(*) AS partial, count(*) AS no, count(*) FILTER (page_id % 3 = 0) AS unknown FROM pages"

# ── results, streams, DOM ─────────────────────────────────────────────────────

RESULTS = f"""{ROWS}, {TIPS}, {RECS}, sal AS (SELECT page_id, {SALIENCE} AS salience FROM e GROUP BY 1), ne AS (SELECT page_id, count(*) AS n FROM e GROUP BY 1), nr AS (SELECT page_id, count(*) AS n FROM ranked GROUP BY 1),
res AS (SELECT pr.page_id, pr.url, topic AS main_topic, made, CASE WHEN made THEN '{{"n":' || pr.page_id || '}}' ELSE '{{}}' END AS jsonld, CASE WHEN made THEN coalesce(salience, 0) ELSE 0 END AS salience, CASE WHEN made THEN coalesce(bar, '') ELSE '' END AS irrelevant,
  coalesce(ne.n, 0) AS n_entities, CASE WHEN made THEN coalesce(nr.n, 0) ELSE 0 END AS n_recommendations, CASE WHEN made THEN list_filter(tips.l, lambda x: x IS NOT NULL) ELSE [] END AS tip_list,
  CASE WHEN fanned AND pr.page_id % 3 = 0 THEN 'analysis ' || pr.page_id END AS analysis, CASE WHEN fanned THEN (pr.page_id % 9)::INT END AS chunks_extracted, CASE WHEN fanned AND pr.page_id % 3 = 1 THEN 'no key' END AS error
  FROM (SELECT *, page_id % 3 <> 2 AS made, page_id IN (SELECT doc_id FROM labels) AS fanned FROM pr) pr LEFT JOIN sal USING (page_id) LEFT JOIN irrelevant USING (page_id) LEFT JOIN ne USING (page_id) LEFT JOIN nr USING (page_id) LEFT JOIN tips USING (page_id))"""
SQL["assemble_results"] = f"""WITH {M}, {SCORED}, {RESULTS} SELECT page_id, url, main_topic, jsonld, salience, irrelevant, n_entities, n_recommendations, len(tip_list) AS n_tips, analysis, chunks_extracted, error,
  0 AS processing_time_ms, false AS cached FROM res"""
SQL["reports"] = f"""WITH {M}, {SCORED}, {RESULTS}, er AS (SELECT page_id, string_agg('| ' || name || ' | ' || type || ' | ' || confidence || '% | ' || coalesce(wikipedia_url, '-') || ' | ' || coalesce(wikidata_url, '-') || ' |', chr(10) ORDER BY pos) AS t FROM e GROUP BY 1),
rr AS (SELECT page_id, string_agg(rank || '. **[' || category || ']** ' || advice, chr(10) ORDER BY rank) AS t FROM ranked GROUP BY 1)
SELECT page_id, array_to_string(list_filter(['# Analysis Report', '', '**Processing Time:** 0ms', '**Main Topic:** ' || main_topic, '**Salience Score:** ' || salience, '**Cached:** No', '',
  '## Entities' || chr(10) || chr(10) || '| Name | Type | Confidence | Wikipedia | Wikidata |' || chr(10) || '|------|------|-----------|-----------|----------|' || chr(10) || er.t || chr(10),
  CASE WHEN made THEN '## JSON-LD' || chr(10) || chr(10) || '```json' || chr(10) || jsonld || chr(10) || '```' || chr(10) END,
  CASE WHEN made THEN '## Recommendations' || chr(10) || chr(10) || rr.t || chr(10) END,
  CASE WHEN made THEN '## Salience Tips' || chr(10) || chr(10) || array_to_string(list_transform(tip_list, lambda x: '- ' || x), chr(10)) || chr(10) END,
  CASE WHEN chunks_extracted IS NOT NULL THEN '## Fan-out Analysis' || chr(10) || chr(10) || 'Semantic chunks extracted: ' || chunks_extracted || chr(10) || chr(10)
    || CASE WHEN error IS NOT NULL THEN '> **Fan-out unavailable:** ' || error WHEN analysis IS NOT NULL THEN analysis ELSE '> No fan-out analysis was generated.' END || chr(10) END], lambda x: x IS NOT NULL), chr(10)) AS report
FROM res LEFT JOIN er USING (page_id) LEFT JOIN rr USING (page_id)"""
SQL["dom_nodes"] = f"""SELECT page_id, len(regexp_extract_all(html, '<p>')) AS p, len(regexp_extract_all(html, '<li>')) AS li, len(regexp_extract_all(html, '<a ')) AS a, 3 AS frame,
  md5({unescape(no_tags("regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"))}) AS nav_md5 FROM pages"""
SQL["dom_nodes_documents"] = "SELECT doc_id AS page_id, md5(text) AS text_md5, true AS closed FROM documents WHERE length(text) > 0"
SQL["stream_usage"] = "SELECT user_id, date_trunc('month', ts)::DATE AS month, count(*) AS runs FROM events GROUP BY 1, 2"
SQL["stream_hit_rate"] = f"""WITH {REQUESTS}, {cache("c", "view", "url_hash", "24 HOURS")}, h AS (SELECT date_trunc('hour', ts) AS hour, coalesce(ts > written_at AND ts < expires_at, false) AS hit FROM requests LEFT JOIN c USING (url_hash))
SELECT hour, count(*) AS requests, sum(hit::INT)::BIGINT AS hits FROM h GROUP BY 1"""
SQL["stream_new_content"] = """WITH RECURSIVE r AS (SELECT md5('content ' || user_id % 97) AS h, ts FROM events),
opened(h, ts) AS (
  SELECT h, min(ts) FROM r GROUP BY 1
  UNION ALL
  SELECT h, later FROM (SELECT o.h, (SELECT min(r.ts) FROM r WHERE r.h = o.h AND r.ts >= o.ts + INTERVAL 24 HOURS) AS later FROM opened o) WHERE later IS NOT NULL)
SELECT h AS content_hash, count(*) AS extractions FROM opened GROUP BY 1"""
SQL["stream_pages"] = f"SELECT page_id, {TITLE} AS title, md5({BODY}) AS body_md5 FROM pages"

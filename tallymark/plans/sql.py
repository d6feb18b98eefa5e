"""SQL that DuckDB runs over the same tables, for the queries of the catalogue."""

from __future__ import annotations

from tallymark.sources import facade

MEASURES = "measures AS (" + facade.SQL.format(**{t: t for t in facade.TABLES}) + ")"
NAMING = "coalesce(nullif(title, ''), nullif(ballot_question, ''), '')"
HASH = r"substr(md5(lower(regexp_replace(coalesce(title, '') || '|' || coalesce(ballot_question, '') || '|' || coalesce(description, ''), '^\s+|\s+$', '', 'g'))), 1, 16)"


def identifier(text: str) -> str:
    prop, bill, act, letter = r"(?i)(?:Proposition|Prop\.?)\s*(\d+[A-Z]?)", r"(?i)([AS]CA)\s*(\d+)", r"(?i)(AB|SB)\s*(\d+)", r"(?i)(?:Measure)\s*([A-Z]+)"
    one = lambda p, lead: f"WHEN regexp_matches({text}, '{p}') THEN upper('{lead}_' || regexp_extract({text}, '{p}', 1))"
    two = lambda p: f"WHEN regexp_matches({text}, '{p}') THEN upper(regexp_extract({text}, '{p}', 1) || '_' || regexp_extract({text}, '{p}', 2))"
    return " ".join([one(prop, "PROP"), two(bill), two(act), one(letter, "MEASURE")])


KEYED = f"""hashed AS (SELECT *, {NAMING} AS naming, {HASH} AS content_hash FROM measures),
named AS (SELECT *, CASE WHEN naming = '' THEN 'UNKNOWN' {identifier('naming')} ELSE coalesce('ID_' || nullif(measure_id, ''), 'MEASURE_' || nullif(measure_letter, ''), 'HASH_' || substr(content_hash, 1, 8)) END AS identifier FROM hashed),
printed AS (SELECT *, coalesce(CAST(year AS VARCHAR), 'None') || '|' || identifier || '|' || coalesce(county, 'None') AS measure_fingerprint FROM named),
keyed AS (SELECT *, measure_fingerprint || '|' || coalesce(data_source, 'None') AS fingerprint, CAST(year // 10 * 10 AS INTEGER) AS decade, CAST((year - 1) // 100 + 1 AS INTEGER) AS century FROM printed)"""
ACTIVE = "is_active AND NOT is_duplicate"
RANK = "CASE data_source WHEN 'CA_SOS' THEN 1 WHEN 'CA_SOS_Scraper' THEN 2 WHEN 'NCSL' THEN 3 WHEN 'CEDA' THEN 4 WHEN 'ICPSR' THEN 5 WHEN 'UC_Law_SF' THEN 6 ELSE 10 END"
SCORE = f"""(CASE WHEN has_summary THEN 100 ELSE 0 END + CASE WHEN yes_votes IS NOT NULL THEN 50 ELSE 0 END + CASE WHEN description <> '' THEN 25 ELSE 0 END
 + CASE WHEN pdf_url <> '' AND pdf_url <> '#' THEN 20 ELSE 0 END + CASE WHEN ballot_question <> '' THEN 15 ELSE 0 END + (10 - {RANK}) * 5
 + greatest(0, 30 - date_diff('day', CAST(updated_at AS DATE), DATE '2001-12-31')))"""
MASTERS = f"""live AS (SELECT *, {SCORE} AS score FROM keyed WHERE NOT is_duplicate),
mastered AS (SELECT *, count(*) OVER g AS group_size, first_value(id) OVER (PARTITION BY measure_fingerprint ORDER BY score DESC, id) AS master FROM live WINDOW g AS (PARTITION BY measure_fingerprint))"""
BATCHES = """existing AS (SELECT * FROM keyed WHERE id % 3 <> 0), incoming AS (SELECT * FROM keyed WHERE id % 3 = 0 UNION ALL SELECT * REPLACE (id + 10000000 AS id, 'Changed' AS description, yes_votes + 1 AS yes_votes) FROM keyed WHERE id % 15 = 1
 UNION ALL SELECT * REPLACE (id + 20000000 AS id, 'https://example.org/new.pdf' AS pdf_url) FROM keyed WHERE id % 15 = 2 UNION ALL SELECT * REPLACE (id + 30000000 AS id, 'Asked anew?' AS ballot_question, true AS has_summary) FROM keyed WHERE id % 15 = 4),
by_print AS (SELECT fingerprint, min(id) AS a FROM existing GROUP BY 1), by_content AS (SELECT content_hash, min(id) AS b FROM existing WHERE NOT is_duplicate GROUP BY 1), by_measure AS (SELECT measure_fingerprint, min(id) AS c FROM existing WHERE NOT is_duplicate GROUP BY 1)"""


def classified(source: str = "incoming", name: str = "classified") -> str:
    return f"""{name} AS (SELECT i.*, CASE WHEN a IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'content' WHEN c IS NOT NULL THEN 'cross_source' ELSE 'none' END AS match_type, coalesce(a, b, c) AS matched_id
 FROM {source} i LEFT JOIN by_print USING (fingerprint) LEFT JOIN by_content USING (content_hash) LEFT JOIN by_measure USING (measure_fingerprint))"""


WATCHED = ["summary_text", "yes_votes", "no_votes", "percent_yes", "passed", "pdf_url", "description"]
PAIRS = "pairs AS (SELECT n.id AS nid, o.id AS oid, " + ", ".join(f"n.{c} AS n_{c}, o.{c} AS o_{c}" for c in [*WATCHED, "has_summary", "data_source"]) + " FROM classified n JOIN existing o ON o.id = n.matched_id WHERE match_type IN ('exact', 'content'))"
NEWS = "(" + " OR ".join(f"(n_{c} IS NOT NULL AND o_{c} IS DISTINCT FROM n_{c})" for c in WATCHED) + ")"
UPDATES = f"updates AS (SELECT nid AS id, oid AS old_id, {NEWS} AS has_new_data, (NOT coalesce(o_has_summary, false) AND coalesce(n_has_summary, false)) OR (coalesce(o_pdf_url, '') = '' AND coalesce(n_pdf_url, '') <> '') AS would_update FROM pairs)"


def percent(part: str, total: str, scale: int) -> str:
    return f"CASE WHEN {total} > 0 THEN floor(CAST({part} AS DOUBLE) / ({total}) * 100 * {scale}.0 + 0.5) / {scale}.0 END"


def on(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([MEASURES, *ctes]) + "\n" + select


def m(select: str) -> str:
    return on(select)


def k(select: str, *ctes: str) -> str:
    return on(select, KEYED, *ctes)


def b(select: str, *ctes: str) -> str:
    return k(select, BATCHES, classified(), *ctes)


N_IF = "count(*) FILTER (WHERE {})".format
TOPIC = "coalesce(nullif(topic_primary, ''), nullif(category_topic, ''))"
OVERALL = f"""SELECT count(*) AS total_measures, {N_IF('has_summary')} AS with_summaries, {N_IF('yes_votes IS NOT NULL')} AS with_votes, min(year) AS year_min, max(year) AS year_max, CAST(max(year) - min(year) AS INTEGER) AS year_span,
 {N_IF('passed = 1')} AS passed, {N_IF('passed = 0')} AS failed, count(*) - {N_IF('passed = 1')} - {N_IF('passed = 0')} AS unknown, count(DISTINCT data_source) AS sources, count(DISTINCT county) AS counties, count(DISTINCT topic_primary) AS topics FROM measures WHERE {ACTIVE}"""
SHOWN = "lower(concat_ws(' ', nullif(title, ''), coalesce(nullif(title, ''), nullif(ballot_question, '')), nullif(description, ''), nullif(summary_text, ''), nullif(topic_primary, ''), CAST(year AS VARCHAR)))"
LIKE = "(coalesce(title ILIKE '%measure b%', false) OR coalesce(description ILIKE '%measure b%', false) OR coalesce(ballot_question ILIKE '%measure b%', false))"
TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')".format


def bm25(docs: str, words: list[str]) -> str:
    """docs: a select of doc and terms."""
    tf = ", ".join(f"len(list_filter(terms, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(words)))
    part = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + CAST(1 AS DOUBLE)) * (tf{i} * CAST(2.2 AS DOUBLE)) / (tf{i} + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / (CAST(total AS DOUBLE) / n)))" for i in range(len(words)))
    return f"""own AS ({docs}), counted AS (SELECT doc, len(terms) AS dl, {tf} FROM own), totals AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(dl) AS total, {df} FROM counted),
hits AS (SELECT doc, floor(({part}) * 1000000.0 + 0.5) / 1000000.0 AS score FROM counted, totals WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(words)))})"""


FOLDED = r"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')".format
TEXTS = ["title", "description", "ballot_question", "summary_text", "county"]


def phrase(terms: str, columns: list[int] | None = None, first: bool = False) -> str:
    """How often words in a row (the last with * for a prefix) stand in columns t0, t1, ..."""
    said = terms.split()
    where = " AND ".join(f"starts_with(t{{0}}[i + {j}], '{w[:-1]}')" if w.endswith("*") else f"t{{0}}[i + {j}] = '{w}'" for j, w in enumerate(said))
    return " + ".join(f"len(list_filter(range(1, len(t{c}) - {len(said) - 1} + 1), lambda i: {where.format(c)}{' AND i = 1' if first else ''}))" for c in (range(len(TEXTS)) if columns is None else columns))


def matched(source: str, columns: list[str], phrases: list[str], condition: str, doc: str = "id", more: str = "") -> str:
    """(id, score) of rows of `source` that satisfy a condition over p0, p1, ... (more: columns besides)."""
    n = range(len(phrases))
    part = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + CAST(1 AS DOUBLE)) * (p{i} * CAST(2.2 AS DOUBLE)) / (p{i} + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / (CAST(total AS DOUBLE) / n)))" for i in n)
    return f"""split_up AS (SELECT {doc} AS id, {', '.join(f'{FOLDED(c)} AS t{i}' for i, c in enumerate(columns))} FROM {source}),
found AS (SELECT id, {' + '.join(f'len(t{i})' for i in range(len(columns)))} AS dl, {', '.join(f'{p} AS p{i}' for i, p in enumerate(phrases))}{more} FROM split_up),
sums AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(dl) AS total, {', '.join(f'count(*) FILTER (WHERE p{i} > 0) AS df{i}' for i in n)} FROM found)
SELECT id, floor(({part}) * 1000000.0 + 0.5) / 1000000.0 AS score FROM found, sums WHERE {condition}"""


NEAR_SQL = ", ".join(
    "(" + " OR ".join(f"len(list_filter(range(1, len(t{c}) + 1), lambda i: t{c}[i] = '{a}' AND len(list_filter(range(1, len(t{c}) + 1), lambda j: t{c}[j] = '{b}' AND abs(i - j) - 1 <= {w})) > 0)) > 0" for c in range(len(TEXTS))) + f") AS {a}_{b}"
    for a, b, w in (("shall", "adopt", 2), ("question", "local", 0))
)


def key_of(text: str) -> str:
    pats = [r"(?i)\b(ACA\s+\d+)\b", r"(?i)\b(SCA\s+\d+)\b", r"(?i)\b(AB\s+\d+)\b", r"(?i)\b(SB\s+\d+)\b", r"(?i)\b(Prop(?:osition)?\s+\d+[A-Z]?)\b"]
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN replace(upper(regexp_extract({text}, '{p}', 1)), 'PROPOSITION', 'Prop')" for p in pats) + " END"


KIND_RANK = "CASE WHEN coalesce(measure_id ILIKE 'ACA_%', false) THEN 1 WHEN coalesce(measure_id ILIKE 'SCA_%', false) THEN 2 WHEN coalesce(measure_id ILIKE 'PROP_%', false) THEN 3 ELSE 4 END"
NEED_TABLE = "need AS (SELECT * REPLACE (identifier AS measure_id) FROM keyed)"
NEED = f"{ACTIVE} AND NOT has_summary AND (year >= 2020 OR {KIND_RANK} < 4)"
NON_TEXT = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', '{}', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"').format


def elements(levels: str, page: str = "page_id", table: str = "pages") -> str:
    return rf"""found AS (SELECT {page} AS page, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>|<h{levels}\b[^>]*>.*?</h{levels}>') AS l FROM {table}),
flat AS (SELECT page, unnest(range(len(l))) AS p, l FROM found),
elements AS (SELECT page, CAST(p AS INTEGER) AS pos, lower(regexp_extract(l[p + 1], '^<(\w+)', 1)) AS tag,
 coalesce(nullif(regexp_extract(l[p + 1], '(?is)^<a\b[^>]*\bhref\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(l[p + 1], '(?is)^<a\b[^>]*\bhref\s*=\s*''([^'']*)''', 1), '')) AS href,
 regexp_extract(l[p + 1], '(?is)^<[^>]*>(.*)</\w+>$', 1) AS inner_html FROM flat)"""


def absolute(href: str) -> str:
    return f"CASE WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {href} WHEN {href}[1:2] = '//' THEN 'https:' || {href} WHEN {href}[1:1] = '/' THEN 'https://www.example.org' || {href} WHEN {href} = '' THEN 'https://www.example.org/elections/list/index.html' ELSE 'https://www.example.org/elections/list/' || {href} END"


STATUS = "CASE WHEN passed = 1 THEN 'passed' WHEN passed = 0 THEN 'failed' ELSE 'pending' END"
MERGE_FIELDS = ["description", "ballot_question", "summary_text", "yes_votes", "no_votes", "total_votes", "percent_yes", "passed", "pdf_url", "category_topic", "topic_primary"]
NUMERIC = ("yes_votes", "no_votes", "total_votes", "percent_yes", "passed")
BEST = ", ".join(f"(list({f} ORDER BY id = master DESC, CAST(updated_at AS VARCHAR) DESC, {RANK}, id) FILTER (WHERE {f if f in NUMERIC else f'nullif({f}, ' + chr(39) * 2 + ')'} IS NOT NULL))[1] AS {f}" for f in MERGE_FIELDS)
BEST_CTE = f"best AS (SELECT measure_fingerprint, any_value(master) AS master_id, count(*) AS versions, bool_or(has_summary) AS has_summary, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) FILTER (WHERE id <> master) AS merged_from, {BEST} FROM mastered WHERE group_size > 1 GROUP BY 1)"
MERGED_CTE = f"""fixed AS (SELECT *, CASE WHEN v > 0 THEN v ELSE total_votes END AS total, CASE WHEN v > 0 THEN {percent('yes_votes', 'v', 100)} ELSE percent_yes END AS share, CASE WHEN v > 0 THEN {percent('no_votes', 'v', 100)} END AS other_share,
 CASE WHEN v > 0 THEN CAST({percent('yes_votes', 'v', 100)} > 50 AS INTEGER) ELSE passed END AS outcome FROM (SELECT *, yes_votes + no_votes AS v FROM best))"""
DEDUPED = MASTERS + ",\n" + BEST_CTE + ",\n" + MERGED_CTE + """,
deduped AS (SELECT m.id, m.data_source, m.group_size > 1 AND m.id <> m.master AS is_duplicate, CASE WHEN m.group_size > 1 AND m.id <> m.master THEN 'cross_source' END AS duplicate_type, CASE WHEN m.group_size > 1 AND m.id <> m.master THEN m.master END AS master_id,
 coalesce(f.description, m.description) AS description, coalesce(f.summary_text, m.summary_text) AS summary_text, coalesce(f.total, m.total_votes) AS total_votes, coalesce(f.share, m.percent_yes) AS percent_yes, coalesce(f.outcome, m.passed) AS passed,
 '[' || f.merged_from || ']' AS merged_from, CAST(CASE WHEN m.group_size = 1 THEN 0 WHEN m.id = m.master THEN 2 ELSE 1 END AS INTEGER) AS update_count FROM mastered m LEFT JOIN fixed f ON f.master_id = m.id
 UNION ALL SELECT id, data_source, is_duplicate, duplicate_type, NULL, description, summary_text, total_votes, percent_yes, passed, NULL, 0 FROM keyed WHERE is_duplicate)"""
FRESH = """first_rows AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1)"""
UPSERTED = FRESH + ", " + classified("first_rows", "sorted_in") + """,
rounds AS (SELECT id, content_hash, measure_fingerprint, 'open' AS state FROM sorted_in WHERE match_type = 'none'
 UNION ALL SELECT id, content_hash, measure_fingerprint, CASE WHEN ahead THEN 'master' WHEN bool_or(ahead) OVER (PARTITION BY content_hash) OR bool_or(ahead) OVER (PARTITION BY measure_fingerprint) THEN 'gone' ELSE 'open' END
 FROM (SELECT *, min(id) OVER (PARTITION BY content_hash) = id AND min(id) OVER (PARTITION BY measure_fingerprint) = id AS ahead FROM rounds WHERE state = 'open')),
fc AS (SELECT content_hash, id AS bc FROM rounds WHERE state = 'master'), fm AS (SELECT measure_fingerprint, id AS bm FROM rounds WHERE state = 'master'),
near AS (SELECT f.*, CASE WHEN bc < id THEN bc END AS ec, CASE WHEN bm < id THEN bm END AS em FROM sorted_in f LEFT JOIN fc USING (content_hash) LEFT JOIN fm USING (measure_fingerprint) WHERE match_type <> 'exact'),
kinds AS (SELECT *, CASE WHEN match_type = 'content' THEN 'content' WHEN ec IS NOT NULL THEN 'content' WHEN match_type = 'cross_source' THEN 'cross_source' WHEN em IS NOT NULL THEN 'cross_source' END AS kind,
 CASE WHEN match_type = 'content' THEN matched_id WHEN ec IS NOT NULL THEN ec WHEN match_type = 'cross_source' THEN matched_id ELSE em END AS mid FROM near)"""
ONCE = ("existing AS (SELECT * FROM keyed WHERE id % 3 <> 0)", "existing AS (SELECT * FROM keyed WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1)")
WORDY = f"""wordy AS (SELECT id, list_sort(list_distinct({FOLDED("concat_ws(' ', title, ballot_question, description)")})) AS said FROM measures WHERE NOT is_duplicate),
classes AS (SELECT said, min(id) AS class_id FROM wordy WHERE len(said) > 0 GROUP BY said),
close_ones AS (SELECT a.class_id AS a, b.class_id AS b, len(list_intersect(a.said, b.said)) AS common, len(a.said) + len(b.said) AS both_sizes FROM classes a JOIN classes b ON a.class_id < b.class_id),
likes AS (SELECT a, b, CAST(common AS DOUBLE) / (both_sizes - common) AS likeness FROM close_ones WHERE 5 * common >= 4 * (both_sizes - common))"""
KEPT_FIELDS = ["year", "county", "data_source", "topic_primary", "passed", "has_summary", "yes_votes", "percent_yes"]
AFTER = f"""after AS (SELECT {', '.join(f'coalesce(s.{c}, e.{c}) AS {c}' for c in KEPT_FIELDS)}, e.is_active, e.is_duplicate FROM existing e LEFT JOIN (SELECT * FROM sorted_in WHERE match_type = 'exact') s ON s.matched_id = e.id
 UNION ALL SELECT {', '.join(KEPT_FIELDS)}, is_active, kind IS NOT NULL FROM kinds)"""
FILE_STATS = f"SELECT data_source, count(*) AS measures, count(DISTINCT measure_id) AS ids, count(DISTINCT county) AS counties, {N_IF('yes_votes IS NOT NULL')} AS with_votes, {percent(N_IF('passed = 1'), N_IF('passed IS NOT NULL'), 1000)} AS pass_rate FROM measures GROUP BY 1"
ORACLES: dict[str, str] = {
    "yearly_stats": m(f"SELECT year, count(*) AS total_measures, count(DISTINCT county) AS counties, {N_IF('passed = 1')} AS passed, {N_IF('passed = 0')} AS failed, {N_IF('has_summary')} AS with_summaries, {N_IF('yes_votes IS NOT NULL')} AS with_votes, floor(avg(percent_yes) * 10.0 + 0.5) / 10.0 AS avg_percent_yes FROM measures WHERE {ACTIVE} GROUP BY year"),
    "global_stats": m(OVERALL),
    "status_line": m(f"SELECT total_measures, with_summaries, with_votes, year_min || '-' || year_max AS year_range FROM ({OVERALL})"),
    **{name: m(f"SELECT {c}, count(*) AS n FROM measures WHERE {ACTIVE} AND {c} IS NOT NULL GROUP BY 1") for name, c in (("count_by_source", "data_source"), ("years_counts", "year"), ("topics_counts", "topic_primary"), ("counties_counts", "county"))},
    "topic_top20": m(f"SELECT {TOPIC} AS topic, count(*) AS n FROM measures WHERE {ACTIVE} AND {TOPIC} IS NOT NULL GROUP BY 1 ORDER BY n DESC, topic LIMIT 20"),
    "pass_rate": m(f"SELECT CAST(CASE WHEN p + f > 0 THEN round_even(CAST(p AS DOUBLE) / (p + f) * 100, 0) ELSE 0 END AS INTEGER) AS pass_rate FROM (SELECT {N_IF('passed = 1')} AS p, {N_IF('passed = 0')} AS f FROM measures WHERE {ACTIVE})"),
    "decade_histogram": k("SELECT decade, count(*) AS n FROM keyed GROUP BY 1"),
    "validation_profile": m(f"SELECT count(*) AS total, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years, string_agg(DISTINCT topic_primary, ',' ORDER BY topic_primary) AS topics, {N_IF('title <> ' + chr(39) * 2)} AS has_title, {N_IF('yes_votes IS NOT NULL')} AS has_votes, {N_IF('passed IS NOT NULL')} AS has_outcome, min(year) || '-' || max(year) AS year_range FROM measures"),
    "source_files": m(FILE_STATS),
    "summary_coverage_year": m(f"SELECT year, total, with_summary, {percent('with_summary', 'total', 10)} AS coverage FROM (SELECT year, count(*) AS total, {N_IF('has_summary')} AS with_summary FROM measures WHERE {ACTIVE} AND year >= 1997 GROUP BY 1)"),
    "summary_coverage_type": k(f"SELECT kind, total, with_summary, {percent('with_summary', 'total', 10)} AS coverage FROM (SELECT CASE WHEN identifier ILIKE 'ACA_%' THEN 'Constitutional Amendment (ACA)' WHEN identifier ILIKE 'SCA_%' THEN 'Constitutional Amendment (SCA)' WHEN identifier ILIKE 'PROP_%' THEN 'Proposition' WHEN identifier ILIKE 'MEASURE_%' THEN 'Local Measure' ELSE 'Other' END AS kind, count(*) AS total, {N_IF('has_summary')} AS with_summary FROM keyed WHERE {ACTIVE} GROUP BY 1)"),
    "active_measures": m(f"SELECT id, year, county FROM measures WHERE {ACTIVE}"),
    "filter_year": m("SELECT id FROM measures WHERE year = 1997"),
    "filter_year_range": m("SELECT id FROM measures WHERE year BETWEEN 1996 AND 1998"),
    "filter_passed": m("SELECT id FROM measures WHERE passed = 1"),
    "filter_equal": m("SELECT id FROM measures WHERE county = 'NATION_3' AND topic_primary = '1-URGENT' AND data_source = 'NCSL'"),
    "filter_summary_votes": m("SELECT id FROM measures WHERE has_summary AND yes_votes IS NOT NULL"),
    "facet_status": m(f"SELECT id FROM measures WHERE {STATUS} IN ('failed', 'pending')"),
    "facet_features": m("SELECT id FROM measures WHERE has_summary AND yes_votes IS NOT NULL"),
    "facet_topics": m(f"SELECT id FROM measures WHERE coalesce({TOPIC}, '') IN ('1-URGENT', 'BUILDING')"),
    "facet_text": m(f"SELECT id FROM measures WHERE (year IS NULL OR year >= 1996) AND contains({SHOWN}, 'measure b')"),
    "like_search": m(f"SELECT id FROM measures WHERE {ACTIVE} AND {LIKE}"),
    "needs_summary": k(f"SELECT id, CAST({KIND_RANK} AS INTEGER) AS kind_rank FROM need WHERE {NEED}", NEED_TABLE),
    "active_sorted_page": m(f"SELECT id, year FROM measures WHERE {ACTIVE} ORDER BY year DESC NULLS LAST, county NULLS FIRST, measure_letter NULLS FIRST, id LIMIT 100 OFFSET 50"),
    "sort_votes": m("SELECT id FROM measures ORDER BY coalesce(total_votes, 0) DESC, id LIMIT 40"),
    "sort_title": m(f"SELECT id FROM measures ORDER BY {NAMING}, id LIMIT 40"),
    "sort_votes_all": m("SELECT id FROM measures ORDER BY coalesce(total_votes, 0) DESC, id"),
    "sort_title_all": m(f"SELECT id FROM measures ORDER BY {NAMING}, id"),
    "sort_title_locale": m("SELECT id FROM (SELECT id, CASE WHEN id % 5 = 1 THEN lower(title) WHEN id % 5 = 2 THEN replace(title, 'a', '\u00e4') ELSE title END AS title, ballot_question FROM measures) ORDER BY coalesce(nullif(title, ''), nullif(ballot_question, ''), '') COLLATE en, id"),
    "site_state": m("SELECT strftime(CAST(max(updated_at) AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS data_changed, max(updated_at) > TIMESTAMP '2001-07-01' AS stale FROM measures WHERE is_active"),
    "raw_scrape": m("SELECT id, title, '/CA_SOS_20240203_040506' AS name FROM measures"),
    "featured_split": m(f"SELECT id, row_number() OVER (ORDER BY year DESC NULLS LAST, id) <= 5 AS featured FROM measures WHERE {ACTIVE}"),
    "get_measure": m("SELECT id, title, year FROM measures WHERE id = 7"),
    "measure_identifier": k("SELECT id, identifier FROM keyed"),
    "fingerprints": k("SELECT id, fingerprint, measure_fingerprint, decade, century FROM keyed"),
    "content_hash": k("SELECT id, content_hash FROM keyed"),
    "cross_source_groups": k("SELECT measure_fingerprint, count(*) AS source_count, count(DISTINCT data_source) AS distinct_sources, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, string_agg(data_source, ',' ORDER BY id) AS sources FROM keyed WHERE NOT is_duplicate GROUP BY 1 HAVING count(*) > 1"),
    "content_dup_groups": k("SELECT content_hash, count(*) AS n, min(id) AS first_id FROM keyed WHERE NOT is_duplicate GROUP BY 1 HAVING count(*) > 1"),
    "first_wins_dedupe": k("SELECT min(id) AS id, fingerprint FROM keyed GROUP BY fingerprint"),
    "master_selection": k("SELECT id, CAST(score AS BIGINT) AS score, group_size, master AS master_id FROM mastered", MASTERS),
    "merge_fields": k("SELECT measure_fingerprint, master_id, versions, has_summary, merged_from, description, ballot_question, summary_text, yes_votes, no_votes, total AS total_votes, share AS percent_yes, other_share AS percent_no, outcome AS passed, CASE WHEN v > 0 THEN CASE outcome WHEN 1 THEN 'Pass' ELSE 'Fail' END END AS pass_fail, pdf_url, category_topic, topic_primary FROM fixed", MASTERS, BEST_CTE, MERGED_CTE),
    "dedupe_cross_source": k("SELECT id, is_duplicate, duplicate_type, master_id, description, summary_text, total_votes, percent_yes, passed, merged_from, update_count FROM deduped", DEDUPED),
    "duplicate_report": k("SELECT 'total' AS part, NULL AS name, count(*) AS n FROM keyed WHERE is_duplicate UNION ALL SELECT 'by_type', duplicate_type, count(*) FROM keyed WHERE is_duplicate GROUP BY duplicate_type UNION ALL SELECT 'by_source', data_source, count(*) FROM keyed WHERE is_duplicate GROUP BY data_source"
                          " UNION ALL SELECT 'cross_source_groups', NULL, count(*) FROM (SELECT 1 FROM keyed WHERE NOT is_duplicate GROUP BY measure_fingerprint HAVING count(*) > 1)"),
    "duplicate_counts": k("SELECT count(fingerprint) - count(DISTINCT fingerprint) AS within_source, count(measure_fingerprint) - count(DISTINCT measure_fingerprint) AS cross_source, count(content_hash) - count(DISTINCT content_hash) AS content FROM keyed WHERE NOT is_duplicate"),
    "duplicate_lineage": k("SELECT d.id, d.master_id, d.duplicate_type, d.data_source AS source, x.data_source AS master_source FROM deduped d LEFT JOIN deduped x ON x.id = d.master_id WHERE d.master_id IS NOT NULL", DEDUPED),
    "mark_duplicate": m("SELECT id, CASE id WHEN 11 THEN false WHEN 5 THEN true ELSE is_duplicate END AS is_duplicate, CASE id WHEN 11 THEN NULL WHEN 5 THEN 'content' ELSE duplicate_type END AS duplicate_type, CAST(CASE id WHEN 5 THEN 3 END AS BIGINT) AS master_id FROM measures"),
    "display_projection": m("SELECT id, coalesce(nullif(title, ''), nullif(ballot_question, '')) AS measure_text, data_source AS source, CAST(nullif(year, 0) AS VARCHAR) AS year FROM measures"),
    "api_projection": m("SELECT id, year, state, county, title, percent_yes, passed, has_summary FROM measures"),
    "list_labels": m(f"SELECT id, CASE WHEN passed = 1 THEN 'Passed' WHEN passed = 0 THEN 'Failed' ELSE 'Pending' END AS badge, coalesce({TOPIC}, 'General') AS topic_label, CAST(floor(percent_yes + 0.5) AS INTEGER) AS percent FROM measures"),
    "json_rows": m("""SELECT id, '{"year":' || year || ',"county":"' || county || '"' || coalesce(',"title":"' || title || '"', '') || coalesce(',"passed":' || passed, '') || ',"has_summary":' || CAST(has_summary AS VARCHAR) || '}' AS json FROM measures"""),
    "csv_rows": m("SELECT id, year || ',' || county || ',' || coalesce(title, '') || ',' || coalesce(description, '') AS line FROM measures"),
    "schema_conform": m("SELECT id, year, has_summary, CAST(0 AS INTEGER) AS update_count, state, is_active, true AS no_merge FROM measures"),
    "schema_drift": m("SELECT id, 'CA' AS state, true AS is_active, CAST(22 AS INTEGER) AS n_missing FROM measures"),
    "content_likeness": on("SELECT id, class_id, CAST((SELECT count(*) FROM likes WHERE a = class_id OR b = class_id) AS BIGINT) AS links FROM wordy JOIN classes USING (said)", WORDY),
    "content_likeness_pairs": on("SELECT a, b, floor(likeness * 1000000.0 + 0.5) / 1000000.0 AS likeness FROM likes", WORDY),
    "kept_yearly": b(f"SELECT year, count(*) AS total_measures, count(DISTINCT county) AS counties, {N_IF('passed = 1')} AS passed, {N_IF('passed = 0')} AS failed, {N_IF('has_summary')} AS with_summaries, {N_IF('yes_votes IS NOT NULL')} AS with_votes, floor(CAST(sum(CAST(round(percent_yes * 100) AS BIGINT)) AS DOUBLE) / (count(percent_yes) * 100) * 10.0 + 0.5) / 10.0 AS avg_percent_yes FROM after WHERE {ACTIVE} GROUP BY year", UPSERTED, AFTER),
    "kept_overall": b(OVERALL.replace("FROM measures", "FROM after"), UPSERTED, AFTER),
    "kept_counts": b(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM after WHERE {ACTIVE} AND {c} IS NOT NULL GROUP BY {c}" for c in ("year", "county", "data_source", "topic_primary")), UPSERTED, AFTER),
    "new_measures": b("SELECT id FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.fingerprint = i.fingerprint) AND NOT EXISTS (SELECT 1 FROM existing e WHERE NOT e.is_duplicate AND e.content_hash = i.content_hash)"),
    "classify_batch": b("SELECT id, match_type, matched_id FROM classified"),
    "potential_updates": b("SELECT * FROM updates", PAIRS, UPDATES),
    "update_check_rollup": b("SELECT data_source, count(*) FILTER (WHERE match_type NOT IN ('exact', 'content')) AS new, count(*) FILTER (WHERE match_type IN ('exact', 'content') AND coalesce(has_new_data, false)) AS updates, count(*) FILTER (WHERE match_type IN ('exact', 'content') AND NOT coalesce(has_new_data, false)) AS unchanged FROM classified LEFT JOIN updates USING (id) GROUP BY ROLLUP (data_source)", PAIRS, UPDATES),
    "upsert_result": b("""SELECT e.id, coalesce(s.title, e.title) AS title, coalesce(s.yes_votes, e.yes_votes) AS yes_votes, CAST(CASE WHEN s.id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS update_count, e.is_duplicate, e.duplicate_type, CAST(NULL AS BIGINT) AS master_id
 FROM existing e LEFT JOIN (SELECT * FROM sorted_in WHERE match_type = 'exact') s ON s.matched_id = e.id
 UNION ALL SELECT id, title, yes_votes, CAST(0 AS INTEGER), kind IS NOT NULL, kind, mid FROM kinds""", UPSERTED),
    "upsert_counts": b(f"SELECT (SELECT count(*) FROM kinds WHERE kind IS NULL) AS inserted, {N_IF('match_type = ' + repr('exact'))} AS updated, (SELECT count(*) FROM kinds WHERE kind IS NOT NULL) AS duplicates, (SELECT count(*) FROM incoming) - count(*) AS repeated FROM sorted_in", UPSERTED),
    # the stored table holds each fingerprint once, the first
    "table_upsert": b("""SELECT e.id, coalesce(s.yes_votes, e.yes_votes) AS yes_votes, CAST(CASE WHEN s.id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS update_count, e.is_duplicate, e.duplicate_type, CAST(NULL AS BIGINT) AS master_id
 FROM existing e LEFT JOIN (SELECT * FROM sorted_in WHERE match_type = 'exact') s ON s.matched_id = e.id UNION ALL SELECT id, yes_votes, CAST(0 AS INTEGER), kind IS NOT NULL, kind, mid FROM kinds""", UPSERTED).replace(*ONCE),
    "table_insert": b("SELECT id, title, 'before' AS version FROM existing UNION ALL SELECT id, title, 'after' FROM existing UNION ALL SELECT id, title, 'after' FROM (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1) WHERE fingerprint NOT IN (SELECT fingerprint FROM existing)").replace(*ONCE),
    "table_run": b("SELECT 'checked' AS part, count(*) AS n, 'completed_with_errors' AS status FROM asked UNION ALL SELECT 'inserted', count(*), 'completed_with_errors' FROM kinds WHERE kind IS NULL UNION ALL SELECT 'updated', count(*), 'completed_with_errors' FROM sorted_in WHERE match_type = 'exact' UNION ALL SELECT 'duplicates', count(*), 'completed_with_errors' FROM kinds WHERE kind IS NOT NULL"
                  + "".join(f" UNION ALL SELECT 'audit {c}', count(*), NULL FROM news WHERE n_{c} IS NOT NULL AND o_{c} IS DISTINCT FROM n_{c} HAVING count(*) > 0" for c in WATCHED), UPSERTED, "news AS (SELECT " + ", ".join(f"n.{c} AS n_{c}, o.{c} AS o_{c}" for c in WATCHED) + " FROM sorted_in n JOIN existing o ON o.id = n.matched_id WHERE match_type = 'exact')").replace(*ONCE).replace("), incoming AS (", "), asked AS (", 1).replace("by_print AS (", "incoming AS (SELECT * FROM asked WHERE id % 10 <> 3), by_print AS (", 1),
    "table_restore": k("SELECT id, CASE WHEN id % 6 = 0 THEN 'New' ELSE title END AS title, CASE WHEN id % 6 = 0 THEN 'yes' ELSE 'no' END AS reviewed, CAST(1 + (id % 6 = 0)::INTEGER AS INTEGER) AS update_count FROM keyed QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1"),
    "change_audit": b(" UNION ALL ".join(f"SELECT oid AS measure_id, '{c}' AS field_name, CAST(o_{c} AS VARCHAR) AS old_value, CAST(n_{c} AS VARCHAR) AS new_value, n_data_source AS update_source FROM pairs WHERE n_{c} IS NOT NULL AND o_{c} IS DISTINCT FROM n_{c}" for c in WATCHED), PAIRS),
    "known_summary_join": k(f"SELECT * FROM (SELECT id, {key_of(NAMING)} AS measure_key, CASE {key_of(NAMING)} WHEN 'ACA 13' THEN 'Protect and Retain the Majority Vote Act' WHEN 'SCA 1' THEN 'Recall Process Reform' END AS summary_title FROM need WHERE {NEED}) WHERE summary_title IS NOT NULL", NEED_TABLE),
    "add_known_summary": m(f"SELECT id, has_summary OR t IS NOT NULL AS has_summary, t AS summary_title FROM (SELECT id, has_summary, CASE WHEN {ACTIVE} AND NOT has_summary THEN CASE {key_of(NAMING)} WHEN 'ACA 13' THEN 'Protect and Retain the Majority Vote Act' WHEN 'SCA 1' THEN 'Recall Process Reform' WHEN 'ACA 7' THEN 'Seven' END END AS t FROM measures)"),
    "summary_keys": m(f"SELECT id, {key_of(NAMING)} AS measure_key FROM measures"),
    "fts_postings": f"SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({TERMS('text')}) AS term FROM documents) GROUP BY 1, 2",
    "fts_bm25": "WITH " + bm25(f"SELECT doc_id AS doc, {TERMS('coalesce(text, ' + chr(39) * 2 + ')')} AS terms FROM documents", ["and", "the"]) + " SELECT doc, score FROM hits",
    "api_search": m("SELECT 1").replace("\nSELECT 1", ",\n" + bm25(f"SELECT id AS doc, {TERMS('concat_ws(' + repr(' ') + ', title, description, ballot_question, summary_text, county)')} AS terms FROM measures WHERE {ACTIVE}", ["b", "measure"]) + f"\nSELECT id, score FROM measures JOIN hits ON doc = id WHERE {ACTIVE} AND year >= 1996 AND yes_votes IS NOT NULL ORDER BY score DESC, id LIMIT 50 OFFSET 5"),
    "fts_stored": on(matched("stored", TEXTS, [phrase("measure"), phrase("b")], "p0 > 0 AND p1 > 0"), "stored AS (SELECT * REPLACE (CASE WHEN id % 15 = 1 THEN 'Measure B again' ELSE title END AS title) FROM measures WHERE id % 7 <> 0)").replace("\nsplit_up", ",\nsplit_up", 1),
    "fts_phrase": on(matched("measures", TEXTS, [phrase("measure b"), phrase("local question 1")], "p0 > 0 OR p1 > 0")).replace("\nsplit_up", ",\nsplit_up", 1),
    "fts_prefix": on(matched("measures", TEXTS, [phrase("propos*"), phrase("build*")], "p0 > 0 AND NOT p1 > 0")).replace("\nsplit_up", ",\nsplit_up", 1),
    "fts_not": on(matched("measures", TEXTS, [phrase("measure"), phrase("question"), phrase("furniture"), phrase("building")], "(p0 > 0 OR p1 > 0) AND NOT (p2 > 0 OR p3 > 0)")).replace("\nsplit_up", ",\nsplit_up", 1),
    "fts_column": on(matched("measures", TEXTS, [phrase("measure", [0, 1]), phrase("bonds", [0, 1]), phrase("nation 3", [4], first=True)], "(p0 > 0 OR p1 > 0) AND p2 > 0")).replace("\nsplit_up", ",\nsplit_up", 1),
    "fts_near": on(matched("measures", TEXTS, [phrase("shall"), phrase("adopt"), phrase("question"), phrase("local")], "(shall_adopt OR question_local) AND true", more=", " + NEAR_SQL)).replace("\nsplit_up", ",\nsplit_up", 1),
    "fts_fallback": on(f"SELECT * FROM (SELECT id, year FROM measures WHERE {ACTIVE} AND (contains(lower(coalesce(title, '')), '(relates') OR contains(lower(coalesce(description, '')), '(relates') OR contains(lower(coalesce(ballot_question, '')), '(relates')) ORDER BY year DESC, id LIMIT 40) UNION ALL SELECT id, year FROM (SELECT a.id, a.year FROM (" + "WITH " + matched("live", TEXTS, [phrase("question"), phrase("local")], "p0 > 0 AND p1 > 0") + ") h JOIN measures a ON a.id = h.id ORDER BY h.score DESC, a.id LIMIT 40)", f"live AS (SELECT * FROM measures WHERE {ACTIVE})"),
    "fts_folded": "WITH " + matched("documents", ["text"], [phrase("cafe*", [0]), phrase("et*", [0]), phrase("nino", [0])], "p0 > 0 OR p1 > 0 OR p2 > 0", doc="doc_id").replace("SELECT id, floor", "SELECT id AS doc, floor"),
    "documents_like": "SELECT doc_id FROM documents WHERE text ILIKE '%license%'",
    "link_extraction": "WITH " + elements("[23]") + f" SELECT page, pos, href, {NON_TEXT('inner_html', ' ')} AS text FROM elements WHERE tag = 'a' AND href IS NOT NULL",
    "header_forward_fill": "WITH " + elements("[1-3]") + f", filled AS (SELECT *, last_value(CASE WHEN tag <> 'a' THEN nullif({NON_TEXT('inner_html', '')}, '') END IGNORE NULLS) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM elements) SELECT page, pos, href, header FROM filled WHERE tag = 'a'",
    "repository_links": "WITH " + elements("[23]") + f", own AS (SELECT page, pos, href, {NON_TEXT('inner_html', ' ')} AS title FROM elements WHERE tag = 'a' AND contains(href, '/') AND length(href) - length(replace(href, '/', '')) >= 1), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY pos) AS INTEGER) AS nth FROM own WHERE title <> '') SELECT page, pos, nth, title, coalesce(nullif(regexp_extract(title, '\\((\\d{{4}})\\)', 1), ''), 'Unknown') AS year, {absolute('href')} AS pdf_url FROM ranked WHERE nth <= 3",
    "repository_links_all": "WITH " + elements("[23]") + f", own AS (SELECT page, pos, href, {NON_TEXT('inner_html', ' ')} AS title FROM elements WHERE tag = 'a' AND contains(href, '/') AND length(href) - length(replace(href, '/', '')) >= 1), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY pos) AS INTEGER) AS nth FROM own WHERE title <> '') SELECT page, pos, nth, title, coalesce(nullif(regexp_extract(title, '\\((\\d{{4}})\\)', 1), ''), 'Unknown') AS year, {absolute('href')} AS pdf_url FROM ranked WHERE nth <= 50",
    "election_pages": m(f"SELECT id AS page, CAST(1 AS INTEGER) AS pos, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS measure_text, CASE WHEN id % 5 <> 0 THEN 'March ' || (id % 28 + 1) || ', ' || year END AS election_date, CASE WHEN id % 5 <> 0 THEN 'General' END AS election_type, 'https://www.example.org/docs/' || id || '.pdf' AS pdf_url, CASE WHEN id % 5 <> 0 THEN CAST(year AS VARCHAR) ELSE coalesce(nullif(regexp_extract(title, '\\b(20\\d{{2}})\\b', 1), ''), '2026') END AS year FROM measures WHERE coalesce(title, '') <> ''"),
    "url_join": m(f"SELECT id, {absolute('href')} AS url FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'https://a.example/' || id WHEN 1 THEN '//b.example/' || id WHEN 2 THEN '/c/' || id ELSE 'd/' || id END AS href FROM measures)"),
    "union_by_name": m("SELECT id, title, NULL AS county FROM measures WHERE year = 1996 UNION ALL SELECT id, NULL, county FROM measures WHERE year = 1997 UNION ALL SELECT id, title, county FROM measures WHERE id < 5"),
    "union_by_name_all": m("SELECT id, CASE WHEN coalesce(year, 0) % 3 <> 1 THEN title END AS title, CASE WHEN coalesce(year, 0) % 3 <> 0 THEN county END AS county FROM measures"),
    "numeric_coerce": m("SELECT id, CASE id % 4 WHEN 2 THEN id + CAST(0.5 AS DOUBLE) END AS number, CASE id % 4 WHEN 0 THEN CAST(1234 AS DOUBLE) WHEN 2 THEN id + CAST(0.5 AS DOUBLE) END AS stripped, CASE id % 3 WHEN 0 THEN year END AS year FROM measures"),
    "icpsr_standard": m(f"SELECT id, year, measure_id, title, y AS yes_votes, CASE WHEN y + n > 0 THEN y + n END AS total_votes, p AS percent_yes, passed, CASE passed WHEN 1 THEN 'Pass' WHEN 0 THEN 'Fail' END AS pass_fail FROM (SELECT *, CASE WHEN y + n > 0 THEN CAST(p > 50 AS INTEGER) WHEN id % 5 = 0 THEN 1 WHEN id % 5 = 1 THEN 0 END AS passed FROM (SELECT *, {percent('y', '(y + n)', 100)} AS p FROM (SELECT id, year, measure_id, title, CASE WHEN id % 3 = 0 THEN yes_votes END AS y, CASE WHEN id % 3 = 0 THEN no_votes END AS n FROM measures WHERE id % 10 <> 9)))"),
    "ncsl_standard": m("SELECT id, year, title, description, topic_primary, passed, CASE passed WHEN 1 THEN 'Pass' WHEN 0 THEN 'Fail' END AS pass_fail FROM (SELECT id, CAST(year + 20 AS INTEGER) AS year, title, CASE WHEN id % 2 <> 0 THEN description END AS description, topic_primary, CASE WHEN id % 4 = 0 THEN 0 WHEN percent_yes IS NOT NULL THEN CAST(percent_yes > 50 AS INTEGER) END AS passed FROM measures WHERE id % 10 <> 9 AND year + 20 BETWEEN 2014 AND 2030)"),
    "ceda_standard": m(f"SELECT id, year, title, CAST(t AS BIGINT) AS total_votes, {percent('yes_votes', 't', 100)} AS percent_yes, passed FROM (SELECT id, year, coalesce(county || ' Measure ' || measure_letter, substr(ballot_question, 1, 100)) AS title, yes_votes, CASE WHEN id % 3 = 1 THEN total_votes ELSE coalesce(yes_votes, 0) + coalesce(no_votes, 0) END AS t, CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS passed FROM measures WHERE ballot_question IS NOT NULL OR measure_letter IS NOT NULL)"),
    "scrape_standard": m(f"SELECT id, title, CASE WHEN coalesce(title, '') = '' THEN NULL {identifier('title')} END AS measure_id, CASE WHEN id % 6 <> 0 THEN year END AS year, CASE WHEN id % 6 = 0 THEN 'Unknown' ELSE CAST(year AS VARCHAR) END AS year_raw, 'CA_SOS' AS data_source FROM measures"),
    "rejected_rows": m("SELECT id FROM measures WHERE id % 9 = 0 OR id % 8 = 0"),
    "run_summary": "SELECT event_type AS status, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS runs, count(DISTINCT user_id) AS sources FROM events GROUP BY 1, 2",
    "ceda_files": "WITH " + MEASURES.replace("measures AS", "base AS", 1) + f""", both_files AS (
 SELECT id, 2016 AS y, ballot_question, measure_letter, total_votes + 1 AS t, county, 1 AS passed FROM base WHERE id % 3 = 0
 UNION ALL SELECT id, 2018, ballot_question, measure_letter, coalesce(yes_votes, 0) + coalesce(no_votes, 0), county || ' \u00e9', 0 FROM base WHERE id % 3 = 1),
measures AS (SELECT id, CAST(id AS VARCHAR) AS measure_id, measure_letter, CAST(y AS INTEGER) AS year, county, CASE WHEN measure_letter IS NOT NULL THEN county || ' Measure ' || measure_letter ELSE substr(ballot_question, 1, 100) END AS title,
 CAST(NULL AS VARCHAR) AS description, ballot_question, CAST(t AS BIGINT) AS total_votes, CAST(passed AS INTEGER) AS passed, 'CEDA' AS data_source FROM both_files WHERE ballot_question IS NOT NULL OR measure_letter IS NOT NULL),
{KEYED} SELECT measure_id, year, county, title, total_votes, passed, fingerprint FROM keyed QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY year, id) = 1""",
    "icpsr_files": m("SELECT id, year, measure_id, title || ' \u00e9' AS title, CASE WHEN id % 6 = 0 THEN yes_votes END AS yes_votes FROM measures WHERE id % 10 <> 9"),
    "csv_sink": m("SELECT id, year, title, '[' || year || ',' || id || ']' AS pair FROM measures"),
    "json_sink": m("SELECT id, title, county, (SELECT count(*) FROM measures) AS total_measures, (SELECT count(*) FROM measures WHERE ballot_question <> '') AS measures_with_text FROM measures"),
    "backup_copy": m("SELECT id, title, percent_yes, '/backup_20240203_040506' AS name FROM measures"),
    "run_log": m("SELECT 'a' AS run_id, 'update' AS run_type, 'success' AS status, '2024-01-01T13:00:00' AS completed_at, CAST(NULL AS VARCHAR) AS error_message, count(*) AS measures_checked, CAST(2 AS BIGINT) AS new_measures, CAST(0 AS BIGINT) AS duplicates_found FROM measures UNION ALL SELECT 'b', 'update', 'completed_with_errors', NULL, '3 rows failed', 0, 0, 3 UNION ALL SELECT 'c', 'update', 'running', NULL, NULL, 0, 0, 0"),
    "export_latest": m("SELECT id, year, title FROM measures ORDER BY year DESC NULLS LAST, id LIMIT 10000"),
    "first_path": "SELECT count(*) AS n FROM orders",
    "metadata_sample": m("SELECT 'State,Year,MeasureID,Title,summary,Result,YES,NO,row_id' AS columns, count(*) AS sampled, count(*) FILTER (WHERE id % 10 <> 9) AS california FROM (SELECT id FROM measures ORDER BY id LIMIT 100)"),
    "parse_summary": m("SELECT count(*) AS total_measures, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years_covered, string_agg(DISTINCT county, ',' ORDER BY county) AS counties, count(yes_votes) AS measures_with_votes, count(*) FILTER (WHERE ballot_question <> '') AS measures_with_text FROM measures"),
    "time_text": m("SELECT id, strftime(CAST(updated_at AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || CASE WHEN id % 5 = 0 THEN ' x' ELSE '' END AS text, CASE WHEN id % 5 <> 0 THEN strftime(CAST(updated_at AS TIMESTAMP), '%Y-%m-%d') END AS back, format('{:,}', id * 1000) AS commas, substr(county, 1, 4) AS short FROM measures"),
    "sample_rows": m("SELECT id, title FROM measures ORDER BY id LIMIT 5"),
    "like_fallback": m(f"SELECT id, year FROM measures WHERE {ACTIVE} AND (contains(coalesce(title, ''), '?') OR contains(coalesce(description, ''), '?') OR contains(coalesce(ballot_question, ''), '?')) ORDER BY year DESC NULLS LAST, id LIMIT 30"),
    "enrichment_attempts": k(f"SELECT id, year, CAST({KIND_RANK} AS INTEGER) AS kind_rank FROM need WHERE {NEED} ORDER BY year DESC NULLS LAST, kind_rank, id LIMIT 10", NEED_TABLE),
    "enrich_measures": m(f"SELECT id, has_summary OR t IS NOT NULL AS has_summary, t AS summary_title FROM (SELECT id, has_summary, CASE {key_of(NAMING)} WHEN 'ACA 13' THEN 'Protect and Retain the Majority Vote Act' WHEN 'SCA 1' THEN 'Recall Process Reform' END AS t FROM measures)"),
    "cross_source_members": k("SELECT measure_fingerprint, id, data_source FROM keyed WHERE NOT is_duplicate QUALIFY count(*) OVER (PARTITION BY measure_fingerprint) > 1"),
    "dedupe_keyless": on("SELECT id, CASE WHEN is_duplicate THEN true WHEN id % 4 < 2 THEN false ELSE group_size > 1 AND id <> master END AS is_duplicate, CASE WHEN NOT is_duplicate AND id % 4 >= 2 AND group_size > 1 AND id <> master THEN master END AS master_id FROM ranked", KEYED, f"live AS (SELECT *, {SCORE} AS score FROM keyed), ranked AS (SELECT *, count(*) OVER g AS group_size, first_value(id) OVER (PARTITION BY is_duplicate, id % 4 >= 2, measure_fingerprint ORDER BY score DESC, id) AS master FROM live WINDOW g AS (PARTITION BY is_duplicate, id % 4 >= 2, measure_fingerprint))"),
    "insert_conflicts": b("SELECT i.id, i.fingerprint, coalesce(a, f) AS kept_id, 'Measure already exists: ' || i.fingerprint AS message FROM incoming i LEFT JOIN by_print USING (fingerprint) JOIN (SELECT fingerprint, min(id) AS f FROM incoming GROUP BY 1) USING (fingerprint) WHERE a IS NOT NULL OR i.id <> f"),
    "insert_result": b("SELECT id, title FROM existing UNION ALL SELECT id, title FROM (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1) WHERE fingerprint NOT IN (SELECT fingerprint FROM existing)"),
    "update_by_id": m("SELECT id, CASE WHEN id % 6 = 0 THEN 'New' ELSE title END AS title, CASE WHEN id % 6 <> 0 THEN description END AS description, CAST(1 + (id % 6 = 0)::INTEGER AS INTEGER) AS update_count, CASE WHEN id % 6 = 0 THEN '2001-12-31' ELSE CAST(CAST(updated_at AS DATE) AS VARCHAR) END AS updated_at FROM measures"),
    "repository_context": m("SELECT id AS page, CAST(1 AS INTEGER) AS nth, 'Proposition ' || id || ': ' || coalesce(title, 'None') AS measure_text, CAST(year AS VARCHAR) AS year, 'https://www.example.org/ca_ballot_props/a/b/' || id AS pdf_url FROM measures UNION ALL SELECT id, 2, 'Other', 'Unknown', 'https://www.example.org/ca_ballot_props/a/c/' || id FROM measures UNION ALL SELECT id, 3, 'Inner', CAST(year + 1 AS VARCHAR), 'https://www.example.org/ca_ballot_props/a/d/' || id FROM measures UNION ALL SELECT id, 4, 'Proposition 9: Bigd', '1911', 'https://www.example.org/ca_ballot_props/a/e/' || id FROM measures"),
}
ORACLES["quick_search"] = ORACLES["api_search"].replace(" AND year >= 1996 AND yes_votes IS NOT NULL ORDER BY score DESC, id LIMIT 50 OFFSET 5", " ORDER BY score DESC, id LIMIT 30")
ORACLES["ceda_workbooks"] = ORACLES["ceda_files"]

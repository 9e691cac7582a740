"""DuckDB SQL of registered queries, over the general tables as views."""

from __future__ import annotations

from ..functions import values as V

_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
_GENERIC = ", ".join(f"'{w}'" for w in V.GENERIC_TERMS)


def _words(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[0-9A-Za-z가-힣]+'), lambda w: length(w) >= 2 AND w NOT IN ({_STOP}))"


_STRIP = lambda x: rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"

_ARTICLES = """
articles AS (
  SELECT doc_id AS pos, source AS rule_name, lang AS division, CAST(doc_id AS VARCHAR) AS article_no,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS article_title,
    text AS body, CAST(doc_id AS VARCHAR) AS source_key, 'https://www.jnu.ac.kr/rule?mode=file&key=' || doc_id AS source_url
  FROM documents
)"""
_GATE = f"""
gated AS (
  SELECT doc_id, source, text, sha256(concat_ws(chr(31), {_STRIP('source')}, '1',
      CASE WHEN {_STRIP('title')} IN ('시행일', '경과조치', '종전지침 폐지', '재검토기한') OR starts_with(ltrim(text), '부칙') THEN '부칙' ELSE '본칙' END,
      {_STRIP('title')}, {_STRIP('text')})) AS h,
    CASE WHEN {_STRIP('text')} = '' THEN 'empty_body' WHEN length({_STRIP('text')}) > 30000 THEN 'oversized_body' END AS own
  FROM (SELECT *, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title FROM documents)
), judged AS (
  SELECT *, coalesce(own, CASE WHEN row_number() OVER (PARTITION BY source, substr(h, 1, 16), own IS NULL ORDER BY doc_id) > 1 THEN 'duplicate_record' END, 'accepted') AS reason FROM gated
)"""
_INDEX = f"""
tok AS (
  SELECT pos AS doc_id, rule_name, {_words("concat_ws(' ', rule_name, division, article_no, article_title, body)")} AS t,
    {_words('rule_name')} AS tn, {_words('article_title')} AS tt, {_words('division')} AS td FROM articles
), lens AS (
  SELECT doc_id, rule_name, len(t) AS length FROM tok
), totals AS (
  SELECT count(*) AS n, avg(length) AS av FROM lens
), terms AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM terms GROUP BY term
), q AS (
  SELECT item_id AS query_id, text AS query FROM benchmark
), qt AS (
  SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_words('query')}) AS term FROM q) GROUP BY ALL
), asked AS (
  SELECT query_id, term, qf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM qt JOIN df USING (term) CROSS JOIN totals
)"""
_ROUTES = f"""
prof AS (
  SELECT rule_name, term, sum(w) AS weight FROM (
    SELECT rule_name, unnest(tn) AS term, 3 AS w FROM tok UNION ALL SELECT rule_name, unnest(td), 1 FROM tok UNION ALL SELECT rule_name, unnest(tt), 2 FROM tok) GROUP BY ALL
), rs AS (
  SELECT query_id, rule_name, round(sum(idf * least(weight, 6) * qf), 9) AS score, bool_or(term NOT IN ({_GENERIC})) AS core FROM prof JOIN asked USING (term) GROUP BY ALL
), rk AS (
  SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM rs WHERE core AND score > 0
), passed AS (
  SELECT query_id, rule_name FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS c FROM rk WHERE rank <= 5) WHERE c <= 30
)"""
_SCORED = f"""
met AS (
  SELECT query_id, doc_id, l.rule_name, term, idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l.length / av))) * qf
      + CASE WHEN list_contains(tn, term) THEN 2.8 * idf ELSE 0 END + CASE WHEN list_contains(tt, term) THEN 2.0 * idf ELSE 0 END + CASE WHEN list_contains(td, term) THEN 1.2 * idf ELSE 0 END AS part
  FROM terms JOIN asked USING (term) JOIN lens l USING (doc_id) JOIN tok USING (doc_id) CROSS JOIN totals
), scored AS (
  SELECT query_id, doc_id, any_value(rule_name) AS rule_name, round(sum(part), 9) AS score, list_sort(list(DISTINCT term)) AS matched FROM met GROUP BY query_id, doc_id
), core AS (
  SELECT query_id, list_filter(list_distinct({_words('query')}), lambda w: w NOT IN ({_GENERIC})) AS core FROM q
), relevant AS (
  SELECT s.*, len(list_filter(core, lambda w: list_contains(matched, w))) AS hits, len(core) AS n_core FROM scored s JOIN core USING (query_id)
), chosen AS (
  SELECT r.*, p.rule_name IS NOT NULL AS routed, bool_or(p.rule_name IS NOT NULL) OVER (PARTITION BY r.query_id) AS any_routed
  FROM relevant r LEFT JOIN passed p ON r.query_id = p.query_id AND r.rule_name = p.rule_name WHERE hits >= 1 AND hits >= 0.4 * n_core AND score > 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM chosen WHERE routed OR NOT any_routed
), top AS (
  SELECT * FROM ranked WHERE rank <= 20
)"""
_VERSIONED = """
ver AS (
  SELECT doc_id, source AS base, source || CASE WHEN doc_id % 3 = 0 THEN ' (2012. 1. 2. 개정)' WHEN doc_id % 7 = 0 THEN ' (개정 전)' ELSE '' END AS rule_name,
    doc_id % 50 AS no, doc_id % 3 = 0 OR doc_id % 7 = 0 AS noted FROM documents
)"""
_DAMAGE = f"""
cut AS (
  SELECT doc_id, lang, string_split(replace(text, ', ', '?'), '?') AS p FROM documents
), mark AS (
  SELECT doc_id, lang, i, p[i] AS piece, CASE WHEN p[i] <> '' THEN right(p[i], 1) WHEN i = 1 THEN chr(10) ELSE '?' END AS before,
    CASE WHEN p[i + 1] <> '' THEN left(p[i + 1], 1) WHEN i + 1 < len(p) THEN '?' ELSE '' END AS after FROM (SELECT *, unnest(range(1, len(p))) AS i FROM cut)
), judged AS (
  SELECT doc_id, lang, i, CASE
    WHEN regexp_full_match(before, '[0-9A-Za-z가-힣]') AND regexp_full_match(after, '[0-9A-Za-z가-힣]') THEN '{V.DAMAGE_DOT}'
    WHEN before = chr(10) OR (before = ' ' AND ends_with(rtrim(piece, ' '), chr(10))) THEN CASE WHEN after IN (' ', chr(160)) THEN '{V.DAMAGE_MARK}' ELSE '{V.DAMAGE_QUOTE}' END
    WHEN regexp_full_match(after, '[가-힣A-Za-z]') THEN '{V.DAMAGE_QUOTE}' END AS kind FROM mark
), kinds AS (
  SELECT doc_id, lang, kind, min(i) AS first, count(*) AS n FROM judged WHERE kind IS NOT NULL GROUP BY ALL
)"""
_VALID = """
o AS (
  SELECT 'rule ' || o_custkey AS rule_name, o_orderkey AS place, strftime(o_orderdate, '%Y-%m-%d') AS day,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders
), dated AS (
  SELECT rule_name, place, CASE WHEN n > 1 THEN day END AS revised_on FROM o
), valid AS (
  SELECT rule_name, place,
    CASE WHEN revised_on IS NOT NULL THEN lag(revised_on) OVER (PARTITION BY rule_name ORDER BY revised_on ASC NULLS LAST, place) ELSE max(revised_on) OVER (PARTITION BY rule_name) END AS valid_from,
    revised_on AS valid_until FROM dated
)"""
_NAME = lambda k: f"'고객' || translate(CAST({k} AS VARCHAR), '0123456789', '가나다라마바사아자차') || ' 규정'"
_EDGES = f"""
art AS (
  SELECT o_orderkey AS k, o_custkey AS c, 'r-' || o_orderkey AS record_id, {_NAME('o_custkey')} AS rule_name, '제' || o_orderkey || '조' AS article_no FROM orders
), rules AS (
  SELECT DISTINCT rule_name FROM art
), own AS (
  SELECT a.record_id AS src_id, 'same_rule' AS kind, '제' || (a.k + 1) || '조' AS raw, a.rule_name AS tr, '제' || (a.k + 1) || '조' AS ta, t.record_id AS dst
  FROM art a LEFT JOIN art t ON t.rule_name = a.rule_name AND t.k = a.k + 1
), other AS (
  SELECT a.record_id AS src_id, CASE WHEN r.rule_name IS NULL THEN 'external_law_unmatched' ELSE 'cross_rule' END AS kind, '「' || {_NAME('a.c + 1')} || '」 제' || (a.k % 97 + 1) || '조' AS raw,
    r.rule_name AS tr, '제' || (a.k % 97 + 1) || '조' AS ta, t.record_id AS dst
  FROM art a LEFT JOIN rules r ON r.rule_name = {_NAME('a.c + 1')} LEFT JOIN art t ON t.rule_name = r.rule_name AND t.k = a.k % 97 + 1
), edges AS (
  SELECT src_id, kind, raw, CASE WHEN dst IS NOT NULL THEN tr END AS target_rule, CASE WHEN dst IS NOT NULL THEN ta END AS target_article, dst IS NOT NULL AS resolved, dst AS dst_id FROM own
  UNION ALL SELECT src_id, kind, raw, CASE WHEN dst IS NOT NULL THEN tr END, CASE WHEN dst IS NOT NULL THEN ta END, dst IS NOT NULL, dst FROM other
  UNION ALL SELECT record_id, 'external_law', '｢상법｣ 제3조', NULL, NULL, false, NULL FROM art
)"""
_LISTING = """
listed AS (
  SELECT d.doc_id AS key, 'doc ' || lpad(CAST(d.doc_id AS VARCHAR), 9, '0') AS name, source AS division, coalesce(l.quality, 1) = 1 AS is_current,
    d.doc_id IN (SELECT doc_id FROM labels) AS have FROM documents d LEFT JOIN labels l USING (doc_id)
), cov AS (
  SELECT division, count(*) AS posted, count(*) FILTER (have) AS collected, round(count(*) FILTER (have) / count(*), 4) AS rate,
    count(*) FILTER (is_current) AS current_posted, count(*) FILTER (is_current AND have) AS current_collected,
    round(count(*) FILTER (is_current AND have) / nullif(count(*) FILTER (is_current), 0), 4) AS current_rate,
    sha256(coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT have), '')) AS missing, grouping(division) AS is_total
  FROM listed GROUP BY ROLLUP (division)
)"""
_PLAIN = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[0-9A-Za-z가-힣]+'), lambda w: length(w) >= 2))"
_CATEGORIES = f"""
cat AS (
  SELECT * FROM (VALUES
    (0, 'INT-01', 'the edition the edition issue the edition? tionan and of the', ['the edition', 'and', 'of the']),
    (1, 'INT-02', 'der einung der einung issue der einung? der und die erheit', ['der einung', 'und die', 'erheit']),
    (2, 'INT-03', 'le mentre le mentre issue le mentre? la et les éreoi', ['le mentre', 'et les', 'éreoi'])) t(place, code, doc, phrases)
), hit AS (
  SELECT doc_id AS query_id, code, place, list_sort(list_intersect({_PLAIN('text')}, {_PLAIN('doc')})) AS exact,
    len(list_filter(phrases, lambda p: contains(lower(text), p))) AS phrase_hits FROM documents CROSS JOIN cat
), cs AS (
  SELECT query_id, code, place, CAST(len(exact) * 2.0 + phrase_hits * 3.0 AS DOUBLE) AS score, exact, phrase_hits FROM hit
)"""
_QUESTION = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"

SQL: dict[str, str] = {
    "l10_damage": f"WITH {_DAMAGE} SELECT doc_id, CAST(sum(n) AS INTEGER) AS suspect_marks, string_agg(kind, ',' ORDER BY first) AS kinds FROM kinds GROUP BY doc_id",
    "a18_damage_inventory": f"WITH {_DAMAGE} SELECT kind, CASE WHEN starts_with(lang, '{V.REGULATION_PREFIX}') THEN 'regulation' ELSE 'guideline' END AS tier, count(*) AS n FROM kinds GROUP BY ALL",
    "l2_identity": f"WITH {_ARTICLES}, h AS (SELECT pos, source_key, CASE WHEN {_STRIP('article_title')} IN ('시행일', '경과조치', '종전지침 폐지', '재검토기한') OR starts_with(ltrim(body), '부칙') THEN '부칙' ELSE '본칙' END AS kind, article_no, article_title, body FROM articles), i AS (SELECT pos, source_key, kind, substr(sha256(concat_ws(chr(31), source_key, article_no, kind, {_STRIP('article_title')}, {_STRIP('body')})), 1, 16) AS id FROM h) SELECT pos AS doc_id, 'rule-' || source_key || '-' || id AS record_id, kind || '-' || substr(id, 1, 12) AS revision FROM i",
    "l3_gate": f"WITH {_GATE} SELECT doc_id, reason FROM judged",
    "l4_official_url": "SELECT page_id, coalesce(starts_with(url, 'https://') AND ((regexp_extract(url, '^https://([^/?#]+)', 1) || '.' LIKE '%.example.com.') OR (regexp_extract(url, '^https://([^/?#]+)', 1) || '.' LIKE '%.example.net.')) AND len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: starts_with(p, 'page='))) = 1 AND list_contains(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), 'page=2'), false) AS official FROM pages",
    "a12_rejects_by_reason": f"WITH {_GATE} SELECT reason, count(*) AS n FROM judged WHERE reason <> 'accepted' GROUP BY reason",
    "l14_review_queue": f"WITH {_GATE} SELECT doc_id + 1 AS row, reason, source AS rule_name, source AS source_key FROM judged WHERE reason <> 'accepted'",
    "l5_versions": f"WITH {_VERSIONED}, cur AS (SELECT DISTINCT base, no FROM ver WHERE NOT noted) SELECT doc_id, NOT noted AS is_current, noted AND c.base IS NOT NULL AS has_successor, doc_id % 11 = 0 AS is_repealed, CASE WHEN doc_id % 11 = 0 THEN '2013-07-05' END AS repealed_date FROM ver LEFT JOIN cur c ON c.base = ver.base AND c.no = ver.no",
    "l8_repealed_parts": "SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN '②' ELSE '③' END AS clause, CASE doc_id % 2 WHEN 0 THEN '2020-06-03' END AS clause_date, CASE doc_id % 2 WHEN 0 THEN '②' ELSE '③' END AS item_clause, CASE doc_id % 2 WHEN 0 THEN '3' ELSE '7' END AS item, CASE doc_id % 2 WHEN 0 THEN '2024-03-22' ELSE '2021-01-02' END AS item_date FROM documents",
    "t1_words": f"SELECT word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word FROM documents) GROUP BY word",
    "t4_query_words": f"WITH q AS (SELECT item_id AS query_id, {_words('text')} AS w FROM benchmark), d AS (SELECT query_id, unnest(list_distinct(w)) AS word, w FROM q) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_position(w, word)) - 1 AS INTEGER) AS place, word FROM d",
    "t6_normal_questions": f"SELECT conv_id * 1000 + turn AS ts, {_QUESTION} AS normalized FROM conversations WHERE role = 'user'",
    "a1_term_statistics": f"WITH {_ARTICLES}, {_INDEX} SELECT term, df FROM df",
    "a1_lengths": f"WITH {_ARTICLES}, {_INDEX} SELECT doc_id, length FROM lens",
    "a2_rule_profiles": f"WITH {_ARTICLES}, {_INDEX}, {_ROUTES} SELECT rule_name, term, CAST(weight AS BIGINT) AS weight FROM prof",
    "r1_idf": f"WITH {_ARTICLES}, {_INDEX} SELECT query_id, term, qf, round(idf, 4) AS idf FROM asked",
    "r2_routes": f"WITH {_ARTICLES}, {_INDEX}, {_ROUTES} SELECT query_id, rule_name FROM passed",
    "r3_top5_documents": f"WITH {_ARTICLES}, {_INDEX}, s AS (SELECT query_id, doc_id, round(round(sum(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / av))) * qf), 9), 4) AS score FROM terms JOIN asked USING (term) JOIN lens USING (doc_id) CROSS JOIN totals GROUP BY ALL), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s) SELECT * FROM r WHERE rank <= 5",
    "r6_search": f"WITH {_ARTICLES}, {_INDEX}, {_ROUTES}, {_SCORED} SELECT query_id, rank, doc_id, round(score, 4) AS score, CASE WHEN any_routed THEN 'rule-first' ELSE 'full-scan' END AS routing, array_to_string(matched, ' ') AS matched FROM top WHERE rank <= 5",
    "r7_attachment_gate": f"WITH {_ARTICLES}, {_INDEX}, {_ROUTES}, {_SCORED}, g AS (SELECT *, doc_id % 4 = 0 AS att, count(*) FILTER (doc_id % 4 <> 0) OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM top), l AS (SELECT *, max(rank) FILTER (NOT att AND nth <= 5) OVER (PARTITION BY query_id) AS last FROM g) SELECT query_id, doc_id, CASE WHEN att THEN 'omitted' ELSE 'result' END AS part FROM l WHERE (NOT att AND nth <= 5) OR (att AND (last IS NULL OR rank < last))",
    "r9_hints": f"WITH {_ARTICLES}, {_INDEX}, {_ROUTES}, {_SCORED}, n AS (SELECT query_id, count(*) AS n FROM top WHERE rank <= 5 GROUP BY query_id), gap AS (SELECT DISTINCT query_id FROM qt WHERE term NOT IN (SELECT term FROM df)) SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM gap) THEN 'no_such_concept' ELSE 'cross_reference' END AS hint FROM q LEFT JOIN n USING (query_id) WHERE coalesce(n, 0) <= 1",
    "t7_unmatched_words": f"WITH {_ARTICLES}, {_INDEX} SELECT query_id, term AS word FROM qt WHERE term NOT IN (SELECT term FROM df)",
    "f7_attachment_summary": "SELECT doc_id, substr('<table><tr>' || text, 1, 200) AS body, length(text) + 11 > 200 AS body_cut, CAST(length(text) + 11 AS BIGINT) AS body_length, CAST(1 AS BIGINT) AS n_tables, CAST(1 AS BIGINT) AS n_rows FROM documents",
    "f9_citations": f"WITH {_ARTICLES} SELECT pos AS doc_id, sha256('[' || rule_name || ' ' || article_no || CASE WHEN trim(article_title) <> '' THEN ' (' || article_title || ')' ELSE '' END || ']' || chr(10) || body || chr(10) || '출처: ' || source_url) AS cited FROM articles",
    "a3_corpus_stats": "SELECT count(*) FILTER (length(text) <= 30000) AS n_articles, count(DISTINCT source) FILTER (length(text) <= 30000) AS n_rules, count(*) FILTER (length(text) > 30000) AS n_rejected, '2024-01-01' AS first_collected, '2024-01-01' AS last_collected FROM documents",
    "a4_rules_list": "SELECT source AS rule_name, arg_min(lang, doc_id) AS division, CAST(min(doc_id) AS VARCHAR) AS source_key, 'guideline' AS tier, count(*) AS n_articles FROM documents GROUP BY source",
    "a5_coverage": f"WITH {_LISTING} SELECT division, posted, collected, rate, current_posted, current_collected, current_rate, missing FROM cov",
    "a6_coverage_gaps": f"WITH {_LISTING} SELECT division, division || ': ' || current_collected || ' / ' || current_posted AS gap FROM cov WHERE is_total = 0 AND current_rate < 1",
    "j11_not_collected": "SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "a7_distribution": "SELECT lang AS value, count(*) AS n, round(count(*) / max(count(*)) OVER (), 4) AS share_of_peak FROM documents GROUP BY lang",
    "a8_duplicate_titles": f"WITH {_ARTICLES} SELECT rule_name, article_title, count(*) AS n, string_agg(article_no, ',' ORDER BY article_no) AS numbers FROM articles WHERE trim(article_title) <> '' GROUP BY ALL HAVING count(*) > 1",
    "a10_candidates": f"WITH c AS (SELECT conv_id * 1000 + turn AS ts, text, {_QUESTION} AS nq FROM conversations WHERE role = 'user' AND conv_id % 2 <> 0) SELECT nq AS normalized_question, arg_min(text, ts) AS question, count(*) AS asked_count, min(ts) AS created_at, CASE WHEN count(*) > 1 THEN max(ts) END AS updated_at, 'pending' AS status FROM c GROUP BY nq",
    "a11_sequence_ids": "SELECT conv_id * 1000 + turn AS ts, 'q-' || CASE WHEN row_number() OVER (ORDER BY conv_id * 1000 + turn) < 1000 THEN lpad(CAST(row_number() OVER (ORDER BY conv_id * 1000 + turn) AS VARCHAR), 4, '0') ELSE CAST(row_number() OVER (ORDER BY conv_id * 1000 + turn) AS VARCHAR) END AS id FROM conversations WHERE role = 'user'",
    "a16_contents_counts": "SELECT source AS rule_name, count(*) FILTER (doc_id % 5 <> 0) AS n_main, count(*) FILTER (doc_id % 5 = 0) AS n_addenda FROM documents GROUP BY source",
    "a20_failures": "SELECT substr('timeout of user ' || user_id, 1, 40) AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "r12_contents": "SELECT source AS rule_name, row_number() OVER (PARTITION BY source ORDER BY doc_id % 9 = 0, doc_id % 37, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 ELSE 0 END, doc_id) AS rank, doc_id FROM documents",
    "r16_recent": "SELECT conv_id * 1000 + turn AS ts, text AS question FROM conversations WHERE role = 'user' ORDER BY ts DESC LIMIT 20",
    "r15_candidate_order": f"WITH c AS (SELECT conv_id * 1000 + turn AS ts, {_QUESTION} AS nq FROM conversations WHERE role = 'user' AND conv_id % 2 <> 0) SELECT nq AS normalized_question, count(*) AS asked_count, min(ts) AS created_at FROM c GROUP BY nq ORDER BY asked_count DESC, created_at LIMIT 20",
    "j10_trusted_sources": "WITH l AS (SELECT conv_id * 1000 + turn AS id FROM conversations WHERE role = 'user'), x AS (SELECT id, unnest(range(1, 4)) AS i FROM l), y AS (SELECT id, i, (id % 700) * i AS d FROM x), z AS (SELECT id, min(i) AS i, d FROM y GROUP BY id, d), s AS (SELECT id, string_agg('doc-' || d || '/' || source || '/' || lang, ',' ORDER BY i) AS sources FROM z JOIN documents ON doc_id = d GROUP BY id) SELECT id, sources FROM l LEFT JOIN s USING (id)",
    "l13_ledger": "SELECT substr(sha256(source), 1, 16) AS corpus_fingerprint, count(*) AS accepted FROM documents GROUP BY source",
    "e21_validity": f"WITH {_VALID} SELECT * FROM valid",
    "j9_as_of": f"WITH {_VALID}, p AS (SELECT o_orderkey AS probe_id, 'rule ' || o_custkey AS rule_name, strftime(CAST(o_orderdate AS DATE) - 180, '%Y-%m-%d') AS date FROM orders), m AS (SELECT p.probe_id, p.rule_name, p.date, v.place, v.valid_from, v.valid_until, row_number() OVER (PARTITION BY p.probe_id ORDER BY v.place) AS n FROM p LEFT JOIN valid v ON p.rule_name = v.rule_name AND (v.valid_from IS NULL OR v.valid_from <= p.date) AND (v.valid_until IS NULL OR p.date < v.valid_until)) SELECT probe_id, rule_name, date, place, valid_from, valid_until FROM m WHERE n = 1",
    "v1_resolve_names": "WITH names AS (SELECT lower(n_name) || ' rule' AS rule_name FROM nation), a AS (SELECT n_nationkey AS query_id, 'what does ' || lower(n_name) || ' rule say' AS t FROM nation), b AS (SELECT query_id, arg_max(rule_name, length(rule_name)) AS rule_name FROM a JOIN names ON contains(t, rule_name) GROUP BY query_id), c AS (SELECT r_regionkey + 100 AS query_id, 'nation_' || r_regionkey AS t FROM region), d AS (SELECT query_id, CASE WHEN count(rule_name) = 1 THEN any_value(rule_name) END AS rule_name FROM c LEFT JOIN names ON contains(rule_name, t) GROUP BY query_id) SELECT query_id, rule_name FROM a LEFT JOIN b USING (query_id) UNION ALL SELECT * FROM d",
    "e22_revision_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS revised_on FROM orders",
    "g4_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "g9_inbound": f"WITH {_EDGES} SELECT dst_id AS record_id, count(*) AS n FROM edges WHERE resolved GROUP BY dst_id",
    "g11_reachable": f"WITH {_EDGES}, h AS (SELECT k AS query_id, record_id FROM art) SELECT query_id, record_id FROM h UNION SELECT query_id, dst_id FROM h JOIN edges ON src_id = record_id WHERE resolved",
    "c2_scores": f"WITH {_CATEGORIES} SELECT query_id, code, score, array_to_string(exact, ' ') AS exact, CAST(phrase_hits AS BIGINT) AS phrase_hits FROM cs",
    "c3_decisions": f"WITH {_CATEGORIES}, r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS nxt FROM cs WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, place)), d AS (SELECT *, score >= 10 AND phrase_hits >= 2 AND score - coalesce(nxt, 0) >= 3 AS high FROM r WHERE n = 1) SELECT query_id, CASE WHEN len(exact) >= 2 OR high THEN code END AS code, round(score, 2) AS score, CASE WHEN high THEN 'high' WHEN len(exact) >= 2 THEN 'medium' END AS confidence, len(exact) >= 2 OR high AS matched FROM d",
    "p3_redact_email": "SELECT doc_id, sha256(regexp_replace(text, '[0-9A-Za-z._%+-]+@[0-9A-Za-z.-]+\\.[A-Za-z]{2,}', '[이메일 마스킹]', 'g')) AS masked, CAST(regexp_matches(text, '[0-9A-Za-z._%+-]+@[0-9A-Za-z.-]+\\.[A-Za-z]{2,}') AS BIGINT) AS n_kinds FROM documents",
    "e1_split_articles": "SELECT CAST(p_partkey AS VARCHAR) AS source_key, CAST(0 AS BIGINT) AS place, '제1조' AS article_no, p_name AS article_title, p_brand || chr(10) || '둘째 줄' AS body FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, '제2조의3', p_type, '끝' FROM part",
    "e10_items": "SELECT CAST(p_partkey AS VARCHAR) AS source_key, '1.' AS article_no, p_name AS article_title, '가' || chr(10) || '5. x' AS body FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), '2.', p_type, '나' FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), '3.', p_brand, '다' FROM part",
    "e7_attachments": "SELECT CAST(p_partkey AS VARCHAR) AS source_key, '별표 1' AS label, p_type AS title, '긴 본문 ' || p_name AS body FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), '별표 2', '서식', p_brand FROM part",
    "e12_structure": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem) SELECT CAST(l_orderkey AS VARCHAR) AS rule_name, l_orderkey * 10 + n AS pos, CASE WHEN max(CASE WHEN n = 5 THEN 1 END) OVER w IS NOT NULL THEN '제2장 학사' WHEN max(CASE WHEN n = 1 THEN 1 END) OVER w IS NOT NULL THEN '제1장 총칙' END AS chapter, CASE WHEN n > 3 AND max(CASE WHEN n = 5 THEN 1 END) OVER w IS NULL AND max(CASE WHEN n = 3 THEN 1 END) OVER w IS NOT NULL THEN '제2절 뒤' END AS section, '글' AS body FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)",
    "e3_clean_names": "SELECT p_partkey, p_name || ' 규정' AS name FROM part",
    "e4_keys": "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS key FROM pages",
    "s5_links": "SELECT page_id AS doc, CAST(page_id AS VARCHAR) AS key, '이름 지침' AS name, '학생' AS division FROM pages",
    "set_operations": "SELECT 'both' AS part, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'only', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'all', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)",
    "windowed_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(round(sum(value), 4), 2) AS total FROM events GROUP BY ALL",
}

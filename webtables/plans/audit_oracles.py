"""DuckDB oracles for audits, link graph, set operations and chat."""

from __future__ import annotations

from webtables.plans.oracles import DECODE, HOST, ORIGIN, SCHEME, _text_sql
from webtables.sources.derived import AUDIT_CASES

T = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
TITLE = DECODE.format(x=T)
NA = "len(regexp_extract_all(html, '<a\\s[^>]*href='))"

GRAPH = """
np AS (SELECT count(*) AS n FROM pages),
gl AS (
  SELECT s.page_id AS src_page_id, s.url AS src_url, d.url AS dst_url FROM pages s, np, pages d
  WHERE s.page_id % 3 <> 0 AND d.page_id = (7 * s.page_id + 3) % np.n
  UNION ALL
  SELECT page_id, url, 'https://gone.example.com/' || page_id FROM pages WHERE page_id % 5 = 0)"""


def NORM(u: str) -> str:
    rest = f"regexp_replace(regexp_replace(regexp_replace({u}, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '/(\\?|$)', '\\1')"
    return f"({SCHEME.format(u=u)} || '://' || {HOST.format(u=u)} || {rest})"


AWAY = f"WHERE {HOST.format(u='dst_url')} IS DISTINCT FROM {HOST.format(u='src_url')}"

ANSWERS = """
np2 AS (SELECT count(*) AS n FROM pages),
asst AS (
  SELECT conv_id, turn, text,
         lag(len(string_split_regex(trim(text), '\\s+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_words,
         role FROM conversations),
cit AS (
  SELECT a.conv_id, a.turn, CAST(i AS INT) AS rank, p.url
  FROM (SELECT * FROM asst WHERE role = 'assistant') a, np2, (SELECT unnest(range(0, 3)) AS i) r, pages p
  WHERE p.page_id = (a.conv_id + a.turn + i) % np2.n)"""

WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))"

ORACLES: dict[str, str] = {
    "g1_seo_audit": f"""
WITH b AS (SELECT page_id, url, {TITLE} AS title, len(regexp_extract_all(html, '<h1>')) AS h1, {NA} AS na FROM pages),
c AS (SELECT page_id, title <> '' AS title_present, length(title) BETWEEN 50 AND 60 AS title_length_ok,
             h1 = 1 AS single_h1, true AS heading_order, true AS image_alt, na > 0 AS internal_links,
             {SCHEME.format(u='url')} = 'https' AS https, false AS viewport FROM b)
SELECT *, CAST(title_present::INT + title_length_ok::INT + single_h1::INT + heading_order::INT + image_alt::INT
               + internal_links::INT + https::INT AS INT) AS passed, 18 AS checks,
       round(100.0 * (title_present::INT + title_length_ok::INT + single_h1::INT + heading_order::INT + image_alt::INT
               + internal_links::INT + https::INT) / 18, 2) AS score FROM c""",
    "g2_link_audit": f"""
SELECT page_id, CAST({NA} AS INT) AS links, CAST({NA} AS INT) AS internal, 0 AS external,
       CAST(len(regexp_extract_all(html, '<a\\s[^>]*href="[^"]*"[^>]*>\\s*</a>')) AS INT) AS missing_text,
       0 AS nofollow, false AS excessive_external FROM pages""",
    "j3_broken_links": f"""WITH {GRAPH.strip()},
pn AS (SELECT DISTINCT {NORM('url')} AS n FROM pages)
SELECT src_page_id, dst_url, 'unknown' AS reason FROM gl WHERE {NORM('dst_url')} NOT IN (SELECT n FROM pn)""",
    "j7_orphan_pages": f"""WITH {GRAPH.strip()},
t AS (SELECT DISTINCT {NORM('gl.dst_url')} AS n FROM gl JOIN pages s ON s.page_id = gl.src_page_id
      WHERE {NORM('gl.dst_url')} <> {NORM('s.url')})
SELECT page_id FROM pages WHERE {NORM('url')} NOT IN (SELECT n FROM t)""",
    "a15_linked_domains": f"""WITH {GRAPH.strip()}
SELECT {HOST.format(u='dst_url')} AS host, count(*) AS links, count(DISTINCT src_page_id) AS pages,
       count(*) FILTER ({AWAY}) AS external_links, count(DISTINCT src_page_id) FILTER ({AWAY}) AS external_pages
FROM gl GROUP BY 1""",
    "j6_host_rule_join": f"""
WITH r(rule) AS (VALUES ('.example.org'), ('example.net'), ('spam-farm.example.org')),
h AS (SELECT page_id, {HOST.format(u='url')} AS host FROM pages)
SELECT page_id, rule FROM h, r
WHERE host = rule OR (rule LIKE '.%' AND host LIKE '%' || rule) OR host LIKE '%.' || rule""",
    "p7_host_rule_filter": f"""
WITH h AS (SELECT page_id, {HOST.format(u='url')} AS host FROM pages)
SELECT page_id, (host = '.example.org' OR host LIKE '%.example.org' OR host LIKE '%..example.org'
                 OR host = 'example.net' OR host LIKE '%.example.net'
                 OR host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org') AS matched FROM h""",
    "u1_merge_host_lists": f"""
SELECT {HOST.format(u='url')} AS host FROM pages
UNION SELECT * FROM (VALUES ('example.org'), ('example.net'), ('spam-farm.example.org')) t(host)""",
    "g3_metadata_coverage": f"""
SELECT {HOST.format(u='url')} AS host, count(*) AS pages,
       round(avg(CASE WHEN {TITLE} <> '' THEN 1.0 ELSE 0.0 END), 4) AS title,
       0.0 AS description, 0.0 AS viewport,
       round(avg(CASE WHEN html LIKE '%<meta charset=%' THEN 1.0 ELSE 0.0 END), 4) AS charset,
       0.0 AS robots, 0.0 AS canonical, 0.0 AS alternate, 0.0 AS open_graph, 0.0 AS twitter,
       0.0 AS json_ld, 0.0 AS schema_org
FROM pages GROUP BY 1""",
    "g4_accessibility": """
WITH t AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1) AS texts, html FROM pages)
SELECT page_id, 0 AS images_without_alt,
       CAST(len(list_filter(texts, lambda x: lower(trim(x)) IN ('click here', 'here', 'read more', 'more', 'link', 'this', 'click'))) AS INT) AS generic_link_text,
       0 AS inputs_without_label, 0 AS heading_skips, false AS skip_link,
       html LIKE '%<nav%' AS has_nav, html LIKE '%<main%' AS has_main, html LIKE '%<footer%' AS has_footer
FROM t""",
    "g6_page_profile": """
SELECT page_id,
  CAST(len(regexp_extract_all(html, '<p>')) + len(regexp_extract_all(html, '<h1>')) + len(regexp_extract_all(html, '<article>')) AS INT) AS main_content,
  CAST(len(regexp_extract_all(html, '<nav>')) + len(regexp_extract_all(html, '<a\\s')) AS INT) AS navigation,
  CAST(len(regexp_extract_all(html, '<meta\\s')) + len(regexp_extract_all(html, '<title>')) AS INT) AS metadata,
  0 AS media, 0 AS forms
FROM pages""",
    "l4_top_sources": f"""WITH {ANSWERS.strip()},
c AS (SELECT conv_id AS topic, {HOST.format(u='url')} AS host, count(*) AS citations FROM cit GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY citations DESC, host) AS INT) AS rank FROM c)
SELECT * FROM r WHERE rank <= 3""",
    "w2_prompt_preview": """
WITH g AS (SELECT conv_id, bool_or(role = 'user') AS has_user,
                  arg_max(text, turn) FILTER (WHERE role = 'user') AS last FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, has_user, regexp_replace(trim(coalesce(last, ''), ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g') AS x FROM g)
SELECT conv_id, CASE WHEN NOT has_user THEN '(no prompt)' WHEN length(x) > 80 THEN left(x, 77) || '...' ELSE x END AS prompt FROM c""",
    "w3_last_user_message": """
SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS prompt FROM conversations GROUP BY conv_id""",
    "a11_token_usage": f"""WITH {ANSWERS.strip()},
a AS (SELECT coalesce(prev_words, 0) AS p, len(string_split_regex(trim(text), '\\s+')) AS c FROM asst WHERE role = 'assistant')
SELECT count(*) AS answers, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens,
       CAST(sum(p + c) AS BIGINT) AS total_tokens FROM a""",
    "c1_citations": f"""WITH {ANSWERS.strip()}
SELECT cit.conv_id, cit.turn, cit.rank, cit.url, p.page_id FROM cit LEFT JOIN pages p ON p.url = cit.url""",
}
ORACLES["h13_answer_log_url"] = ("WITH w AS (" + ORACLES["w2_prompt_preview"] + ") "
                                 "SELECT conv_id, 'perplexity://sonar  \"' || prompt || '\"' AS url FROM w")
ORACLES["g5_extract_documents"] = """
WITH p(type, pat) AS (VALUES
  ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'),
  ('phone', '[0-9]{4}-[0-9]{2}-[0-9]{2}([^0-9]|$)|\\+?[0-9][0-9 ().-]{7,}[0-9]'),
  ('price', '[$€£] ?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:[.,][0-9]{1,2})?'),
  ('date', '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}'),
  ('number', '(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:[.,][0-9]+)?%?')),
m AS (SELECT doc_id, type, unnest(regexp_extract_all(text, pat)) AS value FROM documents, p)
SELECT doc_id, type, value, count(*) AS count FROM m
WHERE NOT (type = 'phone' AND regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')) GROUP BY ALL"""
ORACLES["c2_answer_outcomes"] = """
WITH e AS (SELECT event_type FROM events)
SELECT CASE WHEN event_type = 'purchase' THEN 'answer' ELSE 'scraper' END AS request_type,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_class, false AS rate_limited, count(*) AS n
FROM e GROUP BY ALL"""
ORACLES["g8_competitor_matrix"] = """
WITH s AS (SELECT regexp_extract(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)), '([^.]+\\.[^.]+)$', 1) AS site,
                  len(regexp_extract_all(html, '<p>')) + len(regexp_extract_all(html, '<h1>')) + len(regexp_extract_all(html, '<article>')) AS main_content,
                  len(regexp_extract_all(html, '<nav>')) + len(regexp_extract_all(html, '<a\\s')) AS navigation,
                  len(regexp_extract_all(html, '<meta\\s')) + len(regexp_extract_all(html, '<title>')) AS metadata,
                  0 AS media, 0 AS forms FROM pages),
u AS (UNPIVOT s ON main_content, navigation, metadata, media, forms INTO NAME aspect VALUE value)
SELECT aspect,
       CAST(sum(value) FILTER (WHERE site = 'example.com') AS BIGINT) AS example_com,
       CAST(sum(value) FILTER (WHERE site = 'example.net') AS BIGINT) AS example_net,
       CAST(sum(value) FILTER (WHERE site = 'example.org') AS BIGINT) AS example_org,
       CAST(sum(value) FILTER (WHERE site NOT IN ('example.com', 'example.net', 'example.org')) AS BIGINT) AS other
FROM u GROUP BY aspect"""
ORACLES["j8_compare_to_reference"] = f"""
WITH t AS ({_text_sql()}),
f AS (SELECT p.page_id, {HOST.format(u='p.url')} AS host, {WORDS} AS words,
             list_distinct(list_transform(regexp_extract_all(p.html, '<a\\s[^>]*href="([^"]*)"', 1), lambda h: {ORIGIN.format(u='p.url')} || h)) AS links,
             list_distinct(list_transform(regexp_extract_all(p.html, '<h1>([^<]*)</h1>', 1), lambda h: trim({DECODE.format(x='h')}))) AS headings
      FROM pages p JOIN t USING (page_id)),
r AS (SELECT host, min(page_id) AS ref_id FROM f GROUP BY host),
j AS (SELECT f.*, r.ref_id, g.words AS rw, g.links AS rl, g.headings AS rh FROM f JOIN r USING (host) JOIN f g ON g.page_id = r.ref_id
      WHERE f.page_id <> r.ref_id)
SELECT host, page_id, ref_id,
       CAST(len(list_filter(words, lambda w: list_contains(rw, w))) AS INT) AS shared_words,
       CAST(len(list_filter(words, lambda w: NOT list_contains(rw, w))) AS INT) AS own_words,
       CAST(len(list_filter(links, lambda w: list_contains(rl, w))) AS INT) AS shared_links,
       CAST(len(list_filter(headings, lambda w: NOT list_contains(rh, w))) AS INT) AS own_headings,
       CASE WHEN len(list_distinct(list_concat(words, rw))) = 0 THEN 1.0
            ELSE round(len(list_filter(words, lambda w: list_contains(rw, w))) / len(list_distinct(list_concat(words, rw))), 4) END AS word_jaccard
FROM j"""

FEATURES = f"""
t AS ({_text_sql()}),
f AS (SELECT p.page_id, p.url, {WORDS} AS words,
             list_distinct(list_transform(regexp_extract_all(p.html, '<a\\s[^>]*href="([^"]*)"', 1), lambda h: {ORIGIN.format(u='p.url')} || h)) AS links,
             list_distinct(list_transform(regexp_extract_all(p.html, '<h1>([^<]*)</h1>', 1), lambda h: trim({DECODE.format(x='h')}))) AS headings
      FROM pages p JOIN t USING (page_id)),
listed AS (SELECT f.*, l.page_id AS place FROM f JOIN (SELECT url, page_id FROM pages WHERE page_id < 10) l USING (url)),
items AS (SELECT DISTINCT place, 'word' AS kind, unnest(words) AS item FROM listed
          UNION SELECT place, 'link', unnest(links) FROM listed UNION SELECT place, 'heading', unnest(headings) FROM listed)"""
ORACLES["j8_compare_list"] = f"""WITH {FEATURES.strip()}
SELECT kind, item, CAST(count(*) AS INT) AS n_pages, CAST(min(place) AS INT) AS first_place,
       count(*) = (SELECT count(DISTINCT place) FROM listed) AS on_all FROM items GROUP BY kind, item"""
ORACLES["g7_compare_pairs"] = f"""WITH {FEATURES.strip()},
n AS (SELECT p.place, k.kind, count(i.item) AS n FROM (SELECT DISTINCT place FROM listed) p CROSS JOIN (VALUES ('word'), ('link'), ('heading')) k(kind)
      LEFT JOIN items i ON i.place = p.place AND i.kind = k.kind GROUP BY ALL),
s AS (SELECT x.kind, x.place AS a, y.place AS b, count(*) AS shared FROM items x JOIN items y ON x.kind = y.kind AND x.item = y.item AND x.place < y.place GROUP BY ALL),
j AS (SELECT x.kind, x.place AS a, y.place AS b, coalesce(s.shared, 0) AS shared, x.n AS na, y.n AS nb
      FROM n x JOIN n y ON x.kind = y.kind AND x.place < y.place LEFT JOIN s ON s.kind = x.kind AND s.a = x.place AND s.b = y.place)
SELECT kind, CAST(a AS INT) AS a, CAST(b AS INT) AS b, shared, na - shared AS only_a, nb - shared AS only_b,
       CASE WHEN na + nb - shared = 0 THEN 1.0 ELSE round(shared / (na + nb - shared), 4) END AS jaccard FROM j"""
ORACLES["g7_similar_pages"] = f"""WITH {FEATURES.strip()},
g AS (SELECT page_id, regexp_extract({HOST.format(u='url')}, '([^.]+\\.[^.]+)$', 1) AS site, list_sort(words) AS words FROM f),
c AS (SELECT site, words, min(page_id) AS id FROM g WHERE len(words) > 0 GROUP BY ALL),
p AS (SELECT a.id AS class_a, b.id AS class_b, len(list_intersect(a.words, b.words)) AS shared, len(a.words) AS na, len(b.words) AS nb
      FROM c a JOIN c b ON a.site = b.site AND a.id < b.id)
SELECT class_a, class_b, CAST(shared AS INT) AS shared, round(shared / (na + nb - shared), 4) AS jaccard
FROM p WHERE shared >= 0.5 * (na + nb - shared)"""

ORACLES["t5_page_conversion_stream"] = f"""
WITH t AS ({_text_sql()})
SELECT p.page_id, t.text, CAST(len(regexp_extract_all(p.html, '<a\\s[^>]*href=')) AS INT) AS links
FROM pages p JOIN t USING (page_id)"""

ORACLES["s2_citation_positions"] = f"""WITH {ANSWERS.strip()}
SELECT conv_id, turn, rank AS pos, url FROM cit"""

CRAWL = f"""
cl AS (SELECT page_id AS src_page_id, url AS src_url, {ORIGIN.format(u='url')} || h AS dst_url
       FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS h FROM pages))"""
ORACLES["j3_broken_links_crawl"] = f"""WITH {CRAWL.strip()},
pn AS (SELECT DISTINCT {NORM('url')} AS n FROM pages)
SELECT src_page_id, 'unknown' AS reason, count(*) AS n FROM cl WHERE {NORM('dst_url')} NOT IN (SELECT n FROM pn) GROUP BY 1"""
ORACLES["j7_orphan_pages_crawl"] = f"""WITH {CRAWL.strip()},
t AS (SELECT DISTINCT {NORM('cl.dst_url')} AS n FROM cl JOIN pages s ON s.page_id = cl.src_page_id
      WHERE {NORM('cl.dst_url')} <> {NORM('s.url')})
SELECT page_id FROM pages WHERE {NORM('url')} NOT IN (SELECT n FROM t)"""
ORACLES["a15_linked_domains_crawl"] = f"""WITH {CRAWL.strip()}
SELECT {HOST.format(u='dst_url')} AS host, count(*) AS links, count(DISTINCT src_page_id) AS pages,
       count(*) FILTER ({AWAY}) AS external_links, count(DISTINCT src_page_id) FILTER ({AWAY}) AS external_pages
FROM cl GROUP BY 1"""

ORACLES["g5_extract_pages"] = f"""
WITH t AS ({_text_sql()}),
p(type, pat) AS (VALUES
  ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'),
  ('phone', '\\+?[0-9][0-9 ().-]{{7,}}[0-9]'),
  ('price', '[$€£] ?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:[.,][0-9]{{1,2}})?'),
  ('date', '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}'),
  ('number', '(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:[.,][0-9]+)?%?')),
m AS (SELECT page_id, type, unnest(regexp_extract_all(text, pat)) AS value FROM t, p)
SELECT page_id, type, value, count(*) AS count FROM m
WHERE NOT (type = 'phone' AND regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) GROUP BY ALL"""


# --- pages that hold the audits' cases ----------------------------------------------

def _added(at: str) -> str:
    """The markup that AUDIT_CASES add to a page, as SQL."""
    return " || ".join("CASE WHEN page_id % {} = {} THEN '{}' ELSE '' END".format(m, r, x.replace("'", "''")) for place, m, r, x in AUDIT_CASES if place == at)


CASES = f"""ap AS (SELECT page_id, url, page_id AS p, html AS plain, html LIKE '%</head>%' AS has_head, html LIKE '%</article>%' AS has_body,
  replace(replace(html, '</head>', {_added('head')} || '</head>'), '</article>', {_added('body')} || '</article>') AS html FROM pages)"""


def _n(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(html, '{pattern}')) AS INT)"


DESC = "CASE WHEN p % 2 = 0 THEN repeat('plain words ', 13) WHEN p % 4 = 1 THEN 'short' END"
SEO = {
    "title_present": "title <> ''", "title_length_ok": "length(title) BETWEEN 50 AND 60",
    "description_present": "p % 2 = 0 OR p % 4 = 1", "description_length_ok": "p % 2 = 0",
    "canonical": "p % 7 = 0", "robots": "p % 5 = 0",
    "og_title": "p % 4 = 0", "og_description": "p % 4 = 0", "og_image": "p % 4 = 0",
    "twitter_card": "p % 6 = 0", "twitter_title": "p % 6 = 0", "twitter_description": "p % 6 = 0",
    "single_h1": "len(regexp_extract_all(html, '<h1>')) = 1",
    "heading_order": "NOT (p % 2 = 1)", "image_alt": "NOT (p % 3 = 1)",
    "internal_links": "len(regexp_extract_all(plain, '<a\\s[^>]*href=')) > 0 OR p % 5 = 2",
    "https": SCHEME.format(u="url") + " = 'https'", "viewport": "p % 3 = 0",
}
ORACLES["g1_seo_audit_cases"] = f"""WITH {CASES}, t AS (SELECT *, {TITLE} AS title FROM ap),
c AS (SELECT page_id, {', '.join(f'({v}) AS {k}' for k, v in SEO.items())} FROM t)
SELECT *, CAST({' + '.join(f'{k}::INT' for k in SEO)} AS INT) AS passed, {len(SEO)} AS checks,
       round(100.0 * ({' + '.join(f'{k}::INT' for k in SEO)}) / {len(SEO)}, 2) AS score FROM c"""
ORACLES["g2_link_audit_cases"] = f"""WITH {CASES}, c AS (SELECT page_id, p, {_n('<a\\s[^>]*href=')} AS links,
  CAST(len(regexp_extract_all(plain, '<a\\s[^>]*href=')) AS INT) AS own, CAST(len(regexp_extract_all(plain, '<a\\s[^>]*href="[^"]*"[^>]*>\\s*</a>')) AS INT) AS bare FROM ap)
SELECT page_id, links, CAST(own + (p % 5 = 2)::INT AS INT) AS internal, CAST((p % 5 IN (1, 2))::INT AS INT) AS external,
       CAST(bare + (p % 5 = 2)::INT AS INT) AS missing_text, CAST((p % 5 = 1)::INT AS INT) AS nofollow, p % 5 IN (1, 2) AS excessive_external FROM c"""
ORACLES["g3_metadata_check_cases"] = f"""WITH {CASES}
SELECT page_id, {TITLE} <> '' AS title, p % 2 = 0 OR p % 4 = 1 AS description, p % 3 = 0 AS viewport, html LIKE '%<meta charset=%' AS charset, p % 5 = 0 AS robots,
       p % 7 = 0 AS canonical, p % 7 = 1 AS alternate, p % 4 = 0 AS open_graph, p % 6 = 0 AS twitter, p % 9 = 0 AS json_ld, p % 8 = 0 AS schema_org FROM ap"""
ORACLES["g4_accessibility_cases"] = f"""WITH {CASES},
t AS (SELECT *, regexp_extract_all(plain, '<a\\s[^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1) AS texts FROM ap)
SELECT page_id, CAST((p % 3 = 1)::INT AS INT) AS images_without_alt,
       CAST(len(list_filter(texts, lambda x: lower(trim(x)) IN ('click here', 'here', 'read more', 'more', 'link', 'this', 'click'))) + (p % 5 = 1)::INT AS INT) AS generic_link_text,
       CAST((p % 4 = 0)::INT AS INT) AS inputs_without_label, CAST((p % 2 = 1)::INT AS INT) AS heading_skips, p % 5 = 2 AS skip_link,
       html LIKE '%<nav%' AS has_nav, html LIKE '%<main%' AS has_main, html LIKE '%<footer%' AS has_footer FROM t"""
PROFILE = f"""SELECT page_id, url,
  {_n('<p>')} + {_n('<h1>')} + {_n('<h3>')} + {_n('<article>')} AS main_content, {_n('<nav>')} + {_n('<a ')} AS navigation,
  {_n('<meta ')} + {_n('<title>')} + {_n('<link ')} AS metadata, {_n('<img ')} + {_n('<video ')} AS media,
  {_n('<form>')} + {_n('<label')} + {_n('<input ')} + {_n('<button>')} AS forms FROM ap"""
ORACLES["g6_page_profile_cases"] = f"WITH {CASES} SELECT * EXCLUDE (url) FROM ({PROFILE})"
ORACLES["g8_competitor_matrix_cases"] = f"""WITH {CASES}, f AS ({PROFILE}),
s AS (SELECT *, regexp_extract({HOST.format(u='url')}, '([^.]+\\.[^.]+)$', 1) AS site FROM f),
u AS (UNPIVOT (SELECT * EXCLUDE (url, page_id) FROM s) ON main_content, navigation, metadata, media, forms INTO NAME aspect VALUE value)
SELECT aspect, CAST(sum(value) FILTER (WHERE site = 'example.com') AS BIGINT) AS example_com, CAST(sum(value) FILTER (WHERE site = 'example.net') AS BIGINT) AS example_net,
       CAST(sum(value) FILTER (WHERE site NOT IN ('example.com', 'example.net')) AS BIGINT) AS other FROM u GROUP BY aspect"""
ORACLES["h4_page_metadata_cases"] = f"""WITH {CASES}
SELECT page_id, CAST(1 + (p % 2 = 0 OR p % 4 = 1)::INT + (p % 3 = 0)::INT + (p % 5 = 0)::INT + 3 * (p % 4 = 0)::INT + 3 * (p % 6 = 0)::INT + (p % 8 = 0)::INT AS INT) AS n_keys,
       {DESC} AS description, CASE WHEN p % 4 = 0 THEN '/i.png' END AS og_image, CASE WHEN p % 6 = 0 THEN 'summary' END AS card FROM ap"""
ORACLES["p12_selector_then_metadata_cases"] = f"""WITH {CASES}
SELECT page_id, CAST((p % 8 = 0)::INT + 3 * (p % 6 = 0)::INT AS INT) AS n_keys, CASE WHEN p % 8 = 0 THEN 'A' END AS author, CASE WHEN p % 6 = 0 THEN 'T' END AS twitter_title FROM ap"""
ORACLES["a15_linked_domains_cases"] = f"""WITH {CASES}, l AS (SELECT page_id, url, 'other.example' AS host FROM ap WHERE p % 5 = 1 UNION ALL SELECT page_id, url, 'third.example' FROM ap WHERE p % 5 = 2)
SELECT host, count(*) AS links, count(DISTINCT page_id) AS pages FROM l GROUP BY host"""
ORACLES["c2_answer_outcomes_cases"] = """
WITH e AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) % 4 AS k FROM events)
SELECT CASE WHEN event_type = 'purchase' THEN 'answer' ELSE 'scraper' END AS request_type,
       CAST(CASE WHEN event_type <> 'error' THEN 200 WHEN k = 0 THEN 429 WHEN k = 1 THEN 400 WHEN k = 2 THEN 503 ELSE 500 END AS INT) AS status, count(*) AS n
FROM e GROUP BY ALL"""

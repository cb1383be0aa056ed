"""The publication queries once more, as DuckDB SQL over the same tables."""

from __future__ import annotations

_CONV = "conv AS (SELECT conv_id AS pub_id, turn::INT AS spine_index, 'ch' || turn AS idref, 'text/ch' || turn || '.xhtml' AS href, role <> 'system' AS linear, text AS body, strlen(text)::BIGINT AS length FROM conversations)"
_PAGES = "pb AS (SELECT (page_id // 10)::BIGINT AS pub_id, (page_id % 10)::INT AS spine_index, 'ch' || (page_id % 10) AS idref, html, page_id, url FROM pages)"


def _positions(chapters: str, n: str) -> str:
    """CTEs pos(pub_id, spine_index, href, cfi, global_position, chapter_progression, total_progression, p, n, before) from chapters(pub_id, spine_index, idref, href, linear, length ...)."""
    return f"""{chapters},
cnt AS (SELECT *, {n} AS n FROM ch WHERE linear),
run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY pub_id ORDER BY spine_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(n) OVER (PARTITION BY pub_id)::BIGINT AS total FROM cnt),
pos AS (SELECT pub_id, spine_index, href, 'epubcfi(/6/' || (2 * (spine_index + 1)) || '[' || idref || ']!/4' || CASE WHEN p > 0 THEN '/' || (2 * p) ELSE '' END || ')' AS cfi, (before + p + 1)::BIGINT AS global_position,
  CASE WHEN n > 1 THEN (p::DOUBLE / n)::FLOAT ELSE 0::FLOAT END AS chapter_progression, ((before + p)::DOUBLE / total)::FLOAT AS total_progression, p, n, before, idref FROM (SELECT *, unnest(range(n)) AS p FROM run))"""


def _count(page: int) -> str:
    return f"greatest(ceil(length / {page}.0)::BIGINT, 1)"


_BOOK = _positions(f"WITH {_CONV}, ch AS (SELECT * FROM conv)", _count(1024))
_OUT = " SELECT pub_id, spine_index, href, cfi, global_position, chapter_progression, total_progression FROM pos"
_WORDS = "words AS (SELECT pub_id, href, array_to_string(string_split(body, ' ')[1:3], ' ') AS title, spine_index FROM conv)"
_LINKS = f"""{_PAGES}, links AS (SELECT DISTINCT page_id, 'OEBPS/p' || pub_id AS base, 'OEBPS/p' || pub_id || '/' || idref || '.xhtml' AS file, link, '..' || link || '%20x.png?v=1#top' AS rel FROM (SELECT *, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pb))"""
_KINDS = "['xhtml', 'css', 'png', 'jpg', 'svg', 'woff2', 'mp3', 'js', 'jpe', 'bin']"
_ITEMS = f"items AS (SELECT p_brand AS pub_id, p_partkey::INT AS doc_order, 'id' || p_partkey AS id, {_KINDS}[p_partkey % 10 + 1] AS kind, replace(p_name, ' ', '/') || p_partkey || '.' || {_KINDS}[p_partkey % 10 + 1] AS href, p_size AS size FROM part)"
_MIME = "CASE kind WHEN 'xhtml' THEN 'application/xhtml+xml' WHEN 'css' THEN 'text/css' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'svg' THEN 'image/svg+xml' WHEN 'woff2' THEN 'font/woff2' WHEN 'mp3' THEN 'audio/mpeg' WHEN 'js' THEN 'application/javascript' ELSE 'application/octet-stream' END"
_GUESS = "CASE kind WHEN 'xhtml' THEN 'application/xhtml+xml' WHEN 'css' THEN 'text/css' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpe' THEN 'image/jpeg' WHEN 'svg' THEN 'image/svg+xml' WHEN 'woff2' THEN 'font/woff2' WHEN 'mp3' THEN 'audio/mpeg' ELSE 'application/octet-stream' END"
_RESOLVED = f"CASE WHEN size % 3 = 2 THEN 'x/declared' ELSE {_GUESS} END"
_SPINE = f"{_ITEMS}, spine AS (SELECT pub_id, (row_number() OVER (PARTITION BY pub_id ORDER BY doc_order) - 1)::INT AS spine_index, CASE WHEN size % 4 = 0 THEN 'cover' || id ELSE id END AS idref, size % 6 <> 1 AS linear, href, size FROM items WHERE kind = 'xhtml')"
_NAME = "regexp_extract({}, '[^/]*$')"
# The pages' fixed skeleton: links, an advertisement, a heading, paragraphs that may not be closed, a footer.
_TEXT = """replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"""
_BLOCKS = rf"""{_PAGES},
body AS (SELECT page_id, spine_index, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1) AS nav, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS head, regexp_extract(html, '(?s)</h1>(.*?)</article>', 1) AS art FROM pb),
li AS (SELECT page_id, spine_index, lang, 'li' AS tag_name, i AS k, '/4/2/2/' || (2 * i) AS path, x AS raw FROM (SELECT *, unnest(regexp_extract_all(nav, '<li>(.*?)</li>', 1)) AS x, unnest(range(1, len(regexp_extract_all(nav, '<li>(.*?)</li>', 1)) + 1)) AS i FROM body)),
h AS (SELECT page_id, spine_index, lang, 'h1' AS tag_name, 1000 AS k, '/4/6/2' AS path, head AS raw FROM body),
p AS (SELECT page_id, spine_index, lang, 'p' AS tag_name, 1000 + i AS k, '/4/6/' || (2 * i + 2) AS path, x AS raw FROM (SELECT *, unnest(string_split(art, '<p>')[2:]) AS x, unnest(range(1, len(string_split(art, '<p>')))) AS i FROM body)),
blocks AS (SELECT *, trim({_TEXT.format("regexp_replace(raw, '<[^>]*>', '', 'g')")}, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM (SELECT * FROM li UNION ALL SELECT * FROM h UNION ALL SELECT * FROM p)),
b AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS ord, tag_name, lang AS language, 'epubcfi(/6/' || (2 * (spine_index + 1)) || '[ch' || spine_index || ']!' || path || ')' AS cfi_range, text FROM blocks WHERE text <> '')"""
_GRAPH = "g AS (SELECT a.n_regionkey AS pub_id, a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE ((b.n_nationkey - a.n_nationkey) % 7) IN (3, 4) OR a.n_nationkey - b.n_nationkey = 11)"
_MASKED = "replace(replace(body, '&', '&amp;'), '<', '&lt;')"
_TREE = """t AS (SELECT r_regionkey AS rk, -1 AS nk, -1 AS sk, r_name AS title, 'text/r' || r_regionkey || '.xhtml' AS href, 0 AS depth FROM region
UNION ALL SELECT n_regionkey, n_nationkey, -1, n_name, 'text/n' || n_nationkey || '.xhtml', 1 FROM nation
UNION ALL SELECT n_regionkey, s_nationkey, s_suppkey, s_name, 'text/n' || s_nationkey || '.xhtml#s' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT *, (row_number() OVER (ORDER BY rk, nk, sk) - 1)::INT AS node_id FROM t),
tree AS (SELECT n.node_id, p.node_id AS parent_id, n.depth, n.title, n.href FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.rk = n.rk AND (p.depth = 0 OR p.nk = n.nk))"""


ORACLE: dict[str, str] = {
    "positions_by_book": _BOOK + _OUT,
    "positions_small_pages": _positions(f"WITH {_CONV}, ch AS (SELECT * FROM conv)", _count(256)) + _OUT,
    "positions_fixed_layout": _positions("WITH ch AS (SELECT source AS pub_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS spine_index, 'd' || doc_id AS idref, 'text/d' || doc_id || '.xhtml' AS href, true AS linear, strlen(text)::BIGINT AS length, lang FROM documents)", f"CASE WHEN lang = 'de' THEN 1 ELSE {_count(1024)} END") + _OUT,
    "positions_encrypted": _positions(f"WITH {_CONV}, ch AS (SELECT * REPLACE (CASE WHEN spine_index % 3 = 0 THEN length * 2 + 500 ELSE length END AS length) FROM conv)", _count(1024)) + _OUT,
    "position_index": _BOOK + " SELECT pub_id, spine_index, min(global_position) - 1 AS start, count(*) AS n FROM pos GROUP BY ALL",
    "location_from_cfi": _BOOK + r" SELECT a.pub_id, a.cfi, b.before + least(coalesce(nullif(regexp_extract(a.cfi, '!/4/(\d+)', 1), '')::BIGINT, 0) // 2, b.n - 1) AS location FROM pos a JOIN run b ON a.pub_id = b.pub_id AND b.spine_index = regexp_extract(a.cfi, '^epubcfi\(/6/(\d+)', 1)::INT // 2 - 1",
    "cfi_from_location": _BOOK + " SELECT event_id, user_id % 100 AS pub_id, event_id % 12 AS location, cfi FROM events LEFT JOIN pos ON pub_id = user_id % 100 AND global_position = event_id % 12 + 1",
    "location_from_progression": _BOOK + ", n AS (SELECT pub_id, count(*) AS n FROM pos GROUP BY 1), e AS (SELECT event_id, user_id % 100 AS pub_id, (floor(value)::BIGINT % 100) / 100.0::DOUBLE AS progression FROM events) SELECT event_id, e.pub_id, progression, least(trunc(progression::FLOAT * n::FLOAT)::BIGINT, n - 1) AS location FROM e LEFT JOIN n USING (pub_id)",
    "title_map": f"WITH {_CONV}, {_WORDS} SELECT pub_id, href AS href_key, title FROM words",
    "positions_titled": _BOOK + f", {_WORDS} SELECT pos.pub_id, global_position, cfi, title FROM pos JOIN words USING (pub_id, href)",
    "position_markers": f"WITH {_CONV}, m AS (SELECT pub_id, spine_index, idref, length(body) AS n FROM conv) SELECT pub_id, spine_index, (n // 200)::INT AS n_markers, (n % 200)::INT AS carried, CASE WHEN n >= 200 THEN 'epubcfi(/6/' || (2 * (spine_index + 1)) || '[' || idref || ']!/4/2/1:' || (n // 200 * 200) || ')' END AS last_marker FROM m",
    "cfi_spine_base": f"WITH {_CONV} SELECT pub_id, spine_index, '/6/' || (2 * (spine_index + 1)) || '[' || idref || ']!' AS base FROM conv",
    "cfi_sort": _BOOK + " SELECT pub_id, cfi, row_number() OVER (PARTITION BY pub_id ORDER BY [spine_index, p] DESC) AS from_end FROM pos",
    "cfi_compare": _BOOK + " SELECT a.pub_id, a.cfi AS a, b.cfi AS b, -1 AS order_ab, 1 AS order_ba, true AS equal_aa FROM pos a JOIN pos b ON a.pub_id = b.pub_id AND b.global_position = a.global_position + 2",
    "cfi_resolve_xpath": _BOOK + " SELECT pub_id, cfi, spine_index::BIGINT AS spine_index, './*/*[2]' || CASE WHEN p > 0 THEN '/*[' || p || ']' ELSE '' END AS xpath, './*[local-name()]/*[local-name()][2]' || CASE WHEN p > 0 THEN '/*[local-name()][' || p || ']' ELSE '' END AS xpath_ns_agnostic, false AS is_text_node, CASE WHEN p > 0 THEN 2 ELSE 1 END AS n_steps FROM pos",
    "cfi_range": _BOOK + " SELECT a.pub_id, a.cfi, b.cfi AS to_cfi, 'epubcfi(/6/' || (2 * (a.spine_index + 1)) || '[' || a.idref || ']!/4,' || CASE WHEN a.p > 0 THEN '/' || (2 * a.p) ELSE '' END || ',/' || (2 * b.p) || ')' AS range FROM pos a JOIN pos b ON a.pub_id = b.pub_id AND a.spine_index = b.spine_index AND b.p = b.n - 1 AND a.p < b.p",
    "cfi_roundtrip": _BOOK + " SELECT pub_id, cfi, cfi AS again FROM pos",
    "url_external": "SELECT DISTINCT page_id, ref, regexp_matches(ref, '^(//|[a-zA-Z]+:)') AS is_external FROM (SELECT page_id, unnest([url, regexp_replace(url, '^https?:', ''), regexp_replace(url, '^https?://', ''), upper(url), 'mailto:' || url]) AS ref FROM pages)",
    "path_join": f"WITH {_LINKS} SELECT page_id, link, 'OEBPS' || link || '%20x.png?v=1#top' AS joined FROM links",
    "path_normalize": f"WITH {_LINKS} SELECT page_id, link, 'OEBPS' || link || ' x.png' AS path FROM links",
    "path_relative": f"WITH {_LINKS} SELECT page_id, link, '..' || link || ' x.png' AS relative FROM links",
    "href_resolve": f"WITH {_LINKS} SELECT page_id, link, 'OEBPS' || link || '%20x.png?v=1#top' AS href, link[2:] AS chapter_href FROM links",
    "path_guard": f"WITH {_LINKS} SELECT DISTINCT page_id, path, path[1] = '/' OR path[1:2] = '..' AS escapes FROM (SELECT page_id, unnest([link, rel, 'a/..' || link, 'a' || link]) AS path FROM links)",
    "mime_by_path": f"WITH {_ITEMS} SELECT pub_id, id, {_MIME} AS media_type, {_GUESS} AS guessed, {_RESOLVED} AS resolved, kind IN ('css', 'png', 'jpg', 'jpe', 'svg', 'woff2', 'mp3') AS inlineable FROM items",
    "media_type_histogram": f"WITH {_ITEMS} SELECT pub_id, {_MIME} AS media_type, count(*) AS n FROM items GROUP BY ALL",
    "data_uri": f"WITH {_CONV} SELECT pub_id, spine_index, 'data:application/xhtml+xml;base64,' || to_base64(encode(body)) AS uri FROM conv",
    "rendition_best": "WITH r AS (SELECT o_custkey AS pub_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS idx, 'opf' || o_orderkey AS opf_path, CASE WHEN o_orderkey % 3 IN (1, 2) THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS score FROM orders) SELECT pub_id, idx, opf_path FROM r QUALIFY row_number() OVER (PARTITION BY pub_id ORDER BY score DESC, CASE WHEN score > 0 THEN -idx ELSE idx END) = 1",
    "reading_direction": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 OR lang IN ('ar', 'fa', 'he', 'ur') THEN 'rtl' ELSE 'ltr' END AS direction FROM documents",
    "series_primary": "WITH p AS (SELECT *, (p_partkey // 3)::BIGINT AS pub_id FROM part), b AS (SELECT DISTINCT pub_id FROM p), s AS (SELECT pub_id, arg_min(p_name, p_partkey) AS series_name, arg_min(p_size, p_partkey)::DOUBLE AS series_position FROM p WHERE p_size % 2 = 0 GROUP BY 1) SELECT pub_id, series_name, series_position FROM b LEFT JOIN s USING (pub_id)",
    "epub_roundtrip_metadata": f"WITH {_CONV} SELECT pub_id, regexp_replace(array_to_string(string_split(body, ' ')[1:4], ' '), '^\\s+|\\s+$', '', 'g') AS title, 'urn:conv:' || pub_id AS identifier, 'en' AS language, '2024-01-01T00:00:00Z' AS modified, 'reflowable' AS layout FROM conv WHERE spine_index = 0",
    "epub_roundtrip_spine": f"WITH {_CONV} SELECT pub_id, spine_index, idref, linear, href, 'application/xhtml+xml' AS media_type FROM conv",
    "epub_roundtrip_bytes": f"WITH {_CONV}, d AS (SELECT pub_id, 'OEBPS/' || href AS path, '<html><head></head><body><p>' || {_MASKED} || '</p></body></html>' AS html FROM conv) SELECT pub_id, path, strlen(html)::BIGINT AS length, md5(html) AS md5 FROM d",
    "epub_roundtrip_nav": f"WITH {_CONV} SELECT pub_id, 'toc' AS list, spine_index AS node_id, 0 AS depth, 'Turn ' || spine_index || ' & on' AS title, 'OEBPS/' || href AS href FROM conv",
    "epub_entries": f"WITH {_CONV} SELECT pub_id, count(*) + 5 AS n_entries, 'mimetype' AS first_entry, 'OEBPS/content.opf' AS last_entry FROM conv GROUP BY 1",
    "entry_lookup": f"WITH {_ITEMS} SELECT pub_id, id, CASE WHEN kind = 'png' THEN regexp_replace(href, 'png$', 'GIF') WHEN size % 2 = 0 THEN upper(href) WHEN size % 5 = 0 THEN 'no/' || href ELSE href END AS path, CASE WHEN kind = 'png' OR size % 2 = 0 OR size % 5 <> 0 THEN href END AS entry_path FROM items",
    "container_renditions": "SELECT n_regionkey AS pub_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS idx, 'N' || n_nationkey || '/c.opf' AS opf_path, lower(n_name) AS language FROM nation WHERE n_nationkey % 4 <> 0",
    "encryption_map": "SELECT s_nationkey AS pub_id, 'OEBPS/f ' || s_suppkey || '.otf' AS zip_path, CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE ['idpf', 'adobe', 'aes_cbc', 'unknown'][s_suppkey % 4 + 1] END AS algorithm, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS original_length FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 3 = 0",
    "a11y_rank": """WITH o AS (SELECT DISTINCT l_linenumber, l_orderkey % 6 AS k FROM lineitem), p AS (SELECT *, repeat('A', l_linenumber % 4) AS lv FROM o)
SELECT k, l_linenumber, CASE WHEN k < 2 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'https://' ELSE 'http://www.' END || 'idpf.org/epub/a11y/accessibility-20170105.html#wcag-' || lower(lv) ELSE 'EPUB  Accessibility 1.1 - WCAG 2.' || (k - 2) || ' Level ' || lv END AS raw,
 CASE WHEN lv = '' THEN NULL WHEN k < 2 THEN 'http://www.idpf.org/epub/a11y/accessibility-20170105.html#wcag-' || lower(lv) ELSE 'EPUB Accessibility 1.1 - WCAG 2.' || (k - 2) || ' Level ' || lv END AS profile,
 CASE WHEN lv = '' THEN 255 WHEN k < 2 THEN length(lv) ELSE 4 + least(3 * (k - 2), 9) + length(lv) - 1 END::INT AS rank FROM p""",
    "extract_text": r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body[^>]*>', ''), '(?s)</body>.*$', ''), '(?s)<!--.*?-->|<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages",
    "text_stats": r"WITH t AS (SELECT (page_id // 10)::BIGINT AS pub_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body[^>]*>', ''), '(?s)</body>.*$', ''), '(?s)<!--.*?-->|<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages) SELECT pub_id, count(*) AS pages, sum(length(text))::BIGINT AS chars, max(strlen(text))::BIGINT AS longest FROM t GROUP BY 1",
    "semantic_blocks": f"WITH {_BLOCKS} SELECT page_id, ord, tag_name, language, cfi_range, md5(text) AS text_md5 FROM b",
    "blocks_by_tag_lang": f"WITH {_BLOCKS} SELECT tag_name, language, count(*) AS blocks, sum(length(text))::BIGINT AS chars FROM b GROUP BY ALL",
    "property_inference": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'scripted svg' WHEN 1 THEN 'mathml' ELSE 'scripted' END AS properties FROM pages",
    "local_refs": r"""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS ord, 'OEBPS/text' || x AS path FROM (SELECT page_id, unnest(l) AS x, unnest(range(len(l))) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?:src|href|poster)="([^"'']+)"', 1) AS l FROM pages))""",
    "ref_closure": f"WITH RECURSIVE {_GRAPH}, reach AS (SELECT n_regionkey AS pub_id, min(n_nationkey) AS k FROM nation GROUP BY 1 UNION SELECT reach.pub_id, g.y FROM reach JOIN g ON g.pub_id = reach.pub_id AND g.x = reach.k) SELECT pub_id, 'c1' AS chapter, 's' || k || '.css' AS path FROM reach",
    "inject_head": "SELECT page_id, md5(replace(html, '</head>', '<style>p{}</style>' || chr(10) || '<script>go()</script></head>')) AS md5 FROM pages",
    "css_rewrite": "SELECT p_partkey, '@import \"V' || p_partkey || '\"; /* url(i/x.png) */ p{background: url(\"U' || p_partkey || '\") url(https://h/x)} q{b:url(''f ' || p_partkey || ''')}' AS css FROM part",
    "resolve_resource": f"""WITH {_ITEMS}, r AS (SELECT *, CASE size % 3 WHEN 0 THEN '../' || href WHEN 1 THEN '/OEBPS/' || href || '#x' ELSE 'lost/' || {_NAME.format('href')} END AS ref, {_MIME} AS mt FROM items),
f AS (SELECT a.pub_id, a.ref, arg_min(b.href, b.doc_order) AS href, arg_min(b.mt, b.doc_order) AS mt FROM r a JOIN r b ON a.pub_id = b.pub_id AND {_NAME.format('b.href')} = {_NAME.format("regexp_replace(a.ref, '#.*', '')")} GROUP BY ALL)
SELECT r.pub_id, r.ref, 'OEBPS/' || coalesce(CASE WHEN size % 5 <> 0 AND size % 3 <> 2 THEN r.href END, f.href) AS zip_path, CASE WHEN size % 5 <> 0 AND size % 3 <> 2 THEN r.mt ELSE f.mt END AS media_type FROM r LEFT JOIN f USING (pub_id, ref)""",
    "spine_of_href": f"WITH {_SPINE}, a AS (SELECT pub_id, 'OEBPS/' || href || '#part' AS href FROM spine UNION ALL SELECT pub_id, 'other/' || {_NAME.format('href')} FROM spine), c AS (SELECT pub_id, href, regexp_replace(href, '#.*', '') AS c FROM a) SELECT c.pub_id, c.href, min(s.spine_index) AS spine_of FROM c LEFT JOIN spine s ON s.pub_id = c.pub_id AND (ends_with(s.href, c.c) OR ends_with(c.c, s.href) OR {_NAME.format('s.href')} = {_NAME.format('c.c')}) GROUP BY ALL",
    "reading_start": f"""WITH {_SPINE}, k AS (SELECT pub_id, regexp_extract(pub_id, '([0-9]+)', 1)::INT % 3 AS k, max(href) AS href FROM spine GROUP BY pub_id),
l AS (SELECT k.pub_id, min(s.spine_index) AS i, k.k, k.href FROM k JOIN spine s ON s.pub_id = k.pub_id AND (ends_with(s.href, k.href) OR ends_with(k.href, s.href) OR {_NAME.format('s.href')} = {_NAME.format('k.href')}) WHERE k.k < 2 GROUP BY ALL),
c AS (SELECT pub_id, arg_min(id, doc_order) AS cover FROM items GROUP BY 1),
n AS (SELECT s.pub_id, min(spine_index) AS i, arg_min(href, spine_index) AS href FROM spine s JOIN c USING (pub_id) WHERE linear AND s.idref <> cover AND NOT contains(lower(s.idref), 'cover') AND NOT contains(lower(href), 'cover') GROUP BY 1),
z AS (SELECT pub_id, arg_min(href, spine_index) AS href FROM spine GROUP BY 1)
SELECT z.pub_id, coalesce(l.i, n.i, 0)::INT AS spine_index, CASE WHEN l.k = 0 THEN 'landmark:bodymatter' WHEN l.k = 1 THEN 'guide:start' WHEN n.i > 0 THEN 'cover_skip' ELSE 'spine_zero' END AS source, CASE WHEN l.k = 0 THEN 'OEBPS/' || l.href || '#x' WHEN l.k = 1 THEN l.href ELSE coalesce(n.href, z.href) END AS href FROM z LEFT JOIN l USING (pub_id) LEFT JOIN n USING (pub_id)""",
    "cover_pick": f"""WITH {_ITEMS}, m AS (SELECT *, {_MIME} AS media_type, first_value(id) OVER (PARTITION BY pub_id ORDER BY doc_order) AS first_id FROM items),
t AS (SELECT *, CASE WHEN length(pub_id) = 8 AND id = first_id THEN 0 WHEN kind = 'svg' AND size % 10 = 0 THEN 1 WHEN media_type LIKE 'image/%' AND (contains(lower(id), 'cover') OR contains(lower(href), 'cover')) THEN 2 WHEN media_type LIKE 'image/%' THEN 3 END AS tier FROM m)
SELECT pub_id, id, href, media_type FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pub_id ORDER BY tier, doc_order) = 1""",
    "toc_title": f"WITH {_CONV}, {_WORDS} SELECT pub_id, CASE spine_index % 3 WHEN 0 THEN 'OEBPS/' || href || '#a' WHEN 1 THEN href || '?q' ELSE 'gone/ch' || spine_index || '.xhtml' END AS href, CASE WHEN spine_index % 3 = 0 THEN title || '!' ELSE title END AS title FROM words",
    "toc_flatten": f"WITH {_TREE} SELECT node_id, parent_id, depth, title, href FROM tree",
    "toc_depth": f"WITH {_TREE} SELECT 1 AS pub_id, depth, count(*) AS entries, count(DISTINCT parent_id) AS parents FROM tree GROUP BY depth",
    "smil_chain": f"WITH {_CONV}, s AS (SELECT pub_id, spine_index, href, 'OEBPS/smil/ov' || spine_index || '.smil' AS smil_path FROM conv WHERE linear AND spine_index % 2 = 0) SELECT pub_id, spine_index, href, smil_path, lag(smil_path) OVER w AS prev_smil, lead(smil_path) OVER w AS next_smil FROM s WINDOW w AS (PARTITION BY pub_id ORDER BY spine_index)",
    "validate_packages": """WITH b AS (SELECT c_custkey AS pub_id, CASE WHEN c_nationkey % 5 <> 0 THEN c_name END AS title, CASE WHEN c_nationkey % 3 = 0 THEN ' ' ELSE c_mktsegment END AS identifier, CASE WHEN c_nationkey % 4 = 0 THEN 'o' || c_custkey END AS cover_id FROM customer),
o AS (SELECT o_custkey AS pub_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderstatus AS st FROM orders WHERE o_custkey IN (SELECT pub_id FROM b)),
e AS (SELECT pub_id, 0 AS ord, 'title is blank' AS message FROM b WHERE title IS NULL
UNION ALL SELECT pub_id, 1000000, 'identifier is blank' FROM b WHERE identifier = ' '
UNION ALL SELECT pub_id, 3000000, 'reading order has no items' FROM b WHERE pub_id NOT IN (SELECT pub_id FROM o WHERE k % 4 <> 0)
UNION ALL SELECT pub_id, 4000000 + i, 'reading order: no resource with id o' || k FROM o WHERE k % 4 <> 0 AND st = 'F'
UNION ALL SELECT pub_id, 5000000 + i, 'table of contents: no file o' || k || '.x for entry o' || k FROM o WHERE k % 3 = 0 AND st = 'F'
UNION ALL SELECT pub_id, 6000000, 'cover: no resource with id ' || cover_id FROM b WHERE cover_id IS NOT NULL AND (pub_id, cover_id) NOT IN (SELECT (pub_id, 'o' || k) FROM o WHERE st <> 'F'))
SELECT pub_id, ord::INT AS ord, message FROM e""",
    "corpus_audit": "WITH p AS (SELECT (page_id // 10)::BIGINT AS pub_id, CASE WHEN contains(html, '</body></html>') THEN 'ok' WHEN page_id % 2 = 0 THEN 'retry' ELSE 'fail' END AS outcome FROM pages) SELECT pub_id, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'retry') AS retry, count(*) FILTER (outcome = 'fail') AS fail, count(*) AS chapters, grouping(pub_id)::INT AS is_total, round(100.0 * count(*) FILTER (outcome <> 'fail') / count(*), 2)::DOUBLE AS usable_pct FROM p GROUP BY ROLLUP (pub_id)",
    "idpf_key": "SELECT c_custkey, sha1('urn:' || regexp_replace(c_name, '\\s', '', 'g') || c_mktsegment) AS key FROM customer",
    "adobe_key": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN repeat('00', 16) ELSE md5(c_name) END AS key FROM customer",
    "deobfuscate": f"WITH {_CONV} SELECT pub_id, spine_index, md5(body) AS md5, length, true AS tail_same FROM conv",
    "clock_values": """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q FROM lineitem), s AS (SELECT *, CASE l_linenumber WHEN 1 THEN q * 3600.0 + q * 60.0 + q + 0.5 WHEN 2 THEN q * 60.0 + q WHEN 3 THEN q / 1000.0 WHEN 4 THEN (q + 0.25) * 60.0 WHEN 5 THEN q * 3600.0 WHEN 6 THEN q END::DOUBLE AS seconds FROM l)
SELECT l_orderkey, l_linenumber, seconds, 'a.mp3' || CASE WHEN seconds IS NULL THEN '' ELSE '#t=0.000,' || format('{:.3f}', seconds) END AS fragment FROM s""",
    "chapter_search_counts": rf"WITH {_PAGES}, t AS (SELECT pub_id, spine_index, len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<[^>]*>', chr(1), 'g'), 'margin|[0-9]+')) AS hits FROM pb) SELECT pub_id, spine_index, hits FROM t WHERE hits > 0",
    "book_search_capped": rf"WITH {_PAGES}, t AS (SELECT pub_id, spine_index, row_number() OVER (PARTITION BY pub_id ORDER BY spine_index) AS k FROM pb WHERE regexp_matches(regexp_replace(html, '(?s)<!--.*?-->|<[^>]*>', chr(1), 'g'), '(?i)example\.')) SELECT pub_id, count(*) AS hits, min(spine_index) AS first_chapter, max(spine_index) AS last_chapter FROM t WHERE k <= 4 GROUP BY 1",
    "prepare_stats": f"WITH {_PAGES}, p AS (SELECT *, page_id % 4 AS k FROM pb) SELECT pub_id, idref AS chapter, CASE WHEN k = 0 THEN 4 ELSE 5 END::BIGINT AS considered, CASE WHEN k = 3 THEN 4 ELSE 3 END::BIGINT AS inlined, (k = 1)::BIGINT AS skipped_oversize, (k = 2)::BIGINT AS missing, 1::BIGINT AS skipped_type, CASE WHEN k IN (0, 3) THEN 3 ELSE 2 END::BIGINT AS data_uris FROM p",
    "stream_positions": f"WITH {_CONV} SELECT pub_id, spine_index, {_count(1024)} AS n FROM conv WHERE linear",
    "toc_json": f"WITH {_TREE} SELECT node_id, parent_id, depth, title, href FROM tree",
    "positions_nav_titles": f"WITH {_CONV}, {_WORDS} SELECT pub_id, spine_index, title, NULL::VARCHAR AS strict_title FROM words",
    "spine_quarantine": f"WITH {_SPINE}, m AS (SELECT pub_id, count(*) AS items, count(*) FILTER (linear AND idref LIKE 'cover%') AS missing FROM spine GROUP BY 1) SELECT pub_id, items, missing, CASE WHEN missing = 0 THEN items ELSE 0 END AS kept FROM m",
    "rewrite_resources": """SELECT page_id, md5(array_to_string(list_transform(string_split(html, 'href="'), lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(string_split(x, '"')[1], '[aeiou]$') THEN 'new/' || length('OEBPS' || string_split(x, '"')[1]) || x[length(string_split(x, '"')[1]) + 1 :] ELSE x END), 'href="')) AS md5 FROM pages""",
    # Unclosed b elements come back in every later paragraph and in the footer, three at most.
    "cfi_annotate": f"""WITH {_BLOCKS}, par AS (SELECT page_id, k, len(regexp_extract_all(raw, '<b>')) AS bs, len(regexp_extract_all(raw, '<br>')) AS brs FROM p),
c AS (SELECT *, least(3, coalesce(sum(bs) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS again, sum(bs) OVER (PARTITION BY page_id) AS total FROM par),
e AS (SELECT page_id, sum(1 + bs + brs + again) + least(3, max(total)) AS n FROM c GROUP BY 1), l AS (SELECT page_id, count(*) AS n FROM li GROUP BY 1)
SELECT page_id, (12 + 2 * l.n + e.n)::INT AS n, 'epubcfi(/6/' || (2 * (spine_index + 1)) || '[ch' || spine_index || ']!/2)' AS first_cfi, 'epubcfi(/6/' || (2 * (spine_index + 1)) || '[ch' || spine_index || ']!/4)' AS body_cfi FROM body JOIN l USING (page_id) JOIN e USING (page_id)""",
    "search_coordinates": f"""WITH {_BLOCKS}, par AS (SELECT page_id, k, path, raw, len(regexp_extract_all(raw, '<b>')) AS bs FROM p),
c AS (SELECT *, least(3, coalesce(sum(bs) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS again FROM par),
f AS (SELECT page_id, least(3, sum(bs)) AS again FROM par GROUP BY 1),
texts AS (SELECT page_id, -3 AS k, 1 AS idx, '/2/4' AS path, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS raw FROM pages
UNION ALL SELECT page_id, k, 1, path || '/2', raw FROM li
UNION ALL SELECT page_id, 900, 1, '/4/4', regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) FROM pages
UNION ALL SELECT page_id, k, 1, path, raw FROM h
UNION ALL SELECT page_id, k, 2 * i - 1, path || repeat('/2', (again + bs)::INT), x FROM (SELECT *, unnest(string_split(raw, '<br>')) AS x, unnest(range(1, len(string_split(raw, '<br>')) + 1)) AS i FROM c)
UNION ALL SELECT page_id, 100000, 1, '/4/8' || repeat('/2', again::INT), regexp_extract(html, '(?s)<footer>(.*?)(?:</footer>.*)?$', 1) FROM pages JOIN f USING (page_id)),
t AS (SELECT page_id, k, idx, path, {_TEXT.format("regexp_replace(raw, '<[^>]*>', '', 'g')")} AS text FROM texts),
parts AS (SELECT *, string_split_regex(text, '(?i)the') AS ps FROM t),
hit AS (SELECT page_id, k, idx, path, j, list_sum(list_transform(ps[1:j], lambda x: strlen(x)))::BIGINT + 3 * (j - 1) AS a FROM (SELECT *, unnest(range(1, len(ps))) AS j FROM parts)),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k, idx, j) - 1 AS hit_ord FROM hit),
top AS (SELECT pub_id, spine_index, hit_ord, 'epubcfi(/6/' || (2 * (spine_index + 1)) || '[ch' || spine_index || ']!' || path || ',/' || idx || ':' || a || ',/' || idx || ':' || (a + 3) || ')' AS cfi FROM o JOIN pb USING (page_id) WHERE hit_ord < 3)
SELECT pub_id, spine_index, hit_ord::INT AS hit_ord, cfi FROM top QUALIFY row_number() OVER (PARTITION BY pub_id ORDER BY spine_index, hit_ord) <= 10""",
}

"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from .linetemplates import LEADING, MATCH, MIN_DOCS
from .mixing import BINS, MAX_EPOCHS, SEED, WEIGHTS
from .rules import MAX_DOCS, MAX_REPEAT, MIN_LEFT, MIN_WORDS
from .sharding import ROUNDS, round_keys
from .warc import MIN_REVISIT

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP4 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages), d AS (SELECT page_id, octet_length(raw)::BIGINT AS n, sha256(raw) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first_id FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to, NULL::VARCHAR AS error FROM f"""


def sharding_sql(shards: int, seed: int) -> str:
    """The permutation walked in a recursive query; crc32 byte by byte over the text's hexadecimal form."""
    keys = ", ".join(map(str, round_keys(seed)))
    x1 = f"((xor(r, [{keys}][step % {ROUNDS} + 1]))::HUGEINT * 2654435769 % 4294967296)::BIGINT"
    x2 = "(xor({0}, {0} >> 15)::HUGEINT * 2246822519 % 4294967296)::BIGINT"
    return f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS i))),
docs AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, size), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS text_crc32 FROM docs, tab),
n AS (SELECT count(*) AS n FROM documents), b AS (SELECT n, greatest(1, CAST(ceil(log2(greatest(n, 2)) / 2) AS INT)) AS hb FROM n),
walk AS (SELECT rn, rn >> hb AS l, rn % (1 << hb) AS r, 0 AS step FROM (SELECT row_number() OVER (ORDER BY doc_id, size, text_crc32) - 1 AS rn FROM crc), b
  UNION ALL SELECT rn, r, xor(l, (xor(y, y >> 13)) % (1 << hb)), step + 1 FROM (SELECT *, {x2.format('x')} AS y FROM (SELECT rn, l, r, step, n, hb, {x1} AS x FROM walk, b WHERE step = 0 OR step % {ROUNDS} <> 0 OR (l << hb) + r >= n))),
pos AS (SELECT rn, (l << hb) + r AS p FROM walk, b WHERE step > 0 AND step % {ROUNDS} = 0 AND (l << hb) + r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INT AS shard, p // {shards} AS slot, NULL::INT AS grown_shard FROM (SELECT *, row_number() OVER (ORDER BY doc_id, size, text_crc32) - 1 AS rn FROM crc) JOIN pos USING (rn)"""


_OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, 'null') AS host, text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, w[i : i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY 1),
ln AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
norm AS (SELECT doc_id, host, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM ln),
freq AS (SELECT host, l FROM norm WHERE n > 0 GROUP BY ALL HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
lost AS (SELECT doc_id, sum(n)::BIGINT AS words_removed FROM norm JOIN freq USING (host, l) GROUP BY ALL),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
v AS (SELECT base.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed, coalesce(words_removed, 0) AS words_removed FROM base LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - words_removed >= {MIN_LEFT} AND 2 * (n_words - words_removed) >= n_words AS kept, words_removed FROM v"""

_OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT reach.v, e.b FROM reach JOIN e ON e.a = reach.r)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept FROM d JOIN reach ON v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

_OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS name, len({_WORDS})::BIGINT AS size, ('0x' || md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, ''))[1:8])::BIGINT % {BINS} AS bin FROM documents),
c AS (SELECT *, length(bin(size)) AS cls FROM d),
src AS (SELECT name, sum(size)::BIGINT AS ss, {list(WEIGHTS)}[(row_number() OVER (ORDER BY name = 'null', name) - 1) % {len(WEIGHTS)} + 1] AS w FROM c GROUP BY name),
ord AS (SELECT *, row_number() OVER o AS k, coalesce(sum({MAX_EPOCHS} * ss) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_ FROM src WHERE ss > 0 WINDOW o AS (ORDER BY ss::DOUBLE / w, name)),
lvl AS (SELECT (SELECT sum(ss) FROM src)::DOUBLE - arg_min(used, k) AS left_, arg_min(open_, k) AS open_ FROM ord WHERE ((SELECT sum(ss) FROM src)::DOUBLE - used) * w / open_ <= {MAX_EPOCHS} * ss),
t AS (SELECT name, ss, CASE WHEN ss = 0 THEN 0 WHEN left_ * w / open_ > {MAX_EPOCHS} * ss THEN {MAX_EPOCHS} * ss ELSE left_ * w / open_ END::DOUBLE AS target FROM src, lvl),
rate AS (SELECT *, CASE WHEN ss > 0 THEN least({MAX_EPOCHS}::DOUBLE, target / ss) ELSE 0 END AS r FROM t),
cum AS (SELECT name, cls, bin, sum(sum(size)) OVER (PARTITION BY name, cls ORDER BY bin)::DOUBLE AS reached FROM c GROUP BY name, cls, bin),
cl AS (SELECT name, cls, list_prepend(0::DOUBLE, list(reached ORDER BY bin)) AS rs, list_prepend(0, list(bin + 1 ORDER BY bin)) AS es, row_number() OVER (PARTITION BY name ORDER BY cls DESC) AS j FROM cum GROUP BY name, cls),
walk AS (SELECT name, 0::BIGINT AS j, 0::DOUBLE AS carry, 0::BIGINT AS cls, 0::BIGINT AS below FROM rate
  UNION ALL SELECT name, j, goal - rs[i], cls, es[i] FROM (SELECT *, list_position(list_transform(rs, lambda x: abs(x - goal)), list_min(list_transform(rs, lambda x: abs(x - goal)))) AS i FROM (SELECT walk.name, cl.j, cl.cls, rs, es, carry + (r - floor(r)) * rs[-1] AS goal FROM walk JOIN cl ON cl.name = walk.name AND cl.j = walk.j + 1 JOIN rate ON rate.name = walk.name)))
SELECT doc_id, size, ss AS source_size, target, (size * (floor(r) + CASE WHEN bin < below THEN 1 ELSE 0 END))::BIGINT AS taken, source FROM c JOIN rate USING (name) JOIN walk USING (name, cls) WHERE j > 0"""

_OP10 = rf"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, pos, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM raw),
ln AS (SELECT doc_id, pos, w, len(w) AS n, w[1 : {LEADING}] AS lead, array_to_string(w, ' ') AS line FROM tok WHERE len(w) > 0),
met AS (SELECT * FROM ln SEMI JOIN (SELECT n, lead FROM ln GROUP BY ALL HAVING count(DISTINCT doc_id) > 1) USING (n, lead)),
cls AS (SELECT n, lead, line, any_value(w) AS w, count(*) AS docs FROM met GROUP BY n, lead, line),
walk AS (SELECT n, lead, line, w, docs, NULL::VARCHAR AS template FROM cls
  UNION ALL SELECT n, lead, line, w, docs, CASE WHEN line = top OR 100.0 * len(list_filter(list_zip(w, top_w), lambda z: z[1] = z[2])) / n >= {MATCH} THEN top END
  FROM (SELECT *, first_value(line) OVER g AS top, first_value(w) OVER g AS top_w FROM walk WHERE template IS NULL WINDOW g AS (PARTITION BY n, lead ORDER BY docs DESC, line DESC))),
placed AS (SELECT DISTINCT template, doc_id, pos, met.n FROM met JOIN walk USING (line) WHERE template IS NOT NULL),
rec AS (SELECT template, min(doc_id) AS first_id FROM placed GROUP BY 1 HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
gone AS (SELECT doc_id, pos, n FROM placed JOIN rec USING (template) WHERE doc_id <> first_id),
kept AS (SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS n_gone, sum(gone.n) AS lost, string_agg(line, chr(10) ORDER BY raw.pos) FILTER (gone.pos IS NULL) AS t FROM raw LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_gone, 0)::INT AS dropped_lines, coalesce(lost, 0)::BIGINT AS dropped_tokens, strlen(coalesce(t, ''))::BIGINT AS kept_bytes, md5(coalesce(t, '')) AS kept_md5 FROM documents LEFT JOIN kept USING (doc_id)"""

ORACLE: dict[str, str] = {"op4_warc": _OP4, "op5_sharding": sharding_sql(8, 20_240_229), "op7_rules": _OP7, "op8_mixing": _OP8, "op9_nearduplicates": _OP9, "op10_linetemplates": _OP10}

"""DuckDB SQL for the operators that SQL can state."""

ORACLES: dict[str, str] = {}

ORACLES["op5_exact_dedup"] = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT doc_id, text_sha256, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
        row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS rn
      FROM t WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM g
"""

_MEASURED = r"""
w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
k AS (SELECT w.*, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        row_number() OVER () AS rid FROM w),
tri AS (SELECT rid, u.i AS i, words[u.i] || ' ' || words[u.i + 1] || ' ' || words[u.i + 2] AS g
        FROM k, unnest(range(1, len(words) - 1)) AS u(i)),
rep AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT i + d.j) AS r FROM rep, (VALUES (0), (1), (2)) AS d(j) GROUP BY rid),
m AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(r, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
      FROM k LEFT JOIN cov USING (rid))"""

_QUALITY = (
    "WITH "
    + _MEASURED
    + """,
p AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS r1,
        CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS r2,
        CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS r3,
        CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS r4 FROM m),
long AS (SELECT lang, source, ratio, v FROM (SELECT * FROM p WHERE n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words) UNPIVOT (v FOR ratio IN (r1, r2, r3, r4))),
b AS (SELECT lang, source, ratio, v - v % (1::BIGINT << greatest(length(bin(v)) - 6, 0)::INT) AS bucket, 1000 * count(*) AS weight FROM long GROUP BY ALL),
-- the corpus, then languages with a prior of the corpus, then sources with a prior of their language
q3 AS (SELECT ratio, bucket, sum(weight)::BIGINT AS weight FROM b GROUP BY ALL),
s3 AS (SELECT ratio, bucket, floor(weight::DOUBLE * 100000::DOUBLE / (sum(weight) OVER (PARTITION BY ratio))::DOUBLE)::BIGINT AS weight FROM q3),
q2 AS (SELECT lang, ratio, bucket, sum(weight)::BIGINT AS weight FROM (SELECT lang, ratio, bucket, weight FROM b
  UNION ALL SELECT lang, g.ratio, bucket, weight FROM (SELECT DISTINCT lang, ratio FROM b) g JOIN s3 ON g.ratio = s3.ratio) GROUP BY ALL),
s2 AS (SELECT lang, ratio, bucket, floor(weight::DOUBLE * 100000::DOUBLE / (sum(weight) OVER (PARTITION BY lang, ratio))::DOUBLE)::BIGINT AS weight FROM q2),
q1 AS (SELECT lang, source, ratio, bucket, sum(weight)::BIGINT AS weight FROM (SELECT * FROM b
  UNION ALL SELECT g.lang, g.source, g.ratio, bucket, weight FROM (SELECT DISTINCT lang, source, ratio FROM b) g JOIN s2 ON g.lang IS NOT DISTINCT FROM s2.lang AND g.ratio = s2.ratio) GROUP BY ALL),
every AS (SELECT false AS whole, lang, source, ratio, bucket, weight FROM q1 UNION ALL SELECT true, NULL, NULL, ratio, bucket, weight FROM q3),
run AS (SELECT *, sum(weight) OVER (PARTITION BY whole, lang, source, ratio ORDER BY bucket) AS upto, sum(weight) OVER g AS total,
        coalesce(sum(weight) FILTER (bucket = 0) OVER g, 0) AS zero FROM every WINDOW g AS (PARTITION BY whole, lang, source, ratio)),
marks AS (SELECT whole, lang, source, ratio, min(bucket) FILTER (upto * 4 >= total) AS low, min(bucket) FILTER (upto * 2 >= total) AS mid, min(bucket) FILTER (upto * 4 >= total * 3) AS high,
        coalesce(min(bucket) FILTER (bucket > 0 AND (upto - zero) * 4 >= (total - zero) * CASE ratio WHEN 'r2' THEN 1 ELSE 3 END), 0) AS usual FROM run GROUP BY ALL),
reach AS (SELECT whole, lang, source, ratio, mid, CASE ratio WHEN 'r1' THEN 5 * (high - low + mid // 32) ELSE greatest(high + 12 * (high - mid), CASE ratio WHEN 'r2' THEN usual // 2 WHEN 'r3' THEN 2 * usual ELSE 8 * usual END) END AS reach FROM marks),
v AS (SELECT a.lang, a.source, max(a.mid - least(a.reach, 2 * c.reach)) FILTER (a.ratio = 'r1') AS b0, max(a.mid + least(a.reach, 2 * c.reach)) FILTER (a.ratio = 'r1') AS b1,
        max(least(a.reach, 2 * c.reach)) FILTER (a.ratio = 'r2') AS b2, max(least(a.reach, 2 * c.reach)) FILTER (a.ratio = 'r3') AS b3, max(least(a.reach, 2 * c.reach)) FILTER (a.ratio = 'r4') AS b4
      FROM reach a JOIN reach c ON a.ratio = c.ratio AND c.whole AND NOT a.whole GROUP BY ALL),
j AS (SELECT p.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        coalesce(r1 < b0 OR r1 > b1 OR r2 > b2 OR r3 > b3 OR r4 > b4, false) AS bad
      FROM p LEFT JOIN v ON p.lang IS NOT DISTINCT FROM v.lang AND p.source IS NOT DISTINCT FROM v.source)
"""
)

ORACLES["op6_quality_rules"] = _QUALITY + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM j"

# formatted_chars: 12 + 10 + 10 characters of control strings a turn, and one more for each escape
ORACLES["op10_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
        sum(32 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

# of rows that repeat in full one comes first, as in the operator; rows that share a doc_id with different texts are ordered by a hash of the text there
ORACLES["op7_line_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT rid, doc_id, u.i AS i, lines[u.i:u.i + 2] AS win FROM d, unnest(range(1, len(lines) - 1)) AS u(i)),
later AS (SELECT rid, i FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, rid, i) > 1),
gone AS (SELECT DISTINCT rid, i + o.j AS i FROM later, (VALUES (0), (1), (2)) AS o(j)),
n AS (SELECT rid, count(*) AS n, list(i) AS gone FROM gone GROUP BY rid)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: lines[i]), chr(10))) AS kept_sha256
FROM d LEFT JOIN n USING (rid)
"""

ORACLES["op4_mixing"] = r"""
WITH s0 AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, 'mix-1|' || coalesce(doc_id, -1) || '|' || md5(coalesce(text, '')) AS one FROM documents),
s AS (SELECT doc_id, source, size, CASE WHEN nth = 1 THEN one ELSE one || '|' || nth END AS draw FROM (SELECT *, row_number() OVER (PARTITION BY one, source) AS nth FROM s0)),
b AS (SELECT *, round(16.0::DOUBLE * sqrt((size - size % (1::BIGINT << greatest(length(bin(size)) - 6, 0)::INT))::DOUBLE))::BIGINT AS wt FROM s),
f AS (SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s GROUP BY source),
g AS (SELECT *, 2.0::DOUBLE * source_size / w AS full_at FROM f),
l AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
  2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM g),
v AS (SELECT (budget - filled) / open_w AS level FROM l WHERE (budget - filled) / open_w <= full_at ORDER BY full_at, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, w * level), 2.0::DOUBLE * source_size) AS target FROM l LEFT JOIN v ON true),
h AS (SELECT source, wt, sum(size)::BIGINT AS words FROM b WHERE size > 0 GROUP BY 1, 2),
i AS (SELECT h.source, wt, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY h.source ORDER BY wt DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(wt * words) OVER (PARTITION BY h.source ORDER BY wt DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS scale
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, first(scale ORDER BY wt DESC) AS scale FROM i WHERE scale * wt <= 2 GROUP BY 1),
e AS (SELECT b.*, t.source_size, t.target, CASE WHEN size > 0 THEN least(2.0::DOUBLE, coalesce(scale * wt, 2.0)) ELSE 0 END AS e
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON b.source IS NOT DISTINCT FROM c.source),
p AS (SELECT *, floor(e)::BIGINT AS certain, e - floor(e) AS p,
  (cast('0x' || substr(md5(draw), 1, 12) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM e),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM p),
k AS (SELECT *, floor(odds / (1 + odds) * 281474976710656::DOUBLE)::BIGINT AS k, target - sum(certain * size) OVER (PARTITION BY source) AS rest FROM o),
r AS (SELECT *, k IS NOT NULL AND coalesce(sum(CASE WHEN k IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY k NULLS LAST, coalesce(doc_id, -1), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE <= rest AS sampled FROM k)
SELECT doc_id, size, source_size, target, ((certain + sampled::INT) * size)::BIGINT AS taken FROM r
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES["op11_source_divergence"] = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT rid, lang, source, unnest(terms) AS term FROM t),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM t),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v) AS p,
        1 + 1000000000 * (k.n + 2) // (v.n + 2 * v.v) AS q
      FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
d AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
      FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM x WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""

#: The table that crc32 looks bytes up in, and the checksum of the UTF-8 of a text with it.
_CRC_TABLE = """crc AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) AS r(i)))"""
_BYTES = "list_transform(range(0, strlen({s})), lambda i: ('0x' || substr(hex({s}), 2 * i + 1, 2))::BIGINT)"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"

ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
k AS (SELECT doc, run, count(*) AS n FROM o WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, length(run) AS len, {_CRC.format(s="(doc || ':' || run)")} AS h FROM k, crc),
e AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % len)::INT) || substr(run, (h % len)::INT + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS len FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
-- two words are near if both without one letter at the same place, or one without a letter and the other, are equal
d AS (SELECT word, u.i AS i, substr(word, 1, u.i) || substr(word, u.i + 2) AS rest FROM w, unnest(range(0, len)) AS u(i)),
p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word < b.word
  UNION SELECT w.word, d.word FROM d JOIN w ON w.word = d.rest),
l AS (SELECT a AS word, b AS near FROM p UNION SELECT b, a FROM p),
f AS (SELECT l.word, count(*) AS n_near, max(y.n) AS top, first(l.near ORDER BY y.n DESC, l.near) AS near
      FROM l JOIN w y ON y.word = l.near GROUP BY l.word),
z AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN near END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN f ON f.word = w.word),
c AS (SELECT word, word AS here, 0 AS steps FROM z UNION ALL SELECT c.word, z.form, steps + 1 FROM c JOIN z ON z.word = c.here WHERE z.form IS NOT NULL),
r AS (SELECT word, arg_max(here, steps) AS root FROM c GROUP BY word)
SELECT z.word, form, root, n, n_near, form_n FROM z JOIN r ON r.word = z.word
"""

_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_ASSIGN = "(" + "|".join(_ANY_CASE(w) for w in ("password", "passwd", "secret", "token")) + "|" + _ANY_CASE("api") + "_?" + _ANY_CASE("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRET_KINDS = [("assign", _ASSIGN, 2, "length(g) >= 8"), ("access", "(AKIA[A-Z0-9]+)", 1, "length(g) >= 16"), ("hex", "([0-9a-f]{32,})", 1, "true"), ("github", "gh[pousr]_([A-Za-z0-9]{36})", 1, "sum62(g)"), ("npm", "npm_([A-Za-z0-9]{36})", 1, "sum62(g)")]
_DIGIT = "substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 1 + (c // {p} % 62)::INT, 1)"
_SUM62 = "substr(g, 31) = (SELECT " + " || ".join(_DIGIT.format(p=62**i) for i in range(5, -1, -1)) + f" FROM (SELECT {_CRC.format(s='substr(g, 1, 30)')} AS c FROM crc))"

ORACLES["op13_secret_scan"] = f"""
WITH {_CRC_TABLE},
t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS s FROM documents),
""" + ",\n".join(
    f"""m{i} AS (SELECT rid, regexp_extract_all(s, '{p}') AS m, regexp_extract_all(s, '{p}', {part}) AS g, string_split_regex(s, '{p}') AS between FROM t WHERE regexp_matches(s, '{p}')),
k{i} AS (SELECT rid, {i} AS k, '{kind}' AS kind, m[u.i] AS m, g[u.i] AS g, (coalesce(list_sum(list_transform(between[1:u.i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:u.i - 1], lambda x: length(x))), 0))::BIGINT AS place
  FROM m{i}, unnest(range(1, len(m) + 1)) AS u(i)),
f{i} AS (SELECT rid, k, place, kind || ':' || place || ':' || place + length(m) AS told FROM k{i} WHERE {_SUM62 if ok.startswith("sum62") else ok})"""
    for i, (kind, p, part, ok) in enumerate(_SECRET_KINDS)
) + """,
f AS (""" + " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(len(_SECRET_KINDS))) + """),
a AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(told, ',' ORDER BY place, k) FILTER (k < 3) AS base, string_agg(told, ',' ORDER BY place, k) AS every FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM t LEFT JOIN a USING (rid)
"""

ORACLES["op1_suffix_dedup"] = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
w AS (SELECT r, u.i AS i, md5_number(h[2 * u.i + 1 : 2 * u.i + 400]) AS k FROM t, unnest(range(0, n_bytes - 199)) AS u(i)),
dup AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
b AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS begins FROM dup),
g AS (SELECT r, i, sum(begins) OVER (PARTITION BY r ORDER BY i) AS run FROM b),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY r, run),
x AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
k AS (SELECT t.r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed,
        string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM x JOIN t USING (r) GROUP BY t.r)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN k USING (r)
"""

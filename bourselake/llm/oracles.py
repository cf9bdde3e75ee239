"""SQL for the operators that SQL can express."""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = r"[^\x20\x09-\x0D]+"
_NEXT = ", ".join(f"lead(word, {i}) OVER o" for i in range(1, 20))

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_PLAIN}'), []) AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM d),
k AS (SELECT doc_id, pos, n, concat_ws(' ', word, {_NEXT}) AS k FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS rn FROM k WHERE pos + 19 <= n),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r WHERE rn > 1),
s AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) FILTER (WHERE g.pos IS NULL) AS kept, COUNT(g.pos) AS gone FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY e.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(s.gone, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '{_ALNUM}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
l AS (SELECT DISTINCT n FROM i), e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM e),
m AS (SELECT g.doc_id, g.pos, l.n, i.item_id FROM g, l JOIN i ON i.n = l.n WHERE len(g.ws) >= l.n AND i.k = array_to_string(g.ws[1:l.n], ' ')),
h AS (SELECT doc_id, COUNT(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


#: CRC-32 bit by bit in SQL: its table, then a fold over the bytes of each distinct string of k(s).
_CRC32 = """
ct AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
kb AS (SELECT s, list_transform(range(0, len(hex(encode(s))) // 2), lambda i: CAST('0x' || hex(encode(s))[2 * i + 1:2 * i + 2] AS BIGINT)) AS b FROM k),
crc AS (SELECT s, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS crc FROM kb, ct)"""

RESAMPLE = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '{_ALNUM}'), []) AS w FROM documents),
b AS (SELECT coalesce(regexp_extract_all({_LOW}, '{_ALNUM}'), []) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS s FROM d), bw AS (SELECT unnest(w) AS s FROM b), k AS (SELECT s FROM dw UNION SELECT s FROM bw), {_CRC32},
sc AS (SELECT crc % 10000 AS bucket, COUNT(*) AS n FROM dw JOIN crc USING (s) GROUP BY 1), tc AS (SELECT crc % 10000 AS bucket, COUNT(*) AS n FROM bw JOIN crc USING (s) GROUP BY 1),
al AS (SELECT (SELECT coalesce(SUM(n), 0) FROM sc)::DOUBLE AS ss, (SELECT coalesce(SUM(n), 0) FROM tc)::DOUBLE AS tt),
g AS (SELECT r.bucket, CAST(floor(1000 * ln((coalesce(tc.n, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(sc.n, 0) + 1)::DOUBLE * (tt + 10000)))) AS BIGINT) AS gain FROM range(10000) r(bucket) LEFT JOIN sc USING (bucket) LEFT JOIN tc USING (bucket), al),
we AS (SELECT doc_id, CAST(SUM(gain) AS BIGINT) AS weight FROM dw JOIN crc USING (s) JOIN g ON g.bucket = crc % 10000 GROUP BY doc_id),
x AS (SELECT d.doc_id, len(d.w)::BIGINT AS n, coalesce(we.weight, 0) AS weight, coalesce(we.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256(concat('2024:', d.doc_id))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN we USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, COUNT(*) OVER () AS total FROM x WHERE n >= 20)
SELECT x.doc_id, x.n AS n_features, x.weight, x.score, o.nth AS rank FROM x LEFT JOIN o ON o.doc_id = x.doc_id AND o.nth <= 10 * o.total // 100"""

_CUT = "s[1:i - 1] || s[i + 1:]"
VARIANTS = f"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents), u AS (SELECT doc_id, run, concat(doc_id, ':', run) AS s, COUNT(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
k AS (SELECT DISTINCT s FROM u), {_CRC32},
v AS (SELECT CASE WHEN crc % 31 = 0 THEN run[1:crc % length(run)] || run[crc % length(run) + 2:] ELSE run END AS s, n FROM u JOIN crc USING (s)),
w AS (SELECT s, CAST(SUM(n) AS BIGINT) AS n FROM v WHERE length(s) >= 7 GROUP BY s HAVING SUM(n) >= 2),
c AS (SELECT s, n, i, {_CUT} AS cut FROM (SELECT s, n, unnest(range(1, length(s) + 1)) AS i FROM w)),
p AS (SELECT a.s AS a, b.s AS b, b.n AS n FROM c a JOIN c b ON a.cut = b.cut AND a.i = b.i AND a.s <> b.s UNION SELECT c.s, w.s, w.n FROM c JOIN w ON c.cut = w.s UNION SELECT w.s, c.s, c.n FROM c JOIN w ON c.cut = w.s),
q AS (SELECT a, COUNT(*) AS n_near, arg_min(b, (-n, b)) AS b, MAX(n) AS top FROM p GROUP BY a),
f AS (SELECT w.s AS word, CASE WHEN q.top >= 10 * w.n THEN q.b END AS form, w.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.top >= 10 * w.n THEN q.top END AS form_n FROM w LEFT JOIN q ON q.a = w.s),
o AS (WITH RECURSIVE z AS (SELECT word, form AS root, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT z.word, f.form, step + 1 FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL) SELECT word, arg_max(root, step) AS root FROM z GROUP BY word)
SELECT f.word, f.form, coalesce(o.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN o ON o.word = f.word"""

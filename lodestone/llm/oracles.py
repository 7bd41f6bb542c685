"""DuckDB SQL for the operators that SQL can express over whole tables at test scale."""

from __future__ import annotations

from . import line_dedup

#: words of every text, with their place from 1: {table}(id, n, w)
_WORDS = """{name} AS (SELECT id, generate_subscripts(ws, 1) AS n, unnest(ws) AS w FROM (SELECT {key} AS id, regexp_extract_all({text}, '{pattern}') AS ws FROM {table}))"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "[^ \\t\\n\\x0B\\f\\r]+"
_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

OP1 = f"""WITH {_WORDS.format(name='words', key='doc_id', text='text', pattern=_BLANK, table='documents')},
win AS (SELECT id, n, string_agg(w, ' ') OVER s AS g, count(*) OVER s AS k FROM words WINDOW s AS (PARTITION BY id ORDER BY n ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
again AS (SELECT id, n FROM (SELECT id, n, row_number() OVER (PARTITION BY g ORDER BY id, n) AS r FROM win WHERE k = 20) WHERE r > 1),
gone AS (SELECT DISTINCT id, n + i AS n FROM again, range(20) r(i)),
kept AS (SELECT id, count(*) AS kept, string_agg(w, ' ' ORDER BY n) AS text FROM words WHERE (id, n) NOT IN (SELECT id, n FROM gone) GROUP BY id),
total AS (SELECT id, count(*) AS n FROM words GROUP BY id)
SELECT d.doc_id, coalesce(t.n, 0) AS n_words, coalesce(t.n, 0) - coalesce(k.kept, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN total t ON t.id = d.doc_id LEFT JOIN kept k ON k.id = d.doc_id"""

OP3 = r"""WITH chats AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
hidden AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|### |</turn>| says: ')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM chats),
states AS (SELECT *, lag(role, 1, 'begin') OVER (PARTITION BY conv_id ORDER BY i) AS before, count(*) OVER (PARTITION BY conv_id) AS k FROM hidden)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n + length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' ELSE '### Assistant: ' END) + 9)::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before = 'begin' WHEN 'user' THEN before IN ('begin', 'system', 'assistant') ELSE before = 'user' END) AND bool_or(i = k AND role = 'assistant') AS complete
FROM states GROUP BY conv_id"""

OP4 = f"""WITH {_WORDS.format(name='words', key='doc_id', text=_LOWER.format('text'), pattern=_ALNUM, table='documents')},
{_WORDS.format(name='asked', key='item_id', text=_LOWER.format('text'), pattern=_ALNUM, table='benchmark')},
sizes AS (SELECT id, least(13, count(*)) AS k FROM asked GROUP BY id),
item AS (SELECT DISTINCT a.id AS item, s.k, list(a.w) OVER (PARTITION BY a.id ORDER BY a.n ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)[1:s.k] AS g FROM asked a JOIN sizes s USING (id)),
needle AS (SELECT item, k, array_to_string(g, ' ') AS g FROM item WHERE len(g) = k),
doc AS (SELECT id, n, list(w) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM words),
hay AS (SELECT id, n, k, array_to_string(g[1:k], ' ') AS g FROM doc, (SELECT DISTINCT k FROM needle) WHERE len(g) >= k),
found AS (SELECT h.id, h.n, h.k, x.item FROM hay h JOIN needle x ON x.g = h.g AND x.k = h.k),
hits AS (SELECT id, count(DISTINCT n + i) AS n_hit FROM found, range(13) r(i) WHERE i < k GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM found) GROUP BY id),
total AS (SELECT id, count(*) AS n FROM words GROUP BY id)
SELECT d.doc_id, coalesce(t.n, 0) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= coalesce(t.n, 0) AS contaminated
FROM documents d LEFT JOIN total t ON t.id = d.doc_id LEFT JOIN hits h ON h.id = d.doc_id LEFT JOIN items i ON i.id = d.doc_id"""

OP10 = f"""WITH RECURSIVE {_WORDS.format(name='words', key='doc_id', text=_LOWER.format('text'), pattern=_BLANK, table='documents')},
win AS (SELECT id, n, string_agg(w, ' ') OVER (PARTITION BY id ORDER BY n ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS g, count(*) OVER (PARTITION BY id) AS k FROM words),
shingle AS (SELECT DISTINCT id, g FROM win WHERE n <= greatest(k - 2, 1)),
size AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
pair AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingle a JOIN shingle b USING (g) WHERE a.id < b.id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT r.id AS doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN size s ON s.id = r.id GROUP BY r.id"""

#: crc32 of an id's decimal text
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({id}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


OP11 = f"""WITH RECURSIVE told AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars')))} AS head, text, {_CRC.format(id='doc_id')} % 2 = 0 AS tampered FROM documents),
leaf AS (SELECT doc_id, g, sha256(head || {_field('text')}) AS leaf, CASE WHEN tampered THEN sha256(head || {_field("replace(text, chr(10), '')")}) ELSE sha256(head || {_field('text')}) END AS seen,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM told),
low(g, level, place, n, h) AS (SELECT g, 0, place, n, leaf FROM leaf
  UNION ALL SELECT g, any_value(level) + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY g, place // 3),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, place, n, h) AS (SELECT 0, place, n, h FROM sub
  UNION ALL SELECT any_value(level) + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY place // 3),
steps AS (SELECT l.doc_id, l.g, t.level, string_agg(t.h, '' ORDER BY t.place) FILTER (WHERE t.place < l.place // (3 ** t.level)::BIGINT) AS a, string_agg(t.h, '' ORDER BY t.place) FILTER (WHERE t.place > l.place // (3 ** t.level)::BIGINT) AS b
  FROM leaf l JOIN low t ON t.g = l.g AND t.n > 1 AND t.place // 3 = l.place // (3 ** (t.level + 1))::BIGINT GROUP BY l.doc_id, l.g, l.leaf, t.level
  UNION ALL SELECT l.doc_id, l.g, 1000 + t.level, string_agg(t.h, '' ORDER BY t.place) FILTER (WHERE t.place < s.place // (3 ** t.level)::BIGINT), string_agg(t.h, '' ORDER BY t.place) FILTER (WHERE t.place > s.place // (3 ** t.level)::BIGINT)
  FROM leaf l JOIN sub s USING (g) JOIN high t ON t.n > 1 AND t.place // 3 = s.place // (3 ** (t.level + 1))::BIGINT GROUP BY l.doc_id, l.g, l.leaf, t.level),
proof AS (SELECT doc_id, g, list({{'a': coalesce(a, ''), 'b': coalesce(b, '')}} ORDER BY level) AS p FROM steps GROUP BY ALL),
folded(doc_id, g, i, p, h) AS (SELECT l.doc_id, l.g, 1, coalesce(p, []), seen FROM leaf l LEFT JOIN proof USING (doc_id, g)
  UNION ALL SELECT doc_id, g, i + 1, p, sha256(p[i].a || h || p[i].b) FROM folded WHERE i <= len(p))
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(array_to_string(list_transform(f.p, lambda x: x.a || x.b), '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaf l JOIN sub s USING (g) JOIN high r ON r.n = 1 JOIN folded f ON f.doc_id = l.doc_id AND f.g = l.g AND f.i = len(f.p) + 1"""

OP13 = f"""WITH told AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS k, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_CRC.format(id='c')} % 6 AS h FROM (SELECT DISTINCT c FROM told)),
built AS (SELECT i.c, 0 AS part, t.k, r, x FROM ids i JOIN told t ON t.c = i.c - i.c % 100 WHERE t.k < i.h UNION ALL SELECT i.c, 1, t.k, r, x FROM ids i JOIN told t ON t.c = i.c WHERE t.k >= i.h),
path AS (SELECT c, row_number() OVER w AS d, length(x) AS m, string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER w AS p FROM built WINDOW w AS (PARTITION BY c ORDER BY part, k) UNION ALL SELECT c, 0, 0, '' FROM ids),
node AS (SELECT p, d, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(m) AS saved FROM path GROUP BY p, d),
last AS (SELECT c, max(d) AS d FROM path GROUP BY c),
ends AS (SELECT p, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM path JOIN last USING (c, d) GROUP BY p),
child AS (SELECT a.p, count(*) AS n FROM node u JOIN path a ON a.c = u.c AND a.d = u.d - 1 GROUP BY a.p),
tree AS (SELECT a.p, sum(u.saved)::BIGINT AS saved, (count(*) FILTER (WHERE x.p IS NULL))::BIGINT AS leaves FROM node u LEFT JOIN child x ON x.p = u.p JOIN path a ON a.c = u.c AND a.d <= u.d GROUP BY a.p)
SELECT u.c AS conv_id, u.d AS depth, o.c AS parent_conv_id, u.n AS n_convs, coalesce(x.n, 0) AS n_children, t.leaves AS n_leaves, t.saved AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM node u JOIN tree t ON t.p = u.p LEFT JOIN child x ON x.p = u.p LEFT JOIN ends e ON e.p = u.p LEFT JOIN path a ON a.c = u.c AND a.d = u.d - 1 LEFT JOIN node o ON o.p = a.p"""

ORACLE_SQL = {
    "op1_substring_dedup": OP1,
    "op2_line_dedup": line_dedup.SQL,
    "op3_chat_format": OP3,
    "op4_decontaminate": OP4,
    "op10_jaccard_join": OP10,
    "op11_merkle_manifest": OP11,
    "op13_prefix_trie": OP13,
}

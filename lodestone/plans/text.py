"""Queries over text functions, chunks and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import scores as S
from ..functions import text as T
from ..operators import retrieval as R
from ..operators.tokens import calibration
from ..sources import views as V
from .registry import query
from .retrieval import sql_terms


def docs(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query("WITH src AS (SELECT doc_id AS id, text FROM documents), " + sql_terms("tm", "src", "id", "text", 80) + " SELECT id, term FROM tm")
def document_terms(spark, d):
    return docs(spark, d).select("id", F.explode(T.terms(F.col("text"))).alias("term"))


@query("SELECT doc_id AS id, greatest(1, floor(len(regexp_extract_all(text, '[^\\s]+')) * 1.35::DOUBLE)::BIGINT + length(text) // 18) AS tokens FROM documents")
def token_estimates(spark, d):
    return docs(spark, d).select("id", T.token_estimate(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id AS id, sha256(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def content_hashes(spark, d):
    return docs(spark, d).select("id", T.content_hash(F.col("text")).alias("digest"))


@query("SELECT doc_id AS id, sha256(array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), 1, 200), ' ')) AS digest FROM documents")
def semantic_fingerprints(spark, d):
    return docs(spark, d).select("id", T.fingerprint(F.col("text")).alias("digest"))


#: documents with an ending that brings every content class and every kind of secret about
MARKED = r"""
marked AS (SELECT doc_id AS id, CASE doc_id % 11
  WHEN 0 THEN '  ' WHEN 1 THEN '{"a": 1, ' || text WHEN 2 THEN text || chr(10) || '## part' WHEN 3 THEN text || ' x => y' WHEN 4 THEN '记忆检索系统的回归测试与得分' || left(text, 12)
  WHEN 5 THEN left(text, 90) || ' with ndcg and f1' WHEN 6 THEN text || ' Authorization: Bearer ab.c-1=' WHEN 7 THEN text || ' Api_Key = k"q pwd:short' WHEN 8 THEN text || ' sk-abcdefgh12345 stdout'
  WHEN 9 THEN text || ' -----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'MIIE' || chr(10) || '-----END RSA PRIVATE KEY----- ok' ELSE text END AS text FROM documents)"""


def marked(spark, d):
    t, i = F.col("text"), F.col("doc_id") % 11
    endings = {2: "\n## part", 3: " x => y", 6: " Authorization: Bearer ab.c-1=", 7: ' Api_Key = k"q pwd:short', 8: " sk-abcdefgh12345 stdout", 9: " -----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY----- ok"}
    out = F.when(i == 0, "  ").when(i == 1, F.concat(F.lit('{"a": 1, '), t)).when(i == 4, F.concat(F.lit("记忆检索系统的回归测试与得分"), F.substring(t, 1, 12))).when(i == 5, F.concat(F.substring(t, 1, 90), F.lit(" with ndcg and f1")))
    for k, e in endings.items():
        out = out.when(i == k, F.concat(t, F.lit(e)))
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), out.otherwise(t).alias("text"))


KIND = r"""CASE WHEN s = '' THEN 'empty' WHEN contains(lower(s), 'traceback') OR regexp_matches(lower(s), '(^|[^\p{L}\p{N}_])(error|exception|warn|stderr|stdout)($|[^\p{L}\p{N}_])') THEN 'log'
  WHEN regexp_matches(s, '^[\{\[]') AND regexp_matches(s, '[:,"]') THEN 'json' WHEN contains(s, '```') OR regexp_matches(s, '(?m)^\s*#{1,6}\s+') OR regexp_matches(s, '(?m)^\s*[-*]\s+') THEN 'markdown'
  WHEN regexp_matches(s, '(^|[^\p{L}\p{N}_])(def|class|import|from|const|let|function|return|async|await)($|[^\p{L}\p{N}_])') OR contains(s, '=>') THEN 'code'
  WHEN len(regexp_extract_all(s, '[一-鿿]')) / length(s) > 0.25 THEN 'zh_text' WHEN regexp_matches(lower(s), '(^|[^\p{L}\p{N}_])(recall@|ndcg|gold_rank|candidate_recall|accuracy|f1|precision)($|[^\p{L}\p{N}_])') THEN 'metrics' ELSE 'prose' END"""
KINDS = rf", kinds AS (SELECT id, text, {KIND} AS kind FROM (SELECT id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM marked))"


@query("SELECT kind, count(*) AS n FROM kinds GROUP BY 1", MARKED + KINDS)
def content_classes(spark, d):
    return marked(spark, d).groupBy(T.content_class(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT id, kind, CASE kind WHEN 'empty' THEN 0 WHEN 'zh_text' THEN ceil(zh * 1.05::DOUBLE + (n - zh) / 4) ELSE greatest(1, ceil(n / CASE kind WHEN 'code' THEN 3.1 WHEN 'json' THEN 2.7 WHEN 'markdown' THEN 3.5 WHEN 'log' THEN 3.0 WHEN 'metrics' THEN 2.8 ELSE 4 END::DOUBLE)) END::BIGINT AS tokens FROM (SELECT id, kind, length(text) AS n, len(regexp_extract_all(text, '[一-鿿]')) AS zh FROM kinds)", MARKED + KINDS)
def heuristic_tokens(spark, d):
    rows = marked(spark, d).select("id", "text", F.explode(F.array(T.content_class(F.col("text")))).alias("kind"))
    return rows.select("id", "kind", T.class_tokens(F.col("text"), F.col("kind")).alias("tokens"))


@query("SELECT kind, round(ratio, 6) AS ratio FROM per UNION ALL SELECT 'default', round(avg(ratio), 6) FROM per", MARKED + KINDS + ", per AS (SELECT kind, avg(words / tokens) AS ratio FROM (SELECT kind, len(regexp_extract_all(text, '[^\\s]+')) AS words, CASE kind WHEN 'zh_text' THEN ceil(zh * 1.05::DOUBLE + (n - zh) / 4) ELSE greatest(1, ceil(n / CASE kind WHEN 'code' THEN 3.1 WHEN 'json' THEN 2.7 WHEN 'markdown' THEN 3.5 WHEN 'log' THEN 3.0 WHEN 'metrics' THEN 2.8 ELSE 4 END::DOUBLE)) END AS tokens FROM (SELECT *, length(text) AS n, len(regexp_extract_all(text, '[一-鿿]')) AS zh FROM kinds) WHERE kind <> 'empty') GROUP BY 1)")
def token_calibration(spark, d):
    """Mean ratio of a reference count (here words) to the estimate, by class."""
    # as the output of a generator the class is computed once, whatever reads it
    rows = marked(spark, d).select("text", F.explode(F.array(T.content_class(F.col("text")))).alias("kind"))
    pairs = rows.select("kind", F.size(T.words(F.col("text"))).alias("words"), T.class_tokens(F.col("text"), F.col("kind")).alias("tokens"))
    return calibration(pairs, "kind", "words", "tokens").select("kind", F.round("factor", 6).alias("ratio"))


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(authorization\s*:\s*bearer\s+)[A-Za-z0-9._\-+/=]+', '\1[REDACTED]', 'gi'),
  '((api[_-]?key|access[_-]?token|secret[_-]?key|password|passwd|pwd)\s*[:=]\s*)[^\s"'']+', '\1[REDACTED]', 'gi'), '\bsk-[A-Za-z0-9_\-]{12,}\b', '[REDACTED]', 'g'), '-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----', '[REDACTED]', 'gs')"""


@query(rf"""SELECT id, sha256(clean) AS digest, clean <> text AS changed, len(regexp_extract_all(clean, '\[REDACTED\]')) AS n,
  concat_ws(',', CASE WHEN regexp_matches(text, '(?i)authorization\s*:\s*bearer\s+[A-Za-z0-9._\-+/=]+') THEN 'bearer' END, CASE WHEN regexp_matches(text, '(?i)(api[_-]?key|access[_-]?token|secret[_-]?key|password|passwd|pwd)\s*[:=]\s*[^\s"'']+') THEN 'assignment' END,
    CASE WHEN regexp_matches(text, '\bsk-[A-Za-z0-9_\-]{{12,}}\b') THEN 'key' END, CASE WHEN regexp_matches(text, '(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----') THEN 'private_key' END) AS kinds FROM (SELECT id, text, {CLEAN} AS clean FROM marked)""", MARKED)
def redaction(spark, d):
    rows = marked(spark, d).withColumn("clean", T.redacted(F.col("text")))
    return rows.select("id", F.sha2("clean", 256).alias("digest"), (F.col("clean") != F.col("text")).alias("changed"), T.markers(F.col("clean")).cast("long").alias("n"), F.array_join(T.secret_kinds(F.col("text")), ",").alias("kinds"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[REDACTED]' ELSE k::VARCHAR END AS first, CASE WHEN event_id % 4 = 0 THEN 'my password: [REDACTED]' ELSE 'note ' || actor END AS note, (event_id % 3 = 0)::INT + (event_id % 4 = 0)::INT AS n FROM ledger", V.LEDGER)
def payload_redaction(spark, d):
    i = F.col("event_id")
    name = F.when(i % 3 == 0, F.lit("Access-Token")).otherwise("k")
    note = F.when(i % 4 == 0, F.concat(F.lit("my password: "), "actor")).otherwise(F.concat(F.lit("note "), "actor"))
    rows = V.ledger(spark, d).select("event_id", name.alias("name"), T.redacted_fields(F.create_map(name, F.col("k").cast("string"), F.lit("note"), note)).alias("m"))
    return rows.select("event_id", F.col("m")[F.col("name")].alias("first"), F.col("m")["note"].alias("note"), F.aggregate(F.map_values("m"), F.lit(0), lambda a, v: a + T.markers(v)).alias("n"))


@query("""SELECT id, i::INT AS i, start, least(start + 400, n) AS stop, sha256(substr(text, start + 1, 400)) AS digest FROM (
  SELECT doc_id AS id, text, length(text) AS n, unnest(CASE WHEN length(text) <= 400 THEN [0] ELSE range(0, length(text) - 50, 350) END) AS start, generate_subscripts(CASE WHEN length(text) <= 400 THEN [0] ELSE range(0, length(text) - 50, 350) END, 1) - 1 AS i FROM documents)""")
def char_chunks(spark, d):
    c = docs(spark, d).select("id", F.posexplode(T.char_chunks(F.col("text"), 400, 50)).alias("i", "c"))
    return c.select("id", "i", F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("stop"), F.sha2("c.text", 256).alias("digest"))


@query("SELECT id, i::INT AS i, sha256(string_agg(line, chr(10) ORDER BY place)) AS digest FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place, (generate_subscripts(string_split(text, chr(10)), 1) - 1) // 5 AS i FROM documents) GROUP BY 1, 2")
def line_chunks(spark, d):
    return docs(spark, d).select("id", F.posexplode(T.line_chunks(F.col("text"), 5)).alias("i", "c")).select("id", "i", F.sha2("c", 256).alias("digest"))


@query(r"SELECT id, sha256(substr(flat, 1, greatest(120, floor(length(flat) * 0.35::DOUBLE))::BIGINT)) AS digest FROM (SELECT doc_id AS id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)")
def compressed_text(spark, d):
    return docs(spark, d).select("id", F.sha2(T.compress(F.col("text")), 256).alias("digest"))


PAIRS = ", src AS (SELECT id, session_id, title FROM evidence), " + sql_terms("tt", "src", "id", "title", 20) + ", sets AS (SELECT id, list(term) AS ts FROM tt GROUP BY 1)"


@query("""SELECT a.id AS a, b.id AS b, round(0.55 * len(list_intersect(x.ts, y.ts)) / len(list_distinct(list_concat(x.ts, y.ts))) + 0.45 * len(list_intersect(x.ts, y.ts)) / sqrt(len(x.ts) * len(y.ts)), 6) AS score
  FROM src a JOIN src b ON a.session_id = b.session_id AND a.id < b.id JOIN sets x ON x.id = a.id JOIN sets y ON y.id = b.id""", V.EVIDENCE + PAIRS)
def lexical_pairs(spark, d):
    rows = V.evidence(spark, d).select("id", "session_id", T.terms(F.col("title"), 20).alias("ts")).filter(F.size("ts") > 0)
    a, b = rows.select("session_id", F.col("id").alias("a"), F.col("ts").alias("x")), rows.select("session_id", F.col("id").alias("b"), F.col("ts").alias("y"))
    return a.join(b, "session_id").filter("a < b").select("a", "b", F.round(T.lexical(F.col("x"), F.col("y")), 6).alias("score"))


@query("WITH src AS (SELECT doc_id AS id, text FROM documents ), " + sql_terms("tm", "src", "id", "text", 80) + """, part AS (SELECT id, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS i, CASE WHEN ('0x' || substr(sha256(term), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END AS s FROM tm),
  raw AS (SELECT id, i, sum(s)::DOUBLE AS v FROM part GROUP BY 1, 2), norm AS (SELECT id, sqrt(sum(v * v)) AS n FROM raw GROUP BY 1)
  SELECT id, i::INT AS i, round(v / n, 6) AS v FROM raw JOIN norm USING (id) WHERE v <> 0""")
def hash_embedding(spark, d):
    rows = docs(spark, d).select("id", F.explode(T.terms(F.col("text"), 80)).alias("term"))
    return R.hash_embeddings(rows).withColumn("v", F.round("v", 6))


@query("SELECT event_id, round(pow(0.5, greatest(0, (1735689600000000 - t) / 1000000 / 86400.0) / 30), 6) AS recency, CASE WHEN value <= 4 THEN 1 - value / 2 ELSE 1 / (1 + value) END AS similarity FROM ledger", V.LEDGER)
def score_scalars(spark, d):
    e = V.ledger(spark, d)
    return e.select("event_id", F.round(S.recency(F.col("t") / 1000000, 1735689600), 6).alias("recency"), S.distance_similarity(F.col("value")).alias("similarity"))


@query("SELECT run_id, CASE WHEN d < 0 THEN 0.45 ELSE 1 END * CASE WHEN abs(d) <= 3 THEN 1 WHEN abs(d) <= 30 THEN 0.88 WHEN abs(d) <= 120 THEN 0.7 WHEN abs(d) <= 365 THEN 0.5 WHEN abs(d) <= 730 THEN 0.32 ELSE 0 END AS anchor FROM (SELECT run_id, (820454400 - t) / 86400.0 AS d FROM runs)", V.RUNS)
def temporal_anchor(spark, d):
    return V.runs(spark, d).select("run_id", S.anchor_score((F.lit(820454400) - F.col("t")) / 86400.0).alias("anchor"))


@query("SELECT doc_id AS id, len(list_distinct(regexp_extract_all(text, '[A-Z][A-Za-z0-9_]{2,}'))) AS n FROM documents")
def capitalised_entities(spark, d):
    return docs(spark, d).select("id", F.size(T.capitalised(F.col("text"), 1 << 20)).cast("long").alias("n"))


@query("SELECT event_id, props, list_contains(json_keys(props), 'k') AS has_k, coalesce(json_extract_string(props, '$.k')::BIGINT, -1) AS k FROM events")
def json_fields(spark, d):
    e = V.table(spark, d, "events")
    return e.select("event_id", "props", F.array_contains(F.json_object_keys("props"), "k").alias("has_k"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"))


def _html_sql() -> str:
    t = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
    t = f"regexp_replace({t}, '<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)\\s*>', ' ', 'gis')"
    t = f"regexp_replace({t}, '<(br|/p|/div|/li|/h[1-6]|/tr|/title)\\b[^>]*>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for a, b in H.ENTITIES:
        t = f"replace({t}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    t = f"regexp_replace({t}, '[ \\t\\r]+', ' ', 'g')"
    return f"trim(regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g'))"


@query(f"SELECT page_id, url, sha256({_html_sql()}) AS digest FROM pages")
def page_text(spark, d):
    return V.table(spark, d, "pages").select("page_id", "url", F.sha2(H.to_text(F.col("html")), 256).alias("digest"))

"""Text as columns: terms, hashes, overlaps, token estimates, redaction, classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "[REDACTED]"
# Secrets that redaction replaces, in this order (name, pattern, replacement).
SECRETS = (
    ("bearer", r"(?i)(authorization\s*:\s*bearer\s+)[A-Za-z0-9._\-+/=]+", "$1" + MARKER),
    ("assignment", r"(?i)((?:api[_-]?key|access[_-]?token|secret[_-]?key|password|passwd|pwd)\s*[:=]\s*)[^\s\"']+", "$1" + MARKER),
    ("key", r"\bsk-[A-Za-z0-9_\-]{12,}\b", MARKER),
    ("private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", MARKER),
)
# Fixed value: names of payload fields whose values are secret whatever they hold.
SECRET_FIELD = r"(?i)(api[_-]?key|access[_-]?token|\btoken\b|secret|password|passwd|pwd|authorization)"
# Characters per token of a content class.
RATIOS = {"code": 3.1, "json": 2.7, "markdown": 3.5, "log": 3.0, "metrics": 2.8}
CJK = "[\u4e00-\u9fff]"


def terms(text: Column, n: int | None = 80) -> Column:
    """The first n different terms (None: all) of three characters or more, lower-case, in order."""
    every = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_./:-]{3,}"), 0))
    return every if n is None else F.slice(every, 1, n)


def capitalised(text: Column, n: int = 30) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z][A-Za-z0-9_]{2,}"), 0)), 1, n)


def normalised(text: Column) -> Column:
    """Lower-case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def content_hash(text: Column) -> Column:
    """sha256 after line ends are unified and outer white space goes."""
    return F.sha2(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"^\s+|\s+$", ""), 256)


def fingerprint(text: Column, n: int = 200) -> Column:
    """sha256 of the first n sorted different words."""
    return F.sha2(F.array_join(F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))), 1, n), " "), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of different items; 0 where either is empty."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / union)


def lexical(a: Column, b: Column) -> Column:
    """0.55 Jaccard and 0.45 cosine of two arrays of different items."""
    both = F.size(F.array_intersect(a, b))
    cosine = F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.sqrt((F.size(a) * F.size(b)).cast("double")))
    return 0.55 * jaccard(a, b) + 0.45 * cosine


def coverage(a: Column, b: Column) -> Column:
    """Share of a's items that b has."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\s]+"), 0)


def token_estimate(text: Column) -> Column:
    """max(1, int(words * 1.35) + int(characters / 18))."""
    return F.greatest(F.lit(1), F.floor(F.size(words(text)) * 1.35) + F.floor(F.length(text) / 18)).cast("long")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content_class(text: Column) -> Column:
    """empty, log, json, markdown, code, zh_text, metrics or prose: the first rule that holds. Null counts as empty."""
    s = stripped(F.coalesce(text, F.lit("")))
    has = lambda p, x=s: F.regexp_like(x, F.lit(p))
    chinese = F.regexp_count(s, F.lit(CJK))
    return (
        F.when(s == "", "empty")
        .when(F.contains(F.lower(s), F.lit("traceback")) | has(r"\b(error|exception|warn|stderr|stdout)\b", F.lower(s)), "log")
        .when(has(r"^[\{\[]") & has('[:,"]'), "json")
        .when(F.contains(s, F.lit("```")) | has(r"(?m)^\s*#{1,6}\s+") | has(r"(?m)^\s*[-*]\s+"), "markdown")
        .when(has(r"\b(def|class|import|from|const|let|function|return|async|await)\b") | F.contains(s, F.lit("=>")), "code")
        .when(chinese / F.length(s) > 0.25, "zh_text")
        .when(has(r"\b(recall@|ndcg|gold_rank|candidate_recall|accuracy|f1|precision)\b", F.lower(s)), "metrics")
        .otherwise("prose")
    )


def class_tokens(text: Column, kind: Column) -> Column:
    """Token estimate by class: characters over its ratio, rounded up (prose: four; Chinese letters count 1.05); at least 1, empty 0."""
    n, chinese = F.length(text), F.regexp_count(text, F.lit(CJK))
    ratio = F.coalesce(F.create_map(*[F.lit(x) for pair in RATIOS.items() for x in pair])[kind], F.lit(4.0))
    out = F.when(kind == "zh_text", F.ceil(chinese * 1.05 + (n - chinese) / 4)).otherwise(F.ceil(n / ratio))
    return F.when((kind == "empty") | text.isNull(), 0).otherwise(F.greatest(F.lit(1), out)).cast("long")


def redacted(text: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p[1], p[2]), SECRETS, text)


def secret_kinds(text: Column) -> Column:
    """Names of the secrets found in a text."""
    return F.filter(F.array(*(F.when(F.regexp_like(text, F.lit(p)), F.lit(n)) for n, p, _ in SECRETS)), lambda x: x.isNotNull())


def markers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\[REDACTED\]"))


def redacted_fields(payload: Column) -> Column:
    """A map of strings without its secrets: secret fields by name, all other values by what they hold."""
    return F.transform_values(payload, lambda k, v: F.when(F.regexp_like(k, F.lit(SECRET_FIELD)), F.lit(MARKER)).otherwise(redacted(v)))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, also where use reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def ngrams(tokens: Column, n: int = 4) -> Column:
    """Different n-grams joined by spaces; short arrays give single tokens."""

    def grams(t: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - n + 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.array_distinct(F.when(F.size(t) < n, t).otherwise(some))

    return bound(tokens, grams)


def char_chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows as structs (start, end, text); the last one ends with the text. The text is cut once
    into pieces of a step, and a window joins its pieces, so that the work grows with the text's length only."""
    step = size - overlap
    after = -(-size // step)
    n = F.length(text)

    def windows(p: Column) -> Column:
        many = F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
        one = lambda i: F.substring(F.array_join(F.slice(p, i, after), ""), 1, size)
        return F.transform(F.sequence(F.lit(1), many), lambda i: F.struct(((i - 1) * step).alias("start"), F.least((i - 1) * step + size, n).alias("end"), one(i).alias("text")))

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), 0), windows)


def line_chunks(text: Column, per: int) -> Column:
    return bound(F.split(text, "\n"), lambda lines: F.transform(F.sequence(F.lit(1), F.size(lines), F.lit(per)), lambda s: F.array_join(F.slice(lines, s, per), "\n")))


def compress(text: Column, ratio: float = 0.35, least: int = 120) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.substring(flat, F.lit(1), F.greatest(F.lit(least), F.floor(F.length(flat) * ratio)).cast("int"))

"""Surface features of texts as columns: tokens and their variants, CJK n-grams, polarity, density, risk, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .queries import STOP
from .text import bound, jaccard, stripped

# A run of Chinese characters, dates and times, secrets, paths, words that mark evidence.
CJK_RUN = "[\\u3400-\\u4dbf\\u4e00-\\u9fff]{2,}"
DATE = r"\b(?:19|20)\d{2}(?:[-/]\d{2})?(?:[-/]\d{2})?\b"
TIME = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
SECRET = r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{8,}"
PATH = r"(?:^|\s)([\w./-]+\.(?:py|ts|tsx|js|jsx|json|md|toml|yaml|yml|txt|log))"
EVIDENCE_MARKERS = ("file:", "path:", ".py", ".ts", ".json", "test", "error", "decision", "because")
LIKES = r"\b(prefer|prefers|preferred|favorite|favourite|like|likes|love|loves|enjoy|enjoys)\b"
DISLIKES = r"\b(dislike|dislikes|hate|hates|avoid|avoids|don't like|do not like|no longer like|never)\b"


def _pieces(c: Column) -> Column:
    """Parts of a token at separators, at changes of case and between letters and digits; none where it does not part."""
    at = (
        F.filter(F.split(c, r"[_\-./@:]+"), lambda x: x != ""),
        F.split(F.trim(F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")), " +"),
        F.split(F.trim(F.regexp_replace(c, r"(?<=\D)(?=\d)|(?<=\d)(?=\D)", " ")), " +"),
    )
    return F.concat(*(bound(x, lambda y: F.when(F.size(y) > 1, y).otherwise(F.array().cast("array<string>"))) for x in at))


def tokens(text: Column) -> Column:
    """Different lower-case tokens in order: compounds, then words; each followed by its parts, theirs and theirs."""
    raw = F.concat(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+(?:[./@:\-][A-Za-z0-9_]+)+"), 0), F.regexp_extract_all(text, F.lit("[A-Za-z0-9_\\-\\u4e00-\\u9fff]+"), 0))

    def grown(x: Column) -> Column:
        more = lambda level: F.flatten(F.transform(level, _pieces))
        return F.concat(F.array(x), bound(_pieces(x), lambda one: F.concat(one, bound(more(one), lambda two: F.concat(two, more(two))))))

    return F.array_distinct(F.transform(F.flatten(F.transform(F.array_distinct(raw), grown)), F.lower))


def angles(seed: Column) -> tuple[Column, Column]:
    """Two angles from the halves of the seed's sha256."""
    h = F.sha2(seed, 256)
    part = lambda at, n: (F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")).cast("double") / 100000.0
    return part(1, 628319), part(17, 314159)


def cjk_terms(text: Column, n: int = 72, runs: int = 18) -> Column:
    """Of the first runs of Chinese characters the whole and all its pieces of two to four, the first n."""
    found = F.slice(F.regexp_extract_all(text, F.lit(CJK_RUN), 0), 1, runs)

    def grams(s: Column) -> Column:
        by_size = F.transform(F.sequence(F.lit(2), F.least(F.lit(4), F.length(s))), lambda k: F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, k)))
        return F.concat(F.array(s), F.flatten(by_size))

    return F.array_distinct(F.slice(F.flatten(F.transform(found, grams)), 1, n))


def semantic_terms(text: Column, n: int = 160) -> Column:
    """Tokens that are no stop words, then Chinese pieces; the first n."""
    low = F.lower(stripped(text))
    return F.slice(F.array_distinct(F.concat(F.array_except(tokens(low), F.array(*map(F.lit, STOP))), cjk_terms(low))), 1, n)


def entity_like(text: Column) -> Column:
    """Tokens with a separator, numbers, dates and times: what names a thing."""
    low = F.lower(stripped(text))
    named = F.filter(tokens(low), lambda t: (F.length(t) >= 2) & F.regexp_like(t, F.lit(r"[/_.\-]|^[0-9]+$")))
    return F.array_distinct(F.concat(named, F.regexp_extract_all(low, F.lit(DATE), 0), F.regexp_extract_all(low, F.lit(TIME), 0)))


def salience(asked: Column, have: Column) -> Column:
    """0.24 times the share of the asked terms that are there."""
    return F.when(F.size(asked) == 0, 0.0).otherwise(0.24 * F.size(F.array_intersect(asked, have)) / F.size(asked))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared items by the smaller side's number."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def person_score(names: Column, text: Column) -> Column:
    return F.least(F.lit(0.2), 0.1 * F.size(F.filter(names, lambda n: F.contains(text, n))))


def polarity(text: Column) -> Column:
    """1 for a text that likes, -1 for one that dislikes, null for both or neither."""
    low = F.lower(text)
    yes, no = F.regexp_like(low, F.lit(LIKES)), F.regexp_like(low, F.lit(DISLIKES))
    return F.when(yes & ~no, 1.0).when(no & ~yes, -1.0)


def density(text: Column, n_tokens: Column, markers: tuple = EVIDENCE_MARKERS) -> Column:
    """Evidence markers per 120 tokens, at most 1."""
    low = F.lower(text)
    hits = sum((F.floor((F.length(low) - F.length(F.replace(low, F.lit(m), F.lit("")))) / len(m)) for m in markers), F.lit(0))
    return F.when(n_tokens <= 0, 0.0).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.lit(1.0), n_tokens / 120)))


def risk(text: Column, task: Column) -> tuple[Column, Column]:
    """Risk of handing a text on (0.1 and more, at most 1), and its reasons."""
    low = F.lower(text)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    secret, raw, sensitive = F.regexp_like(text, F.lit(SECRET)), any_of(("traceback", "stderr", "stdout", "raw log")), any_of(("fallback", "regression", "benchmark"))
    score = 0.1 + F.when(secret, 0.75).otherwise(0.0) + F.when(raw, 0.15).otherwise(0.0) + F.when(sensitive, 0.15).otherwise(0.0) + F.when(task.isin("benchmark", "debug", "paper"), 0.1).otherwise(0.0)
    reasons = F.array(F.when(secret, "secret_like_content"), F.when(raw, "raw_log_content"), F.when(sensitive, "sensitive_regression_context"))
    return F.least(F.lit(1.0), score), F.filter(reasons, lambda r: r.isNotNull())


def reference_sufficiency(text: Column) -> Column:
    """Different file paths per 80 words, at most 1."""
    paths = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(PATH), 1)))
    return F.when(paths == 0, 0.0).otherwise(F.least(F.lit(1.0), paths / F.greatest(F.lit(1.0), F.regexp_count(text, F.lit(r"\w+")) / 80)))


def spans(text: Column, n: int = 10, lengths: tuple = (1, 2, 3)) -> Column:
    """The first n different runs of one, two and three sentences."""
    units = F.filter(F.transform(F.split(text, r"[\n\r]+|(?<=[.!?])\s+"), lambda u: F.trim(u)), lambda u: u != "")

    def run(u: Column, k: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(u) - k + 1)), lambda i: F.array_join(F.slice(u, i, k), " "))
        return F.when(F.size(u) >= k, some).otherwise(F.array().cast("array<string>"))

    return F.slice(F.array_distinct(bound(units, lambda u: F.concat(*(run(u, k) for k in sorted(set(lengths)))))), 1, n)


def memory_similarity(terms_a: Column, terms_b: Column, vector_a: Column, vector_b: Column) -> Column:
    """The larger of Jaccard overlap and inner product (a place that is null on either side adds nothing)."""
    dot = F.aggregate(F.zip_with(vector_a, vector_b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(jaccard(terms_a, terms_b), dot)


# --- scores of a candidate by what the query needs (conditions are columns)


def specificity(grain: Column, exact: Column, typed: Column, best_other: Column) -> Column:
    """Fine grains are worth more where exact evidence is needed; a macro grain less, the more a finer one of its node supports."""
    base = F.when(exact, F.when(grain == "micro", 0.06).when(grain == "local", 0.025).when(grain == "macro", -0.12).otherwise(0.0)).otherwise(0.0)
    macro = F.when((grain == "macro") & typed, -0.07).when(grain == "macro", 0.01).otherwise(0.0)
    late = F.when((grain == "macro") & (best_other > 0.14), -F.least(F.lit(0.18), 0.04 + best_other * 0.28)).otherwise(0.0)
    return base + macro + late


def grain_bonus(grain: Column, wanted: Column) -> Column:
    """wanted: the grains that the query prefers."""
    yes = F.when(grain == "micro", 0.08).when(grain == "local", 0.06).when(grain == "macro", 0.03).otherwise(0.0)
    no = F.when(grain == "micro", 0.03).when(grain == "local", 0.02).when(grain == "macro", -0.01).otherwise(0.0)
    return F.when(F.array_contains(wanted, grain), yes).otherwise(no)


def diagnostic(shared: Column, lexical: Column) -> Column:
    """shared: diagnostic words of the query that the candidate has."""
    return F.when(shared == 0, 0.0).otherwise(F.least(F.lit(0.3), 0.1 * shared + 0.12 * lexical))


def preference(topic_share: Column, text: Column, hint: Column, object_support: Column) -> Column:
    """How well a text answers a question of taste with polarity ``hint`` (1, -1 or null); at most 0.46."""
    low, own = F.lower(text), polarity(text)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    said = F.when(F.regexp_like(low, F.lit(r"\b(?:prefer|prefers|preferred|favorite|favourite|like|likes|love|loves|enjoy|enjoys|dislike|dislikes|hate|hates|avoid|avoids|don't like|do not like)\s+")), 0.08).otherwise(0.0)
    sign = F.when(hint.isNotNull() & own.isNotNull(), F.when(hint * own > 0, 0.12).otherwise(-0.14)).when(own.isNotNull(), 0.02).otherwise(0.0)
    turned = any_of(("used to", "no longer", "stopped", "switched from", "switching from"))
    back = F.when(turned & hint.isNull() & any_of(("used to", "no longer", "stopped")), -0.03).otherwise(0.0)
    return F.least(F.lit(0.46), topic_share * 0.24 + said + F.when(turned, 0.05).otherwise(0.0) + F.least(object_support, F.lit(0.12)) * 0.6 + sign + back)


def time_score(mode: Column, share: Column, times: Column, references: Column, latest: Column, previous: Column, ranges: Column, changes: Column) -> Column:
    """How well a text answers a question of time; all but mode and share are counts of its cues. At most 0.46."""
    new = F.least(F.lit(0.12), latest * 0.04 + changes * 0.015) - F.when(previous > 0, F.least(F.lit(0.06), previous * 0.03)).otherwise(0.0)
    old = F.least(F.lit(0.12), previous * 0.04 + changes * 0.02) - F.when(latest > 0, F.least(F.lit(0.05), latest * 0.025)).otherwise(0.0)
    span = F.least(F.lit(0.1), ranges * 0.03 + references * 0.03)
    bonus = F.when(mode == "latest", new).when(mode == "previous", old).when(mode == "range", span).otherwise(0.0)
    return F.least(F.lit(0.46), share * 0.32 + times * 0.03 + references * 0.1 + changes * 0.015 + bonus)


def time_bucket(marker: Column, text: Column, day: Column) -> Column:
    """A marker if there is one, else latest or previous by cue, else the day, else unknown."""
    low = F.lower(text)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.coalesce(F.nullif(F.lower(F.trim(marker)), F.lit("")), F.when(any_of(("latest", "currently", "now")), "latest").when(any_of(("previously", "used to", "before")), "previous"), day, F.lit("unknown"))

"""Personal data: formats found by pattern, and terms that give them away by corpus co-occurrence.

All of it runs in Spark's own functions. Patterns of four kinds give the base spans. An entity is a
distinct value of a kind. A term is a word near an occurrence of an entity; over the whole corpus it
discloses the entity by

    pointwise mutual information / information content of the entity
    = ln(N * n(entity, term) / (n(entity) * n(term))) / ln(N / n(entity))

counted in documents: 1 if the term stands nowhere else, about 0 if it is spread like any other word. Terms of
``remove`` or more are taken out, those of ``generalise`` or more are replaced by a general word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, hot_join

_LOCAL = "[A-Za-z0-9._%+-]"
#: The kinds in their order. The patterns find what these find, leftmost and not overlapping, with what can fail decided in the pattern where it can be:
#:   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card  [0-9]([\x20-]?[0-9])+ (12 to 19 digits)                phone \+[0-9][\x20().0-9-]+[0-9]
#: Possessive loops take no stack and never run back; a match begins only where a run of its characters begins or the last match
#: ended, so that long runs are read once. A card's chain of digits is taken whole or not at all.
KINDS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: without which there is no match
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = "term"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
GENERAL = "[WORD]"
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?+"
_IP = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
#: whole words that are no part of an address
_WORD = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}+(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"


def _sound(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(kind == "ip", value.rlike(_IP)).when(kind == "card", F.call_function("luhn_check", F.translate(value, " -", ""))).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(F.lit(True))


def _entity(kind: Column, value: Column) -> Column:
    """Spellings of a value as one."""
    return F.when(kind.isin("card", "phone"), F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value))


def occurrences(texts: DataFrame, reach: int) -> DataFrame:
    """row, kind, start, end, value, and up to reach characters of text before and after that hold no match of this kind, with
    flags that tell whether these are cut. texts: row (of equal texts one is enough) and text."""
    found = texts.select("row", "text", *(F.when(F.contains("text", F.lit(_NEEDS[k])), F.regexp_extract_all("text", F.lit(p), 0)).alias(k) for k, p in KINDS.items()))
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("found"), F.when(F.size(k) > 0, F.split("text", p, -1)).alias("gaps")) for k, p in KINDS.items()]
    per_kind = found.select("row", F.explode(F.filter(F.array(*kinds), lambda x: F.size(x["found"]) > 0)).alias("x")).select("row", "x.kind", "x.found", "x.gaps")

    def one(value, i):
        before, after = F.get("gaps", i), F.get("gaps", i + 1)
        return F.struct(i.alias("i"), value.alias("value"), F.length(before).alias("gap"), F.right(before, F.lit(reach)).alias("before"), F.left(after, F.lit(reach)).alias("after"), (F.length(before) > reach).alias("cut_before"), (F.length(after) > reach).alias("cut_after"))

    each = per_kind.select("row", "kind", F.explode(F.transform("found", one)).alias("o")).select("row", "kind", "o.*")
    # lengths are summed along a text by a window, as folding them into an array would copy it for each match
    once = each.repartition("row", "kind").dropDuplicates(["row", "kind", "i"])
    along = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = once.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(along))
    placed = placed.withColumn("start", F.col("end") - F.length("value"))
    return placed.filter(_sound(F.col("kind"), F.col("value"))).select("row", "kind", "start", "end", "value", "before", "after", "cut_before", "cut_after")


def _words(said: Column, offset: Column, cut_first: Column, cut_last: Column, last: bool, most: int) -> Column:
    """The words of a bounded piece of text nearest to an occurrence: term, start, end. A word at a cut may be a part of one, and is left out."""

    def placed(x):
        def one(j):
            start = F.aggregate(F.slice(x["gaps"], 1, j + 1), F.lit(0), lambda n, g: n + F.length(g)) + F.aggregate(F.slice(x["words"], 1, j), F.lit(0), lambda n, w: n + F.length(w))
            word = F.get(x["words"], j)
            return F.struct(F.lower(word).alias("term"), start.alias("start"), (start + F.length(word)).alias("end"))

        n = F.size(x["words"])
        places = F.sequence(F.greatest(n - most, F.lit(0)), n - 1) if last else F.sequence(F.lit(0), F.least(n, F.lit(most)) - 1)
        return F.when(n > 0, F.transform(places, one))

    parts = F.array(F.struct(F.regexp_extract_all(said, F.lit(_WORD), 0).alias("words"), F.split(said, _WORD, -1).alias("gaps")))
    found = F.coalesce(F.transform(parts, placed)[0], F.array().cast("array<struct<term: string, start: int, end: int>>"))
    whole = F.filter(found, lambda w: ~(cut_first & (w["start"] == 0)) & ~(cut_last & (w["end"] == F.length(said))))
    return F.transform(whole, lambda w: F.struct(w["term"].alias("term"), (w["start"] + offset).cast("long").alias("start"), (w["end"] + offset).cast("long").alias("end")))


def near_terms(spans: DataFrame, words: int) -> DataFrame:
    """row, kind, entity, term, start, end, around (which tells one surrounding text from another), for the nearest words on either side."""
    no = F.lit(False)
    before = _words(F.col("before"), F.col("start") - F.length("before"), F.col("cut_before"), no, True, words)
    after = _words(F.col("after"), F.col("end"), no, F.col("cut_after"), False, words)
    rows = spans.select("row", "kind", "entity", "n_entity", F.xxhash64("before", "after").alias("around"), F.explode(F.concat(before, after)).alias("w"))
    return rows.select("row", "kind", "entity", "n_entity", "around", "w.*")


def document_counts(texts: Column, docs: DataFrame, longest: int) -> DataFrame:
    """term, n_term: in how many texts each word of 3 to longest letters stands, over all rows."""
    words = F.transform(F.split(texts, r"[^\p{L}]+"), lambda w: F.lower(w))
    every = docs.select(F.explode(F.array_distinct(words)).alias("term")).filter(F.length("term").between(3, longest))
    return every.groupBy("term").agg(F.count("*").alias("n_term"))


def disclosing_terms(spans: DataFrame, docs: DataFrame, text: Column, reach: int, words: int, generalise: float, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """The near terms of entities that stand in min_docs documents or more, and of these the pairs of entity and term with a score of ``generalise``
    or more: kind, entity, term, score, n. A pair needs min_docs documents too, and two different surrounding texts, as copies of a passage are one witness."""
    many = spans.select("kind", "entity", "row").distinct().groupBy("kind", "entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= min_docs)
    per_value = spans.groupBy("kind", "entity").agg(F.count("*").alias("n")).join(many, ["kind", "entity"])
    terms = cut(near_terms(hot_join(spans, cut(per_value), ["kind", "entity"]), words))
    pairs = terms.groupBy("kind", "entity", "n_entity", "term", "row").agg(F.min("around").alias("lo"), F.max("around").alias("hi"), F.count("*").alias("m"))
    pairs = pairs.groupBy("kind", "entity", "n_entity", "term").agg(F.count("*").alias("n_pair"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m"))
    pairs = cut(pairs.filter((F.col("n_pair") >= min_docs) & (F.col("lo") != F.col("hi"))).drop("lo", "hi"))
    per_term = cut(pairs.groupBy("term").agg(F.count("*").alias("n")).join(document_counts(text, docs, reach), "term"))
    n = float(docs.count())
    known = F.log(F.lit(n) / F.col("n_entity"))
    gain = F.log(F.col("n_pair") * F.lit(n) / (F.col("n_entity") * F.col("n_term")))
    scored = hot_join(pairs, per_term, ["term"]).filter(F.col("n_entity") < n).withColumn("score", gain / known).filter(F.col("score") >= generalise)
    return terms, cut(scored.select("kind", "entity", "term", "score", F.col("m").alias("n")))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 8, reach: int = 160, generalise: float = 0.75, remove: float = 0.9, min_docs: int = 3) -> DataFrame:
    """doc_id, spans (kind, start, end, action; ends exclusive, in code points, by start, then kind as listed, then end) and the sanitised text, a row per row of docs.

    Kinds are those of KINDS and, last, `term`: a word among the ``words`` nearest on either side of a value (within ``reach`` characters) that
    discloses it. Values become the label of their kind, terms go (action `remove`) or become a general word (`generalise`); of overlapping spans the one that
    begins first, then the longest, is replaced as far as it reaches. A null text has no spans and stays null, an empty one too. Rows alike in
    id and text count as one document where entities are counted, and each gets the same spans; null ids are ids like others. A text of any
    length is read whole. Other columns are ignored; an empty table gives an empty one. Entities and terms that many documents share are
    summed before they are shuffled, and joined by hot_join.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    said = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text)
    rows = docs.select(F.unhex(F.sha2(said, 256)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = occurrences(rows.filter("text is not null").select("row", "text"), reach)
    spans = cut(spans.withColumn("entity", _entity(F.col("kind"), F.col("value"))).drop("value"))
    terms, pairs = disclosing_terms(spans, docs, text, reach, words, generalise, min_docs)
    told = hot_join(terms, pairs, ["kind", "entity", "term"]).groupBy("row", "start", "end").agg(F.max("score").alias("score"))
    told = told.select("row", F.lit(TERM).alias("kind"), F.col("start").cast("long"), F.col("end").cast("long"), F.when(F.col("score") >= remove, "remove").otherwise("generalise").alias("action"))
    every = spans.select("row", "kind", F.col("start").cast("long"), F.col("end").cast("long"), F.lit("label").alias("action")).unionByName(told)
    every = every.withColumn("rank", F.array_position(F.array(*map(F.lit, [*KINDS, TERM])), F.col("kind")))
    # how far all earlier spans reach, and all of them
    earlier = Window.partitionBy("row").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("reach", F.coalesce(F.max("end").over(earlier), F.lit(0).cast("long")))
    marks = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", "action", "reach"))).alias("marks"), F.max("end").alias("last"))
    out = rows.join(marks, "row", "left")
    spans = F.transform("marks", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["action"].alias("action")))
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint, action: string>>")
    return out.select(F.col("id").alias(id_col), F.coalesce(spans, none).alias("spans"), _replaced(F.col("text"), F.col("marks"), F.col("last")).alias("text"))


def _replaced(text: Column, marks: Column, last: Column) -> Column:
    """The text with its spans replaced. All pieces are cut out of one array of characters, so that each is read once."""

    def label(s):
        out = F.when(s["kind"] == TERM, F.when(s["action"] == "remove", "").otherwise(GENERAL))
        for kind, said in LABELS.items():
            out = out.when(s["kind"] == kind, said)
        return out

    def rebuilt(x):
        # a span that begins where an earlier one still reaches only prolongs it
        def piece(s):
            gap = F.slice(x["chars"], (s["reach"] + 1).cast("int"), (s["start"] - s["reach"]).cast("int"))
            return F.when(s["start"] >= s["reach"], F.concat(F.array_join(gap, ""), label(s))).otherwise("")

        rest = F.slice(x["chars"], (x["last"] + 1).cast("int"), F.size(x["chars"]))
        return F.concat(F.array_join(F.transform(x["marks"], piece), ""), F.array_join(rest, ""))

    parts = F.array(F.struct(F.split(text, "").alias("chars"), marks.alias("marks"), last.alias("last")))
    return F.when(text.isNull() | marks.isNull(), text).otherwise(F.transform(parts, rebuilt)[0])

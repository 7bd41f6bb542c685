"""HTML to text in SQL functions: scripts, styles and comments go, blocks become lines, entities are resolved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def to_text(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    t = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, t)
    t = F.regexp_replace(t, r"[ \t\r]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))

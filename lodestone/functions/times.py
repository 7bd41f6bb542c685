"""Times in text: tolerant parsing, anchors, interval weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: formats tried in this order after ISO
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM")


def parsed(text: Column) -> Column:
    """Epoch seconds of a date or time in one of the formats (ordinal endings go first), else of a bare year, else null."""
    t = F.trim(F.regexp_replace(text, r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1"))
    iso = F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d\d-\d\dT")), F.try_to_timestamp(t))
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in FORMATS]
    year = F.when(F.regexp_like(t, F.lit(r"^(19|20)\d\d$")), F.try_to_timestamp(F.concat(t, F.lit("-01-01")), F.lit("yyyy-MM-dd")))
    return F.unix_timestamp(F.coalesce(iso, *tries, year))


def anchors(text: Column, n: int = 8) -> Column:
    """The first n different dates and years in a text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:19|20)\d\d(?:-\d\d(?:-\d\d)?)?\b"), 0)), 1, n)


def prior(mode: Column, t: Column, low: Column, high: Column, previous: Column, anchor: Column) -> Column:
    """Nearness of a time to what a query asks for: latest, previous, range (inside or not), point (within a year), else 0."""
    span = F.greatest(high - low, F.lit(1)).cast("double")
    return (
        F.when(t.isNull(), 0.0)
        .when(mode == "latest", 1 - (high - t) / span)
        .when(mode == "previous", F.when(previous.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(previous - t) / span)))
        .when(mode == "range", F.when((t >= low) & (t <= anchor), 1.0).otherwise(0.0))
        .when(mode == "point", F.greatest(F.lit(0.0), 1 - F.abs(anchor - t) / (365 * 86400.0)))
        .otherwise(0.0)
    )

"""Queries over a kept index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import lifecycle as L
from ..sources import views as V
from ..sources.tables import shared_folder, written
from .registry import query
from .retrieval import POST


@query("SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM bm25 WHERE rank <= 10", V.EVIDENCE, V.ASKS + POST)
def index_search(spark, d):
    """The ten best rows of each question from an index of two segments, an older and a newer one."""
    ev = V.evidence(spark, d).filter(L.eligible()).select("id", "text", "t")
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    new = F.col("t") >= V.EPOCH + 180 * 86400
    I.add_segment(ev.filter(~new), folder, 0)
    I.add_segment(ev.filter(new), folder, 1)
    return I.Index(spark, folder).top(V.asks(spark, d), 10, written).select("query_id", "id", "rank", F.round("score", 6).alias("score"))

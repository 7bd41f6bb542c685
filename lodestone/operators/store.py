"""The evidence store as table-to-table steps: traces, side rows, compaction life cycle, jobs, runs, health checks.

A step takes tables and returns the rows to append or the new state of rows; nothing is changed in place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MARKER, SECRET_FIELD, SECRETS

# Maintenance jobs by trigger; a trigger without an entry refreshes the projection.
TRIGGER_JOBS = {
    "session_ended": ("refresh_projection", "prepare_next_session_context"),
    "large_file_changed": ("refresh_index", "refresh_projection"),
    "benchmark_finished": ("extract_metric_deltas", "refresh_projection"),
    "metric_regression_detected": ("detect_contradictions", "generate_recovery_summary", "refresh_projection"),
    "artifact_updated": ("refresh_projection", "refresh_index"),
    "user_preference_declared": ("extract_constraints", "refresh_projection"),
    "decision_changed": ("extract_decisions", "detect_contradictions", "refresh_projection"),
    "contradiction_detected": ("detect_contradictions", "generate_recovery_summary"),
    "repeated_failure_detected": ("extract_failures", "generate_recovery_summary"),
    "index_staleness_detected": ("refresh_index",),
    "cache_miss_spike_detected": ("refresh_index",),
}
REST_JOBS = ("refresh_projection",)
#: the projection that a job writes
PROJECTIONS = {"refresh_index": "index", "extract_metric_deltas": "metrics", "detect_contradictions": "contradictions", "extract_constraints": "constraints", "extract_decisions": "decisions", "extract_failures": "failures", "generate_recovery_summary": "recovery", "prepare_next_session_context": "resume"}


def stable_id(prefix: str, *parts: Column, n: int = 20) -> Column:
    """A name that follows from content: the first n hexadecimal digits of its sha256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n))


def raw_traces(ev: DataFrame, inline: int = 1000) -> DataFrame:
    """The original text of each capsule by its content: id, trace_id, n_bytes, stored (inline or blob)."""
    size = F.octet_length("text")
    return ev.select("id", stable_id("trace_", F.col("project"), F.sha2("text", 256)).alias("trace_id"), size.cast("long").alias("n_bytes"), F.when(size <= inline, "inline").otherwise("blob").alias("stored"))


def side_rows(ev: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """(id, kind, value) of each capsule's entities, terms and so on, each once."""
    rows = None
    for kind, values in parts.items():
        one = ev.select("id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(values)).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def manifest(ev: DataFrame) -> DataFrame:
    """One row a project of what an export holds; the checksum does not depend on the order of rows."""
    return ev.groupBy("project").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("id").alias("id_sum"), F.sum(F.octet_length("text")).alias("n_bytes"))


# --- compaction


def compaction_results(merged: DataFrame, sources: DataFrame, key: str, most_tokens: int, tokens: Column, terms: str = "ts") -> DataFrame:
    """A preview of each merge (key, summary, ts): tokens before and after, warnings, whether it passes.

    sources: rows (key, tokens, ts). A merge may hold terms that no source has, but no more than twelve, or
    half of the sources' terms. Terms meet by joins, so that no group is gathered.
    """
    before = sources.groupBy(key).agg(F.count("*").alias("n_sources"), F.sum("tokens").alias("source_tokens"))
    have = sources.select(key, F.explode(terms).alias("term")).distinct()
    known = have.groupBy(key).agg(F.count("*").alias("n_terms"))
    lacking = merged.select(key, F.explode(F.array_distinct(terms)).alias("term")).join(have, [key, "term"], "left_anti").groupBy(key).agg(F.count("*").alias("unsupported"))
    rows = merged.join(before, key, "left").join(known, key, "left").join(lacking, key, "left").fillna(0, ["n_sources", "source_tokens", "n_terms", "unsupported"])
    rows = rows.withColumn("tokens", tokens)
    warnings = F.array(
        F.when(F.col("n_sources") == 0, "source_ids_empty"),
        F.when(F.trim("summary") == "", "canonical_content_empty"),
        F.when(F.col("tokens") > most_tokens, "output_exceeds_max_tokens"),
        F.when(F.col("unsupported") > F.greatest(F.lit(12), F.floor(F.col("n_terms") / 2)), "canonical_content_may_contain_unsupported_terms"),
    )
    rows = rows.withColumn("warnings", F.filter(warnings, lambda w: w.isNotNull()))
    return rows.select(key, stable_id("cmp_", F.col(key).cast("string"), F.lit("deterministic")).alias("result_id"), "summary", "n_sources", "source_tokens", "tokens", (F.col("source_tokens") - F.col("tokens")).alias("saved"), "warnings", (F.size("warnings") == 0).alias("passed"))


def decide(results: DataFrame, rejected: Column, allow_review: bool = False) -> DataFrame:
    """The results with their status: rejected, committed (those that pass, or all with allow_review) or needs_review."""
    return results.withColumn("status", F.when(rejected, "rejected").when(F.col("passed") | F.lit(allow_review), "committed").otherwise("needs_review"))


def committed(ev: DataFrame, decided: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(states, relations) after a commit: (id, state) of all capsules and of the canonical ones added, and who went into which."""
    done = decided.filter("status = 'committed'").select(key, stable_id("can_", F.col("result_id")).alias("canonical_id"))
    rows = ev.join(done, key, "left")
    old = rows.select(F.col("id").cast("string").alias("id"), F.when(F.col("canonical_id").isNotNull(), "compacted").otherwise(F.col("state")).alias("state"))
    relations = rows.filter("canonical_id is not null").select(F.col("id").alias("source"), F.col("canonical_id").alias("target"), F.lit("compacted_into").alias("relation"))
    return old.unionByName(done.select(F.col("canonical_id").alias("id"), F.lit("active").alias("state"))), relations


def relations_once(rows: DataFrame) -> DataFrame:
    """Relations by the name that follows from their ends and kind, each once with its earliest time."""
    return rows.groupBy(stable_id("rel_", F.col("source").cast("string"), F.col("target").cast("string"), F.col("relation")).alias("relation_id"), "source", "target", "relation").agg(F.min("t").alias("t"))


def applied_suggestions(ev: DataFrame, suggestions: DataFrame, key: str) -> DataFrame:
    """(id, canonical, state): of each open suggestion's members all but the newest are superseded by it."""
    members = ev.join(suggestions.filter("status = 'open'").select(key), key)
    newest = members.groupBy(key).agg(F.max(F.struct("t", "id")).alias("last"))
    return members.join(newest, key).select("id", F.col("last.id").alias("canonical"), F.when(F.col("id") == F.col("last.id"), F.col("state")).otherwise("superseded").alias("state"))


# --- jobs and runs


def trigger_jobs(events: DataFrame, trigger: str = "trigger", ids: Sequence[str] = ("event_id",)) -> DataFrame:
    """Jobs that triggers start: (job_id, trigger, job); the id follows from trigger, job and event, so a second enqueue adds nothing."""
    table = F.create_map(*[x for k, v in TRIGGER_JOBS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    jobs = events.select(*ids, trigger, F.posexplode(F.coalesce(table[F.col(trigger)], F.array(*map(F.lit, REST_JOBS)))).alias("place", "job"))
    return jobs.withColumn("job_id", stable_id("job_", F.col(trigger), F.col("job"), *(F.col(c).cast("string") for c in ids), n=18)).dropDuplicates(["job_id"])


def drained(jobs: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` pending jobs of each group, in order, with the projection that each writes."""
    w = Window.partitionBy(group).orderBy(*order)
    name = F.create_map(*[F.lit(x) for p in PROJECTIONS.items() for x in p])[F.col("job")]
    return jobs.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).withColumn("projection", F.coalesce(name, F.lit("state"))).withColumn("status", F.lit("finished"))


def last_run(log: DataFrame, run: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last row of each run in log order, and how many rows it has."""
    key = F.struct(*order)
    return log.groupBy(run).agg(*(F.max_by(f, key).alias(f) for f in fields), F.count("*").alias("n"))


def seen(events: DataFrame, key: str, boost: float = 0.05) -> DataFrame:
    """How often and when each key was last seen, and the salience that this adds, at most 1."""
    s = events.groupBy(key).agg(F.count("*").alias("seen"), F.max("t").alias("last_t"))
    return s.withColumn("salience", F.least(F.lit(1.0), F.col("seen") * boost))


def health(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, n, ok): the number of rows of each check's table; ok where it is 0."""
    rows = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") == 0).alias("ok"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


# --- parsing


def path_matches(path: Column, patterns: Sequence[str]) -> Column:
    """Does a path match one of the patterns? ``dir/`` means all below a folder; others are globs on the path or its last part."""

    def one(p: str) -> Column:
        if p.endswith("/"):
            d = p.rstrip("/")
            return (path == d) | F.startswith(path, F.lit(d + "/")) | F.contains(path, F.lit(f"/{d}/"))
        glob = "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if not c.isalnum() and c not in "_/" else c for c in p)
        return F.regexp_like(path, F.lit(f"^{glob}$")) | F.regexp_like(path, F.lit(f"(^|/){glob}$") if "/" not in p else F.lit(f"^{glob}$"))

    out = F.lit(False)
    for p in patterns:
        out = out | one(p)
    return out


def ignored(path: Column, deny: Sequence[str], allow: Sequence[str] = ()) -> Column:
    """Why a path is left out: not_in_allowlist, denied, or null."""
    out = F.when(~path_matches(path, allow), "not_in_allowlist") if allow else F.when(F.lit(False), "")
    return out.when(path_matches(path, deny), "denied")


def error_trace(text: Column) -> Column:
    """The last exception and its message, the frames' files and functions, in order."""
    kinds = F.regexp_extract_all(text, F.lit(r"(?m)^([A-Za-z_][\w.]*Error|[A-Za-z_][\w.]*Exception|KeyboardInterrupt|SystemExit):\s*(.*)$"), 1)
    said = F.regexp_extract_all(text, F.lit(r"(?m)^([A-Za-z_][\w.]*Error|[A-Za-z_][\w.]*Exception|KeyboardInterrupt|SystemExit):\s*(.*)$"), 2)
    frame = F.lit(r'File "([^"]+)", line (\d+), in ([^\n]+)')
    return F.struct(F.try_element_at(kinds, F.lit(-1)).alias("kind"), F.try_element_at(said, F.lit(-1)).alias("message"), F.size(F.regexp_extract_all(text, frame, 0)).alias("frames"), F.array_distinct(F.regexp_extract_all(text, frame, 1)).alias("files"))


def first_metric(payload: Column, names: Sequence[str]) -> Column:
    """The first of the names that the payload's metrics, or the payload itself, hold."""
    return F.coalesce(*(F.get_json_object(payload, f"$.{where}{n}").cast("double") for n in names for where in ("metrics.", "")))


def redacted_json(c: Column) -> Column:
    """JSON text without its secrets at any depth: secret fields by name, all strings by what they hold. Null and broken JSON are
    redacted as plain text. A nested value has no fixed shape, so this one is a Pandas UDF."""
    patterns = [(re.compile(p), r.replace("$1", r"\g<1>")) for _, p, r in SECRETS]

    def text(s: str) -> str:
        for p, r in patterns:
            s = p.sub(r, s)
        return s

    def walk(v):
        if isinstance(v, dict):
            return {k: MARKER if re.search(SECRET_FIELD, k) else walk(x) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x) for x in v]
        return text(v) if isinstance(v, str) else v

    def one(s):
        if s is None:
            return None
        try:
            return json.dumps(walk(json.loads(s)), ensure_ascii=False)
        except ValueError:
            return text(s)

    @F.pandas_udf("string")
    def redact(values: pd.Series) -> pd.Series:
        return values.map(one)

    return redact(c)

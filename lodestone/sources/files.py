"""Files as rows: text, documents, event logs, code symbols, and the manifest of what was read."""

from __future__ import annotations

import ast
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: kinds of files by suffix
KINDS = {
    "text": ("txt", "text", "rst", "tex"),
    "markdown": ("md", "markdown", "mdx"),
    "log": ("log", "out", "err"),
    "table": ("csv", "tsv", "json", "jsonl", "yaml", "yml", "toml", "ini"),
    "html": ("html", "htm"),
    "word": ("docx",),
    "slides": ("pptx",),
    "sheet": ("xlsx",),
    "code": ("py", "js", "ts", "java", "go", "rs", "c", "cpp", "h", "sh", "sql"),
}
SUFFIXES = tuple(s for group in KINDS.values() for s in group)


def kind_of(path):
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for kind, group in KINDS.items():
        hit = suffix.isin(*group)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "title"):
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str) -> str:
    p = _Text()
    p.feed(html)
    return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\r]+", " ", "".join(p.parts))).strip()


def _nodes(xml: str, tag: str) -> list[str]:
    from html import unescape

    return [unescape(t) for t in re.findall(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", xml, re.DOTALL)]


def office_text(kind: str, content: bytes) -> str:
    """Text nodes of a zipped office document, a line per paragraph, slide text or row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        read = lambda n: z.read(n).decode("utf-8", "replace")
        names = sorted(z.namelist(), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        if kind == "word":
            return "\n".join("".join(_nodes(p, "w:t")) for p in re.findall(r"<w:p[ >].*?</w:p>", read("word/document.xml"), re.DOTALL)).strip()
        if kind == "slides":
            return "\n".join(" ".join(_nodes(read(n), "a:t")) for n in names if re.match(r"ppt/slides/slide\d+\.xml$", n)).strip()
        shared = ["".join(_nodes(s, "t")) for s in re.findall(r"<si>.*?</si>", read("xl/sharedStrings.xml"), re.DOTALL)] if "xl/sharedStrings.xml" in names else []
        rows = []
        for n in names:
            if re.match(r"xl/worksheets/sheet\d+\.xml$", n):
                for row in re.findall(r"<row[ >].*?</row>", read(n), re.DOTALL):
                    cells = [(("t=\"s\"" in c[0]), (_nodes(c[1], "v") or _nodes(c[1], "t") or [""])[0]) for c in re.findall(r"<c([^>]*)>(.*?)</c>", row, re.DOTALL)]
                    rows.append(" ".join(shared[int(v)] if s and v else v for s, v in cells))
        return "\n".join(rows).strip()


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, errors = [], []
        for kind, content in zip(pdf.kind, pdf.content):
            try:
                if kind in ("word", "slides", "sheet"):
                    text = office_text(kind, content)
                else:
                    text = content.decode("utf-8", "replace")
                    text = html_text(text) if kind == "html" else text
                texts.append(text)
                errors.append(None)
            except (zipfile.BadZipFile, KeyError, ValueError, IndexError) as e:
                texts.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        yield pdf.drop(columns="content").assign(text=texts, error=errors)


def read_files(spark: SparkSession, path: str, recursive: bool = True, max_bytes: int = 64 << 20) -> DataFrame:
    """path, kind, digest (SHA-1), size, modified, text, error: a row per file of a known suffix.

    Files over max_bytes are listed with an error and without text. Unreadable office files
    keep their row and say why.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    rows = raw.select("path", kind_of(F.col("path")).alias("kind"), F.sha1("content").alias("digest"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content").filter("kind is not null")
    schema = "path string, kind string, digest string, size long, modified timestamp, text string, error string"
    small = rows.filter(F.col("size") <= max_bytes).mapInPandas(_decode, schema)
    large = rows.filter(F.col("size") > max_bytes).select("path", "kind", "digest", "size", "modified", F.lit(None).cast("string").alias("text"), F.lit("too large").alias("error"))
    return small.unionByName(large)


EVENT_SCHEMA = "event_id string, event_type string, source string, actor string, project string, session_id string, parent_event_id string, content_hash string, timestamp string, payload string, provenance string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines event logs with a fixed schema; malformed lines keep a row in _corrupt."""
    return spark.read.schema(EVENT_SCHEMA + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("at", F.try_to_timestamp(F.col("timestamp")))


def write_ledger(events: DataFrame, path: str) -> None:
    """Append to monthly folders."""
    events.withColumn("month", F.date_format("at", "yyyy-MM")).drop("at").write.mode("append").partitionBy("month").json(path)


def _symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, text in zip(pdf.path, pdf.text):
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError):
                continue
            for n in ast.walk(tree):
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    out.append((path, n.name, "class" if isinstance(n, ast.ClassDef) else "function", n.lineno, n.end_lineno))
        yield pd.DataFrame(out, columns=["path", "name", "kind", "line", "last_line"])


def code_symbols(files: DataFrame) -> DataFrame:
    """Functions and classes of Python files: path, name, kind, line, last_line."""
    return files.filter("path like '%.py'").select("path", "text").mapInPandas(_symbols, "path string, name string, kind string, line int, last_line int")


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)

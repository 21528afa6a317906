"""Sources and sinks: text, Markdown and PDF files, content-addressed storage, JSONL and CSV."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions import text as X

SUFFIXES = {".txt": "text", ".md": "markdown", ".markdown": "markdown", ".pdf": "pdf"}
PARSED = "path string, format string, text string, page_count int, spans array<struct<char_start:int,char_end:int,page_number:int>>, error string"


def file_format(path: Column) -> Column:
    """By lower-case suffix; null where it isn't supported."""
    suffix = X.suffix(path)
    return F.coalesce(*[F.when(suffix == s, F.lit(f)) for s, f in SUFFIXES.items()])


def decode(content: Column) -> Column:
    """UTF-8 without mark at the start, line ends as \\n; null for bytes that aren't UTF-8."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, text, error) of the text and Markdown files below a path; markup stays."""
    return parse_texts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def parse_texts(files: DataFrame) -> DataFrame:
    """The same for rows of (path, content)."""
    read = files.select("path", file_format(F.col("path")).alias("format"), decode(F.col("content")).alias("text")).where("format is null or format <> 'pdf'")
    error = F.when(F.col("format").isNull(), "unsupported file type").when(F.col("text").isNull(), "file is not valid UTF-8").when(~F.col("text").rlike(rf"(?s)[^\p{{IsWhite_Space}}\x1c-\x1f]"), "file contains no text")
    return read.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.col("text")))


def join_pages(pages: list[str | None]) -> tuple[str, list[dict]]:
    """Stripped pages that aren't empty, a blank line between, and their character spans."""
    parts, spans, at = [], [], 0
    for number, page in enumerate(pages, start=1):
        if page := (page or "").strip():
            at += 2 if parts else 0
            spans.append({"char_start": at, "char_end": at + len(page), "page_number": number})
            parts.append(page)
            at += len(page)
    return "\n\n".join(parts), spans


def pypdf_pages(content: bytes) -> list[str]:
    """Page texts by pypdf, if it is installed."""
    import pypdf

    reader = pypdf.PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        raise ValueError("encrypted PDF")
    return [page.extract_text() for page in reader.pages]


def _pdfs(batches: Iterator[pd.DataFrame], extract) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                pages = extract(bytes(content))
                text, spans = join_pages(pages)
                rows.append((path, "pdf", text or None, len(pages), spans, None if text else "file contains no text"))
            except Exception as problem:  # a file that can't be read is a row with its error
                rows.append((path, "pdf", None, None, [], f"{type(problem).__name__}: {problem}"))
        yield pd.DataFrame(rows, columns=["path", "format", "text", "page_count", "spans", "error"])


def parse_pdfs(files: DataFrame, extract=pypdf_pages) -> DataFrame:
    """S3: rows of (path, content) parsed by ``extract`` (bytes to page texts)."""
    return files.where(file_format(F.col("path")) == "pdf").select("path", "content").mapInPandas(partial(_pdfs, extract=extract), PARSED)


def pages_of_range(spans: Column, start: Column, end: Column) -> Column:
    """The numbers of the pages that a character range meets."""
    return F.transform(F.filter(spans, lambda s: (s["char_start"] < end) & (s["char_end"] > start)), lambda s: s["page_number"])


def storage_path(content_hash: Column, filename: Column) -> Column:
    """Where content lies: two hex digits, then hash and suffix."""
    return F.concat(F.left(content_hash, F.lit(2)), F.lit("/"), content_hash, X.suffix(filename))


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER_SCHEMA" not in str(problem):
            raise
        return None


def read_stored(spark: SparkSession, root: str) -> DataFrame | None:
    """(path, content, content_hash, prefix, stored_at) of stored content, without what was deleted since."""
    rows, gone = _table(spark, f"{root}/content"), _table(spark, f"{root}/deleted")
    if rows is None or gone is None:
        return rows
    last = gone.groupBy("content_hash").agg(F.max("deleted_at").alias("deleted_at"))
    met = rows.join(last, "content_hash", "left").where("deleted_at is null or stored_at > deleted_at")
    return met.select(*rows.columns)


def store(files: DataFrame, root: str) -> DataFrame:
    """Append content that isn't stored yet, partitioned by the first two hex digits; returns what was new."""
    from quillgrid.operators.filters import unique_first

    spark = files.sparkSession
    hashed = files.select("path", "content", F.sha2("content", 256).alias("content_hash"))
    new = unique_first(hashed, read_stored(spark, root), "content_hash", ["path"]).withColumns({"prefix": F.left("content_hash", F.lit(2)), "stored_at": F.current_timestamp()})
    new.write.mode("append").partitionBy("prefix").parquet(f"{root}/content")
    return new.select("path", "content_hash")


def delete_stored(hashes: DataFrame, root: str) -> None:
    """A tombstone for each content hash; the bytes go when the table is next rewritten."""
    hashes.select("content_hash", F.current_timestamp().alias("deleted_at")).write.mode("append").parquet(f"{root}/deleted")


def inside_root(uri: Column, root: str) -> Column:
    """Only file URIs below the root, without steps upwards, written plainly or as percent codes."""
    plain = F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(plain, "^file://(localhost)?(?=/)", "file:")
    return F.coalesce(path.startswith(f"file:{root.rstrip('/')}/") & ~path.rlike(r"(^|[/\\\\])\.\.([/\\\\]|$)"), F.lit(False))


def read_inside(spark: SparkSession, uris: list[str], root: str) -> DataFrame:
    """(path, content) of stated URIs; an error names those outside the root."""
    asked = spark.createDataFrame([(u,) for u in uris], "uri string")
    outside = [r.uri for r in asked.where(~inside_root(F.col("uri"), root)).collect()]
    if outside:
        raise ValueError(f"not below the storage root: {', '.join(outside)}")
    return spark.read.format("binaryFile").load(uris).select("path", "content")


def check_counts(rows: DataFrame, wanted: int, what: str) -> None:
    """An error where a dataset doesn't have as many rows as its manifest says."""
    if (n := rows.count()) != wanted:
        raise ValueError(f"{n} {what}, {wanted} expected")


def page_spans(pages: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """W10, S3 over rows of pages: (key, page_number, char_start, char_end) in the text that a blank line joins them to; blank pages are left out."""
    stripped = F.regexp_replace(F.col(text), rf"^{X.SPACE}+|{X.SPACE}+$", "")
    kept = pages.select(key, F.col(number).alias("page_number"), F.length(stripped).alias("_n")).where("_n > 0")
    before = Window.partitionBy(key).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("_n") + 2).over(before), F.lit(0))
    return kept.select(key, "page_number", start.alias("char_start"), (start + F.col("_n")).alias("char_end"))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped, anything else fails."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", T._parse_datatype_string(schema) if isinstance(schema, str) else schema, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("r")).select("r.*")


def read_json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with one JSON object."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def read_manifest(spark: SparkSession, path: str, contents: DataFrame) -> DataFrame:
    """The sources that a manifest {"sources": [{source_path, sha256, page_count, character_count}]} pins; contents
    (source_path, content, text, page_count) must be those bytes, texts and pages, else an error names the first that aren't."""
    pinned = read_json_object(spark, path, "sources array<struct<source_path:string,sha256:string,page_count:int,character_count:int>>").select(F.explode("sources").alias("s")).select("s.*")
    have = contents.select("source_path", F.sha2("content", 256).alias("_sha"), F.length("text").alias("_chars"), F.col("page_count").alias("_pages"))
    met = pinned.join(have, "source_path", "left")
    differs = lambda wanted, got: F.col(wanted).isNotNull() & ~F.col(wanted).eqNullSafe(F.col(got))
    wrong = [r.source_path for r in met.where(differs("sha256", "_sha") | differs("character_count", "_chars") | differs("page_count", "_pages")).orderBy("source_path").limit(20).collect()]
    if wrong:
        raise ValueError(f"sources differ from the manifest: {', '.join(wrong)}")
    return pinned


def read_run(spark: SparkSession, path: str, metrics: str) -> DataFrame:
    """A run's summary; its objects ``metadata`` and ``metrics`` must be there."""
    found = read_json_object(spark, path, f"metadata map<string,string>, metrics struct<{metrics}>")
    if not found.where("metadata is null or metrics is null").isEmpty():
        raise ValueError("a run needs the objects metadata and metrics")
    return found


def gold_record(row_id: Column, question: Column, passages: Column) -> Column:
    """A line of a gold dataset as JSON; its hash is :func:`quillgrid.functions.text.query_id` of the question's."""
    return F.to_json(F.struct(row_id.alias("id"), question.alias("question"), passages.alias("relevant_passages")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """One query a line without # comments; queries that repeat after normalising are an error."""
    found = spark.read.text(path).select(X.normalize(F.col("value")).alias("query")).where("query <> '' and not startswith(query, '#')")
    if not found.groupBy("query").count().where("count > 1").isEmpty():
        raise ValueError("duplicate queries")
    return found.select(X.query_id(F.col("query")).alias("qid"), "query")


def write_results(per_query: DataFrame, summary: DataFrame, path: str) -> None:
    """JSON lines a query, one JSON object and one CSV row for the summary."""
    per_query.write.json(f"{path}/results")
    summary.coalesce(1).write.json(f"{path}/summary")
    summary.coalesce(1).write.option("header", True).csv(f"{path}/summary_csv")


def parse_metrics(lines: DataFrame) -> DataFrame:
    """(name, value) of exposition lines; comments are skipped."""
    kept = lines.where("value <> '' and not startswith(value, '#')")
    return kept.select(F.regexp_extract("value", r"^(\S+)\s+\S+$", 1).alias("name"), F.regexp_replace(F.regexp_extract("value", r"^\S+\s+(\S+)$", 1), "^[+](?=[0-9.I])", "").try_cast("double").alias("value"))


def log_lines(records: DataFrame) -> DataFrame:
    """One JSON object a record."""
    return records.select(F.to_json(F.struct("*")).alias("value"))


def locate_passages(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Character range, text and hash of passages named by a start and an optional end marker on a page.

    annotations: id, source_path, page_number, start_marker, end_marker; pages: source_path, page_number, page_start, page_text."""
    met = annotations.join(pages, ["source_path", "page_number"])
    begin = F.expr("locate(start_marker, page_text)")
    end = F.expr("if(end_marker is null, length(page_text) + 1, locate(end_marker, page_text, locate(start_marker, page_text)) + length(end_marker))")
    found = met.withColumn("_b", begin).withColumn("_e", end).where("_b > 0 and _e > _b")
    text = F.rtrim(F.expr("substring(page_text, _b, _e - _b)"))
    out = found.withColumn("reference_text", text).withColumn("char_start", F.col("page_start") + F.col("_b") - 1)
    return out.withColumn("char_end", F.col("char_start") + F.length("reference_text")).withColumn("text_sha256", F.sha2("reference_text", 256)).select("id", "source_path", "page_number", "char_start", "char_end", "reference_text", "text_sha256")


def gold_violations(gold: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, problem) of gold passages whose hash, range, text, page or length (8 words at least) is wrong; none if all hold.

    Pages are compared where gold has a page_number and documents have the spans of their pages."""
    paged = "page_number" in gold.columns and "spans" in documents.columns
    met = gold.join(documents.select("source_path", F.col("text").alias("_text"), *([F.col("spans").alias("_spans")] if paged else [])), "source_path", "left")
    checks = {"missing source": F.col("_text").isNull(), "hash": F.sha2("reference_text", 256) != F.col("text_sha256"), "text": F.expr("substring(_text, char_start + 1, char_end - char_start)") != F.col("reference_text"), "too short": F.size(F.split(X.normalize(F.col("reference_text")), " ")) < 8}
    if paged:
        checks["page"] = ~F.array_contains(pages_of_range(F.col("_spans"), F.col("char_start"), F.col("char_end")), F.col("page_number"))
    problems = F.filter(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.lit(name)) for name, wrong in checks.items()]), lambda p: p.isNotNull())
    repeated = gold.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    return met.select("id", F.explode(problems).alias("problem")).unionByName(repeated)

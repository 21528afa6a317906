"""Streaming ingestion and rate limiting (T1, T2, T9-T11, W9, T14) on Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillgrid.functions import text as X
from quillgrid.operators.chunking import OVERLAP, SIZE, chunk_fixed
from quillgrid.operators.filters import unique_first
from quillgrid.sources.files import parse_pdfs, parse_texts, pypdf_pages


#: The schema of Spark's binary file source, which a stream must be given.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
EMBEDDED = "document_id string, position int, embedding array<double>, embedding_model string, error string, indexed_at timestamp"
DIMENSION = 768
EMBED_AT_ONCE = 32

#: Texts to vectors, at most ``EMBED_AT_ONCE`` of them.
Embed = Callable[[list[str]], list[list[float]]]


def deterministic(dimension: int = DIMENSION) -> Embed:
    """The embedding that needs no provider."""
    made = X.embed_deterministic(dimension).func
    return lambda texts: made(pd.Series(texts)).tolist()


def _read(spark: SparkSession, path: str, columns: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], columns)


def _embed_all(texts: list[str], embed: Embed, dimension: int) -> list[list[float]]:
    found = []
    for at in range(0, len(texts), EMBED_AT_ONCE):
        batch = texts[at : at + EMBED_AT_ONCE]
        vectors = [[float(x) for x in v] for v in embed(batch)]
        if len(vectors) != len(batch):
            raise ValueError("the embedding provider returned an unexpected number of vectors")
        if not all(len(v) == dimension and all(abs(x) < float("inf") for x in v) for v in vectors):
            raise ValueError("the embedding provider returned an invalid vector")
        found += vectors
    return found


def index_documents(chunks: DataFrame, root: str, run: str, embed: Embed | None = None, model: str = "deterministic", dimension: int = DIMENSION, force: bool = False) -> None:
    """Vectors of chunks, a document at a time in batches; documents that are indexed are skipped unless ``force``.

    A document whose provider fails, or returns too few, short or infinite vectors, has rows with the error and no
    vector, and is taken again by the next call. Each run overwrites its own folder."""
    embed = embed or deterministic(dimension)
    if not force:
        done = _read(chunks.sparkSession, f"{root}/embeddings", EMBEDDED + ", run string").where((F.col("run") != run) & F.col("error").isNull())
        chunks = chunks.join(done.select("document_id").distinct(), "document_id", "left_anti")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        try:
            vectors, error = _embed_all(pdf["text"].tolist(), embed, dimension), None
        except Exception as problem:  # the document stays, with its error
            vectors, error = [None] * len(pdf), str(problem) or type(problem).__name__
        return pdf[["document_id", "position"]].assign(embedding=vectors, embedding_model=model, error=error, indexed_at=pd.Timestamp.now("UTC").tz_localize(None))

    chunks.select("document_id", "position", "text").groupBy("document_id").applyInPandas(one, EMBEDDED).write.mode("overwrite").parquet(f"{root}/embeddings/run={run}")


def index_again(spark: SparkSession, root: str, embed: Embed | None = None, model: str = "deterministic", dimension: int = DIMENSION, force: bool = False) -> None:
    """T11 over all stored chunks: what failed, or with ``force`` everything."""
    index_documents(_read(spark, f"{root}/chunks", "document_id string, position int, text string"), root, f"again-{uuid.uuid4().hex[:12]}", embed, model, dimension, force)


def read_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, position, embedding, embedding_model, indexed_at): the last vector of each chunk."""
    rows = _read(spark, f"{root}/embeddings", EMBEDDED).where("error is null")
    last = F.max_by(F.struct("embedding", "embedding_model", "indexed_at"), "indexed_at").alias("last")
    return rows.groupBy("document_id", "position").agg(last).select("document_id", "position", "last.*")


def ingest_batch(files: DataFrame, batch_id: int, root: str, size: int = SIZE, overlap: int = OVERLAP, extract=pypdf_pages, embed: Embed | None = None, model: str = "deterministic", dimension: int = DIMENSION) -> None:
    """New files of a micro-batch to documents, chunks and vectors; bytes that are stored, or repeat, are skipped.

    PDF pages come by ``extract``; a file that can't be read is a document with its error. Each batch overwrites its own
    folder, so a batch that runs again after a failure leaves the same rows."""
    spark = files.sparkSession
    documents, chunks = f"{root}/documents", f"{root}/chunks"
    known = _read(spark, documents, "content_hash string, batch long").where(F.col("batch") != batch_id).select("content_hash")
    hashed = files.select("path", "content", F.sha2("content", 256).alias("content_hash"))
    new = unique_first(hashed, known, "content_hash", ["path"])
    parsed = parse_texts(new).unionByName(parse_pdfs(new, extract), allowMissingColumns=True).join(new.select("path", "content_hash"), "path")
    rows = parsed.select(F.col("content_hash").alias("document_id"), "content_hash", F.element_at(F.split("path", "/"), -1).alias("filename"), "format", "text", F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"), F.col("error").alias("error_message"), "page_count", "spans")
    rows.write.mode("overwrite").parquet(f"{documents}/batch={batch_id}")
    written = spark.read.parquet(f"{documents}/batch={batch_id}")
    chunk_fixed(written.where("status = 'ready'"), "document_id", "text", size, overlap).write.mode("overwrite").parquet(f"{chunks}/batch={batch_id}")
    index_documents(spark.read.parquet(f"{chunks}/batch={batch_id}"), root, f"batch-{batch_id}", embed, model, dimension)


def ingest_stream(spark: SparkSession, inbox: str, root: str, size: int = SIZE, overlap: int = OVERLAP, extract=pypdf_pages, embed: Embed | None = None, model: str = "deterministic", dimension: int = DIMENSION) -> StreamingQuery:
    """Whatever lies in the inbox and wasn't taken yet, in micro-batches, then stop; the checkpoint resumes it."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", 1000).load(inbox)
    return files.writeStream.foreachBatch(lambda df, n: ingest_batch(df, n, root, size, overlap, extract, embed, model, dimension)).option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start()


class RateLimiter(StatefulProcessor):
    """At most ``limit`` accepted requests of a client in any window; rejected ones aren't recorded."""

    def __init__(self, limit: int, window_s: float):
        self.limit, self.window_s = limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", "ts double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = [row[0] for row in self.accepted.get()]
        for batch in rows:
            out = []
            for ts, request in sorted(zip(batch["ts"], batch["request_id"], strict=True)):
                now = ts.timestamp() if hasattr(ts, "timestamp") else float(ts)
                times = [t for t in times if t > now - self.window_s]
                fits = len(times) < self.limit
                if fits:
                    times.append(now)
                out.append((key[0], int(request), fits))
            yield pd.DataFrame(out, columns=["client", "request_id", "allowed"])
        self.accepted.put([(t,) for t in times])

    def close(self) -> None:
        pass


def rate_limit(requests: DataFrame, limit: int, window_s: float) -> DataFrame:
    """T14 on a stream of (client, ts, request_id): (client, request_id, allowed)."""
    return requests.groupBy("client").transformWithStateInPandas(RateLimiter(limit, window_s), "client long, request_id long, allowed boolean", "Append", "None")


def admit(times: list[float], limit: int, window_s: float) -> list[bool]:
    """The same rule over one client's times."""
    kept: list[float] = []
    out = []
    for now in times:
        kept = [t for t in kept if t > now - window_s]
        out.append(len(kept) < limit)
        kept += [now] * out[-1]
    return out


def rate_limit_batch(requests: DataFrame, limit: int, window_s: float) -> DataFrame:
    """The same over a finished table, a client's requests in one group: one client's log must fit a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "request_id"])
        return pdf.assign(allowed=admit([t.timestamp() for t in pdf["ts"]], limit, window_s))[["client", "request_id", "allowed"]]

    return requests.select("client", "ts", "request_id").groupBy("client").applyInPandas(one, "client long, request_id long, allowed boolean")

"""A job queue over an append-only log: exclusive claims, states with progress, retries and stale leases.

A job's rows are numbered; the last one counts. A claim first creates a file that names the job and the row it follows, which
a store lets only one worker create, and then appends its row: so two workers never hold one job."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import tables
from quillgrid.operators.filters import eligible_jobs, jobs_of_document, stale_jobs

JOB = "id string, document_id string, status string, progress int, attempts int, error_message string, created_at timestamp, next_attempt_at timestamp, locked_at timestamp, worker_id string, started_at timestamp, finished_at timestamp, seq long"
#: The states of a job in order, with the progress each begins with.
STATES = {"queued": 0, "parsing": 10, "chunking": 40, "embedding": 60, "indexing": 90, "completed": 100}


class JobQueue:
    def __init__(self, spark: SparkSession, root: str, max_attempts: int = 3, backoff_s: float = 2.0, lease_s: float = 300.0):
        self.spark, self.root = spark, root.rstrip("/")
        self.max_attempts, self.backoff_s, self.lease = max_attempts, backoff_s, timedelta(seconds=lease_s)

    def log(self) -> DataFrame:
        path = f"{self.root}/jobs"
        return self.spark.read.schema(JOB).parquet(path) if tables.exists(self.spark, path) else self.spark.createDataFrame([], JOB)

    def current(self) -> DataFrame:
        """T5, M6: the last row of each job."""
        return tables.latest(self.log(), ["id"], "seq")

    def _append(self, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in JOB.split(", ")]).write.mode("append").parquet(f"{self.root}/jobs")

    def enqueue(self, document_ids: Iterable[str], now: datetime) -> list[str]:
        """A queued job a document; documents that have one that isn't over get none."""
        busy = {r.document_id for r in self.current().where("status not in ('completed', 'failed')").select("document_id").collect()}
        new = [(uuid.uuid4().hex, d) for d in dict.fromkeys(document_ids) if d not in busy]
        if new:
            self._append(self.spark.createDataFrame([(i, d, "queued", 0, 0, None, now, None, None, None, None, None, 0) for i, d in new], JOB).coalesce(1))
        return [i for i, _ in new]

    def _create(self, name: str, now: datetime) -> bool:
        """Whether this call made the file; one that a lost worker left without a row is removed when its lease is over."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/claims/{name}")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if store.exists(path) and store.getFileStatus(path).getModificationTime() / 1000 < (now - self.lease).timestamp():
            store.delete(path, False)
        try:
            store.create(path, False).close()
        except Exception as problem:
            if "already exists" in str(problem) or "FileAlreadyExists" in str(problem):
                return False
            raise
        return True

    def claim(self, worker: str, now: datetime, job_id: str | None = None) -> dict[str, Any] | None:
        """The oldest eligible job, or the given one if it is eligible; None if there is none, or another worker was first."""
        lost: list[str] = []
        while True:
            found = tables.claim(self.current().where(~F.col("id").isin(lost)) if lost else self.current(), worker, now, job_id).collect()
            if not found:
                return None
            if self._create(f"{found[0].id}-{found[0].seq}", now):
                return self._put(found[0].asDict())
            lost.append(found[0].id)

    def _put(self, job: dict[str, Any], **changes: Any) -> dict[str, Any]:
        row = job | changes | {"seq": job["seq"] + 1}
        self._append(self.spark.createDataFrame([tuple(row[c.split()[0]] for c in JOB.split(", "))], JOB).coalesce(1))
        return row

    def get(self, job_id: str) -> dict[str, Any]:
        found = self.current().where(F.col("id") == job_id).collect()
        if not found:
            raise LookupError("there is no such job")
        return found[0].asDict()

    def set_status(self, job_id: str, status: str, progress: int | None = None, error: str | None = None) -> dict[str, Any]:
        if progress is not None and not 0 <= progress <= 100:
            raise ValueError("progress must be from 0 to 100")
        job = self.get(job_id)
        return self._put(job, status=status, progress=job["progress"] if progress is None else progress, error_message=error)

    def complete(self, job_id: str, now: datetime) -> dict[str, Any]:
        return self._put(self.get(job_id), status="completed", progress=100, error_message=None, next_attempt_at=None, locked_at=None, worker_id=None, finished_at=now)

    def failed(self, job_id: str, error: str, now: datetime) -> dict[str, Any]:
        """Queued again behind a doubling pause, or failed at the last attempt."""
        own = self.current().where(F.col("id") == job_id)
        row = tables.after_failure(own, error, now, self.max_attempts, self.backoff_s).first()
        if row is None:
            raise LookupError("there is no such job")
        return self._put(row.asDict())

    def recover_stale(self, now: datetime) -> int:
        """How many jobs of lost workers were queued again."""
        stale = self.current().where(stale_jobs(F.lit(now - self.lease)))
        rows = [r.asDict() for r in tables.recover_stale(stale, now - self.lease, now).collect()]
        for row in rows:
            self._put(row)
        return len(rows)

    def of_document(self, document_id: str) -> DataFrame:
        return jobs_of_document(self.current(), document_id)

    def waiting(self, now: datetime) -> DataFrame:
        return self.current().where(eligible_jobs(F.lit(now)))


def execute(queue: JobQueue, job: dict[str, Any], process: Callable[[str], Any], index: Callable[[str], Any], now: Callable[[], datetime]) -> dict[str, Any]:
    """A claimed job's document is processed, then indexed; what goes wrong is written to the job and doesn't end the worker."""
    try:
        process(job["document_id"])
        queue.set_status(job["id"], "embedding", STATES["embedding"])
        index(job["document_id"])
        queue.set_status(job["id"], "indexing", STATES["indexing"])
    except Exception as problem:  # the job keeps its error
        return queue.failed(job["id"], str(problem) or type(problem).__name__, now())
    return queue.complete(job["id"], now())


def run_available(queue: JobQueue, worker: str, process: Callable[[str], Any], index: Callable[[str], Any], now: Callable[[], datetime]) -> int:
    """Stale leases are recovered, then every job that can be claimed is run; how many were."""
    queue.recover_stale(now())
    n = 0
    while (job := queue.claim(worker, now())) is not None:
        execute(queue, job, process, index, now)
        n += 1
    return n


def index_summary(chunks: DataFrame, embeddings: DataFrame, batch: int = 32) -> DataFrame:
    """(document_id, chunks, indexed, batches, indexing_status) of each document; batches are those its chunks are sent in."""
    held = embeddings.where("embedding is not null").select("document_id", "position").distinct().withColumn("_in", F.lit(1))
    met = chunks.join(held, ["document_id", "position"], "left").groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("_in").alias("indexed"))
    return met.withColumns({"batches": F.ceil(F.col("chunks") / batch), "indexing_status": F.when(F.col("indexed") == F.col("chunks"), "indexed").otherwise("pending")})

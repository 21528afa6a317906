"""Mutable tables as append-only logs with latest-wins views, job states and versioned query caches."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions import text as X
from quillgrid.operators.filters import eligible_jobs, stale_jobs


def latest(log: DataFrame, key: list[str], sequence: str, deleted: str | None = None) -> DataFrame:
    """M6, M7, T5: of each key the row with the highest sequence, unless that row is a tombstone. One shuffle, combined map-side."""
    others = [c for c in log.columns if c not in key]
    rows = log.groupBy(*key).agg(F.max_by(F.struct(*others), sequence).alias("_row")).select(*key, "_row.*")
    return rows if deleted is None else rows.where(~F.coalesce(F.col(deleted), F.lit(False)))


def without_deleted(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """M4, M5: rows, of a table or of one that refers to it, whose key wasn't deleted."""
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def next_positions(messages: DataFrame, key: str) -> DataFrame:
    """A3."""
    return messages.groupBy(key).agg((F.max("position") + 1).alias("position"))


def claim(jobs: DataFrame, worker: str, now: datetime, job_id: str | None = None) -> DataFrame:
    """The oldest eligible job, or the given one if it is eligible, as claimed by a worker; no row if there is none."""
    at = F.lit(now)
    asked = jobs if job_id is None else jobs.where(F.col("id") == job_id)
    first = asked.where(eligible_jobs(at)).orderBy("created_at", "id").limit(1)
    taken = {"status": F.lit("parsing"), "progress": F.lit(10), "attempts": F.col("attempts") + 1, "worker_id": F.lit(worker), "locked_at": at, "started_at": F.coalesce("started_at", at), "next_attempt_at": F.lit(None).cast("timestamp"), "error_message": F.lit(None).cast("string")}
    return first.withColumns({c: v for c, v in taken.items() if c in jobs.columns})


def recover_stale(jobs: DataFrame, before: datetime, now: datetime | None = None) -> DataFrame:
    """Active jobs whose lease ran out are queued again, to be taken at once; attempts and progress stay."""
    stale = stale_jobs(F.lit(before))
    put = lambda c, value: F.when(stale, value).otherwise(F.col(c)).cast(jobs.schema[c].dataType)
    values = {"worker_id": F.lit(None), "locked_at": F.lit(None), "status": F.lit("queued"), "next_attempt_at": F.lit(now), "error_message": F.lit("recovered stale worker lease"), "finished_at": F.lit(None)}
    return jobs.withColumns({c: put(c, v) for c, v in values.items() if c in jobs.columns})


def after_failure(jobs: DataFrame, error: str, now: datetime, max_attempts: int = 3, backoff_s: float = 2.0) -> DataFrame:
    """Queued again behind a doubling pause, or failed at the last attempt."""
    again = F.col("attempts") < max_attempts
    pause = F.make_dt_interval(secs=F.lit(backoff_s) * F.pow(F.lit(2.0), F.col("attempts") - 1))
    more = {"progress": F.when(again, 0).otherwise(F.col("progress")).cast("int"), "finished_at": F.when(~again, F.lit(now))}
    return jobs.withColumns({c: v for c, v in more.items() if c in jobs.columns} | {"status": F.when(again, "queued").otherwise("failed"), "error_message": F.lit(error), "next_attempt_at": F.when(again, F.lit(now) + pause), "locked_at": F.lit(None).cast("timestamp"), "worker_id": F.lit(None).cast("string")})


def canonical_json(value: Any) -> str:
    """sorted keys, no blanks, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def expired(expires_at: Column, now: Column) -> Column:
    """P12."""
    return expires_at <= now


def versions_at(log: DataFrame, seq: str, invalidates: Column, span: int = 1_000_000) -> DataFrame:
    """``log`` with the corpus version under which each entry ran: 1, and 1 more for each invalidation at an earlier place.

    ``seq`` is the entry's number in the log, whole and not null; entries of one number see the same version. Invalidations are
    counted by stretches of ``span`` numbers, running sums over stretches (one row each) give what a stretch begins with, and
    only within a stretch are entries put in order: no task holds the log. Columns of ``log`` named _stretch and _now aren't allowed."""
    marked = log.withColumns({"_stretch": F.floor(F.col(seq) / span), "_now": F.coalesce(invalidates, F.lit(False)).cast("long")})
    counted = marked.groupBy("_stretch").agg(F.sum("_now").alias("_many"))
    earlier = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    begun = counted.select("_stretch", F.coalesce(F.sum("_many").over(earlier), F.lit(0)).alias("_begun"))
    within = Window.partitionBy("_stretch").orderBy(seq).rangeBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("_within", F.coalesce(F.sum("_now").over(within), F.lit(0))).join(begun, "_stretch")
    return placed.withColumn("corpus_version", 1 + F.col("_begun") + F.col("_within")).drop("_stretch", "_now", "_begun", "_within")



class QueryCache:
    """Embedding and result caches of one service, as dictionaries on the driver; every result key holds the
    corpus version, so that results of an older corpus can't be reached. Hits, misses and the like are counted."""

    def __init__(self, embeddings: bool = True, results: bool = True, embedding_ttl_s: int = 86_400, result_ttl_s: int = 3_600):
        if embedding_ttl_s <= 0 or result_ttl_s <= 0:
            raise ValueError("cache lifetimes must be positive")
        self.on = {"embedding": embeddings, "retrieval": results}
        self.ttl = {"embedding": timedelta(seconds=embedding_ttl_s), "retrieval": timedelta(seconds=result_ttl_s)}
        self.rows: dict[str, dict[str, tuple[datetime, Any]]] = {"embedding": {}, "retrieval": {}}
        self.version = 1
        self.events: list[tuple[str, str]] = []

    def _find(self, cache: str, key: str) -> tuple[datetime, Any] | None:
        return self.rows[cache].get(key)

    def _keep(self, cache: str, key: str, until: datetime, value: Any) -> None:
        self.rows[cache][key] = (until, value)

    def get(self, cache: str, key: str, now: datetime, valid: Callable[[Any], bool] = lambda value: True) -> tuple[str, Any]:
        """(status, value): disabled, miss, expired, invalid (a stored value that ``valid`` refuses) or hit."""
        found = self._find(cache, key) if self.on[cache] else None
        if not self.on[cache]:
            status, value = "disabled", None
        elif found is None:
            status, value = "miss", None
        elif found[0] <= now:
            status, value = "expired", None
        else:
            status, value = ("hit", found[1]) if valid(found[1]) else ("invalid", None)
        self.events.append((cache, status))
        return status, value

    def put(self, cache: str, key: str, value: Any, now: datetime) -> None:
        if self.on[cache]:
            self._keep(cache, key, now + self.ttl[cache], value)

    def corpus_version(self) -> int:
        return self.version if self.on["retrieval"] else 0

    def invalidate(self, reason: str) -> int:
        self.version += 1
        self.rows["retrieval"].clear()
        self.events.append(("invalidation", reason))
        return self.version

    def clear(self) -> None:
        for rows in self.rows.values():
            rows.clear()

    @staticmethod
    def embedding_key(model: str, dimension: int, query: str) -> str:
        return sha256(canonical_json({"dimension": dimension, "model": model, "query": " ".join(query.split())}))

    @staticmethod
    def retrieval_key(query: str, mode: str, top: int, weight: float, filters: dict[str, list], model: str | None, multiplier: int, rrf_k: int, version: int) -> str:
        kept = {k: sorted(v, key=str) if isinstance(v, list) else v for k, v in filters.items()}
        return sha256(canonical_json({"query": " ".join(query.split()), "mode": mode, "top_k": top, "vector_weight": weight, "filters": kept, "model": model, "candidate_multiplier": multiplier, "rrf_k": rrf_k, "corpus_version": version}))

    def metrics(self, spark: SparkSession) -> DataFrame:
        """(cache, status, n)."""
        return spark.createDataFrame(self.events, "cache string, status string").groupBy("cache", "status").agg(F.count("*").alias("n"))


CACHE_LOG = "cache string, key string, payload string, expires_at timestamp, version long, seq long"


class StoredCache(QueryCache):
    """The same over an append-only log in a folder: values as JSON, the last row of a key counts, a bump
    of the corpus version is a row too. What one service stores another finds, after a restart as well."""

    def __init__(self, spark: SparkSession, root: str, **options: Any):
        super().__init__(**options)
        self.spark, self.path = spark, f"{root}/query-cache"

    def _log(self) -> DataFrame:
        return self.spark.createDataFrame([], CACHE_LOG) if not exists(self.spark, self.path) else self.spark.read.schema(CACHE_LOG).parquet(self.path)

    def _append(self, cache: str, key: str | None, payload: str | None, until: datetime | None, version: int | None) -> None:
        self.spark.createDataFrame([(cache, key, payload, until, version, time.time_ns())], CACHE_LOG).coalesce(1).write.mode("append").parquet(self.path)

    def _find(self, cache: str, key: str) -> tuple[datetime, Any] | None:
        log = self._log()
        cleared = log.where("cache = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(0)).alias("at")).first().at
        row = log.where((F.col("cache") == cache) & (F.col("key") == key) & (F.col("seq") > cleared)).agg(F.max_by(F.struct("payload", F.unix_micros("expires_at").alias("until")), "seq").alias("r")).first().r
        return None if row is None else (datetime.fromtimestamp(row.until / 1e6, UTC), json.loads(row.payload))

    def _keep(self, cache: str, key: str, until: datetime, value: Any) -> None:
        self._append(cache, key, canonical_json(value), until, None)

    def corpus_version(self) -> int:
        if not self.on["retrieval"]:
            return 0
        return self._log().where("cache = 'version'").agg(F.coalesce(F.max("version"), F.lit(1)).alias("v")).first().v

    def invalidate(self, reason: str) -> int:
        """Rows of older versions stay in the log, out of reach: every result's key holds the version."""
        version = self._log().where("cache = 'version'").agg(F.coalesce(F.max("version"), F.lit(1)).alias("v")).first().v + 1
        self._append("version", reason, None, None, version)
        self.events.append(("invalidation", reason))
        return version

    def clear(self) -> None:
        self._append("clear", None, None, None, None)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def request_counters(log: DataFrame) -> DataFrame:
    """Requests and summed seconds by (method, route, status) of a request log with duration_ms."""
    return log.groupBy("method", "route", "status").agg(F.count("*").alias("requests"), F.round(F.sum("duration_ms") / 1000, 6).alias("seconds"))


def exposition(counts: DataFrame, name: str, labels: list[str], value: str = "n") -> DataFrame:
    """Counters as exposition lines."""
    parts = [F.concat(F.lit(f'{c}="'), X.escape_label(F.col(c)), F.lit('"')) for c in labels]
    return counts.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("value"))


def build_trace(queries: list[str], requests: int, repeat_rate: float, seed: int = 42) -> list[str]:
    """Unique queries, then repeats of them at the given rate, shuffled."""
    if requests <= 0 or not 0 <= repeat_rate <= 1:
        raise ValueError("request count must be positive and repeat rate between 0 and 1")
    rng = random.Random(seed)
    unique = max(1, round(requests * (1 - repeat_rate)))
    if unique > len(queries):
        raise ValueError("not enough unique queries")
    first = rng.sample(queries, unique)
    trace = first + [rng.choice(first) for _ in range(requests - unique)]
    rng.shuffle(trace)
    return trace

"""Composed operators for one caller: cached search, context and grounded chat."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import text as X
from quillgrid.operators import chat, chunking, context, filters, retrieval
from quillgrid.operators.conversations import Conversations
from quillgrid.operators.tables import QueryCache

Embed = Callable[[str], list[float]]


class SearchService:
    """Search over a table of chunks (chunk_id, document_id, filename, media_type, position, text, metadata JSON, embedding).

    A search is one lazily planned DataFrame; only its hits, at most top_k, come to the driver, where they are cached."""

    def __init__(self, chunks: DataFrame, embed: Embed, model: str, dimension: int, cache: QueryCache | None = None, candidate_multiplier: int = 4, rrf_k: int = 60):
        if candidate_multiplier <= 0 or rrf_k < 0:
            raise ValueError("candidate_multiplier must be positive and rrf_k at least 0")
        self.chunks, self.embed, self.model, self.dimension = chunks, embed, model, dimension
        self.cache, self.multiplier, self.rrf_k = cache or QueryCache(), candidate_multiplier, rrf_k
        self.provider_calls = 0

    def embed_query(self, query: str, now: datetime) -> tuple[str, list[float]]:
        """From the cache, or from the provider, checked for length and finite values."""
        key = self.cache.embedding_key(self.model, self.dimension, query)
        valid = lambda v: len(v) == self.dimension and all(abs(x) < float("inf") for x in v)
        status, vector = self.cache.get("embedding", key, now, valid)
        if status != "hit":
            self.provider_calls += 1
            vector = [float(x) for x in self.embed(query)]
            if not valid(vector):
                raise ValueError("the embedding provider returned an invalid vector")
            self.cache.put("embedding", key, vector, now)
        return status, vector

    def search(self, query: str, mode: str = "hybrid", top_k: int = 10, vector_weight: float = 0.7, filenames: list[str] | None = None, media_types: list[str] | None = None, document_ids: list[str] | None = None, metadata: dict[str, Any] | None = None, now: datetime | None = None) -> dict[str, Any]:
        """Hits with the statuses of both caches and the corpus version they hold for."""
        query, now = " ".join(query.split()), now or datetime.now(UTC)
        if not query:
            raise ValueError("query must not be blank")
        needs_vector, _ = retrieval.branches(mode, top_k, vector_weight)
        version = self.cache.corpus_version()
        given = {"filenames": filenames or [], "media_types": media_types or [], "document_ids": document_ids or [], "metadata": metadata or {}}
        key = self.cache.retrieval_key(query, mode, top_k, vector_weight, given, self.model, self.multiplier, self.rrf_k, version)
        status, hits = self.cache.get("retrieval", key, now)
        if status == "hit":
            return {"query": query, "mode": mode, "hits": hits, "embedding_cache": "skipped", "retrieval_cache": "hit", "corpus_version": version}
        embedded, vector = self.embed_query(query, now) if needs_vector else ("not_used", None)
        asked = self.chunks.sparkSession.createDataFrame([(0, query, vector)], "qid int, query string, vector array<double>")
        where = filters.search_filters(document_ids, filenames, media_types) & filters.metadata_equals(F.col("metadata"), metadata or {})
        found = retrieval.search(self.chunks, asked, mode=mode, top=top_k, vector_weight=vector_weight, where=where, candidate_multiplier=self.multiplier, rrf_k=self.rrf_k)
        joined = self.chunks.drop("embedding").join(F.broadcast(found), "chunk_id")  # top_k rows
        hits = [r.asDict() for r in sorted(joined.collect(), key=lambda r: r["rank"])]
        self.cache.put("retrieval", key, hits, now)
        return {"query": query, "mode": mode, "hits": hits, "embedding_cache": embedded, "retrieval_cache": status, "corpus_version": version}

    def build_context(self, query: str, candidate_k: int = 20, max_chunks: int = 8, max_tokens: int = 1200, rerank: bool = True, rerank_weight: float = 0.7, **options: Any) -> dict[str, Any]:
        """Reranked, deduplicated, budgeted chunks and the context text that numbers them."""
        hits = self.search(query, top_k=candidate_k, **options)["hits"]
        if not hits:
            return {"context": "", "chunks": [], "token_count": 0, "truncated": False, "duplicates_removed": 0}
        spark = self.chunks.sparkSession
        rows = spark.createDataFrame([(0, h["chunk_id"], query, h["text"], float(h["score"]), h["rank"], h["filename"], h["media_type"], h["position"], json.dumps(json.loads(h["metadata"] or "{}"), ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for h in hits], "qid int, chunk_id string, query string, text string, score double, rank int, filename string, media_type string, position int, metadata string")
        unique = context.deduplicate(context.rerank(rows, "chunk_id", weight=rerank_weight, enabled=rerank), key="chunk_id")
        head = X.header(F.col("unique_place"), F.col("filename"), F.col("media_type"), F.col("position"), F.col("metadata"))
        fitted = context.fit_budget(unique, head, max_chunks=max_chunks, max_tokens=max_tokens).withColumn("block", F.concat(head, F.lit("\n"), F.col("context_text")))
        total = unique.count()
        kept = [r.asDict() for r in fitted.orderBy("citation_id").collect()]
        return {"context": "\n\n".join(r["block"] for r in kept), "chunks": kept, "token_count": sum(len(chunking._TOKEN.findall(r["block"])) for r in kept), "truncated": len(kept) < total or any(r["truncated"] for r in kept), "duplicates_removed": len(hits) - total}

    def ask(self, question: str, history: chat.Turns, generate: Callable[[chat.Turns], str], store: Callable[[str, str, list], None], **options: Any) -> dict[str, Any]:
        """An answer with the chunks it cites."""
        package = self.build_context(question, **options)
        return chat.ask(question, package["context"], {r["citation_id"]: r["chunk_id"] for r in package["chunks"]}, history, generate, store)

    def converse(self, question: str, conversations: Conversations, generate: Callable[[chat.Turns], str], conversation_id: str | None = None, now: datetime | None = None, **options: Any) -> dict[str, Any]:
        """C5, C6 over stored conversations: the history is read before the question is stored; without an id a conversation is begun."""
        if not question.strip():
            raise ValueError("question must not be blank")
        now = now or datetime.now(UTC)
        if conversation_id is not None and not conversations.exists(conversation_id):
            raise LookupError("conversation not found")
        history = conversations.history(conversation_id) if conversation_id else []
        key = conversation_id or conversations.create(question, now)
        return self.ask(question, history, generate, lambda role, content, cited: conversations.append(key, role, content, cited, now), **options) | {"conversation_id": key}

    def run_workload(self, trace: list[str], concurrency: int = 1, **options: Any) -> DataFrame:
        """C11: the measurements of a trace of queries, ``concurrency`` requests at a time, a row a request."""

        def one(i: int, query: str) -> tuple:
            began = time.perf_counter()
            got = self.search(query, **options)
            return (i, got["query"], (time.perf_counter() - began) * 1000, 200, got["embedding_cache"], got["retrieval_cache"], got["corpus_version"], [h["chunk_id"] for h in got["hits"]])

        with ThreadPoolExecutor(concurrency) as pool:
            rows = list(pool.map(one, range(len(trace)), trace))
        return self.chunks.sparkSession.createDataFrame(rows, "request_index int, query string, latency_ms double, status_code int, embedding_cache string, retrieval_cache string, corpus_version long, chunk_ids array<string>")

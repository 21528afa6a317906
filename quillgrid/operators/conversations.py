"""Stored conversations as append-only tables."""

from __future__ import annotations

import json
import uuid
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import text as X
from quillgrid.operators import context, filters
from quillgrid.operators.tables import exists, without_deleted

CONVERSATION = "id string, title string, created_at timestamp"
MESSAGE = "conversation_id string, position int, role string, content string, citations string, created_at timestamp"


class Conversations:
    """Conversations and their messages below a folder; one writer a conversation at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def _gone(self) -> DataFrame:
        return self._read("deleted", "conversation_id string")

    def create(self, question: str, now: datetime) -> str:
        """A conversation that is named by its first question."""
        key, title = uuid.uuid4().hex, " ".join(question.split())[:80]
        self._append("conversations", CONVERSATION, (key, title, now))
        return key

    def all_messages(self) -> DataFrame:
        return without_deleted(self._read("messages", MESSAGE), self._gone(), "conversation_id")

    def messages(self, key: str) -> DataFrame:
        """In order."""
        return filters.messages_of_conversation(self.all_messages(), key)

    def append(self, key: str, role: str, content: str, citations: list[Any], now: datetime) -> int:
        """M3: the message's position, one behind the last."""
        last = self.all_messages().where(F.col("conversation_id") == key).agg(F.max("position").alias("p")).first().p
        position = 0 if last is None else last + 1
        self._append("messages", MESSAGE, (key, position, role, content, json.dumps(citations, default=str), now))
        return position

    def page(self, offset: int = 0, limit: int = 100) -> DataFrame:
        """(id, title, updated_at, messages, next_position), the one with the last message first."""
        heads = without_deleted(self._read("conversations", CONVERSATION).withColumnRenamed("id", "conversation_id"), self._gone(), "conversation_id")
        said = self.all_messages()
        touched = said.groupBy("conversation_id").agg(F.max("created_at").alias("said_at"))
        listed = context.conversations(heads, said, "conversation_id").join(touched, "conversation_id", "left")
        rows = listed.select(F.col("conversation_id").alias("id"), "title", F.coalesce("said_at", "created_at").alias("updated_at"), "messages", "next_position")
        return filters.page(rows, [F.desc("updated_at"), F.col("id")], offset, limit)

    def exists(self, key: str) -> bool:
        return not without_deleted(self._read("conversations", CONVERSATION).withColumnRenamed("id", "conversation_id"), self._gone(), "conversation_id").where(F.col("conversation_id") == key).isEmpty()

    def delete(self, key: str) -> None:
        """M5: with its messages."""
        self._append("deleted", "conversation_id string", (key,))

    def history(self, key: str, most: int = 20, budget: int = 2000) -> list[dict[str, str]]:
        """The turns before a new question, oldest first."""
        own = self.all_messages().where((F.col("conversation_id") == key) & F.col("role").isin("user", "assistant"))
        kept = context.history_window(own, "conversation_id", "position", X.token_count(F.col("content")), most, budget)
        return [{"role": r.role, "content": r.content} for r in kept.orderBy("position").collect()]  # at most ``most`` rows

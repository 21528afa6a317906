"""Predicates of retrieval: conjunctive filters, metadata equality and containment, lookups."""

from __future__ import annotations

import functools
import operator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conjunction(parts: list[Column]) -> Column:
    return functools.reduce(operator.and_, parts, F.lit(True))


def search_filters(document_ids: list | None = None, filenames: list | None = None, media_types: list | None = None, id_col: str = "document_id", filename_col: str = "filename", media_col: str = "media_type") -> Column:
    """Values of a field are alternatives, fields must all hold, an empty list is no condition."""
    given = ((id_col, document_ids), (filename_col, filenames), (media_col, media_types))
    return conjunction([F.col(c).isin(list(values)) for c, values in given if values])


_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _scalar(value: Column, wanted: Any) -> Column:
    """A variant is this string, number, boolean or null, of the same JSON type; 2 and 2.0 are one number."""
    kind = F.schema_of_variant(value)
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))
    exact = "decimal(38,0)" if isinstance(wanted, int) and abs(wanted) > 1 << 53 else "double"
    return kind.rlike(_NUMBER) & (F.try_variant_get(value, "$", exact) == F.lit(str(wanted)).cast(exact))


def _equals(value: Column, wanted: Any) -> Column:
    if isinstance(wanted, dict):
        parts = [F.size(_members(value)) == len(wanted)] + [_equals(F.try_element_at(_members(value), F.lit(k)), v) for k, v in wanted.items()]
    elif isinstance(wanted, list):
        parts = [F.size(_elements(value)) == len(wanted)] + [_equals(F.get(_elements(value), F.lit(i)), v) for i, v in enumerate(wanted)]
    else:
        parts = [_scalar(value, wanted)]
    return F.coalesce(conjunction(parts), F.lit(False))


def _any_contains(values: Column, wanted: Any) -> Column:
    return F.exists(values, lambda x: _contains(x, wanted))


def _contains(value: Column, wanted: Any) -> Column:
    if isinstance(wanted, dict):
        parts = [_members(value).isNotNull()] + [_contains(F.try_element_at(_members(value), F.lit(k)), v) for k, v in wanted.items()]
    elif isinstance(wanted, list):
        parts = [_elements(value).isNotNull()] + [_any_contains(_elements(value), v) for v in wanted]
    else:
        parts = [_scalar(value, wanted)]
    return F.coalesce(conjunction(parts), F.lit(False))


def metadata_equals(metadata: Column, wanted: dict[str, Any]) -> Column:
    """P2, F17 over JSON text: top-level members equal in type and value; a wanted null matches a missing member too."""
    members = _members(F.try_parse_json(metadata))
    parts = []
    for key, value in wanted.items():
        found = F.try_element_at(members, F.lit(key))
        parts.append((found.isNull() | F.is_variant_null(found)) if value is None else _equals(found, value))
    return conjunction(parts)


def metadata_contains(metadata: Column, wanted: Any) -> Column:
    """P3 over JSON text: objects contain by key, recursively; an array contains each wanted element; scalars are equal in type and value."""
    return _contains(F.try_parse_json(metadata), wanted)


def filename_contains(filename: Column, part: str) -> Column:
    """P16."""
    return F.lower(filename).contains(part.lower())


def upload_size(length: Column, most: int) -> Column:
    """P15."""
    return (length > 0) & (length <= most)


def point_lookup(df: DataFrame, column: str, value: Any) -> DataFrame:
    """P6, P20."""
    return df.where(F.col(column) == F.lit(value)).limit(1)


def eligible_jobs(now: Column) -> Column:
    """P9."""
    return (F.col("status") == "queued") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))


def stale_jobs(before: Column) -> Column:
    """P10."""
    return F.col("status").isin("parsing", "chunking", "embedding", "indexing") & (F.col("locked_at").isNull() | (F.col("locked_at") < before))


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of a total order."""
    if offset < 0 or limit <= 0:
        raise ValueError("offset must be at least 0 and limit positive")
    return df.orderBy(*order).offset(offset).limit(limit)


def jobs_of_document(jobs: DataFrame, document_id: Any) -> DataFrame:
    """A document's jobs, oldest first."""
    return jobs.where(F.col("document_id") == F.lit(document_id)).orderBy("created_at", "id")


def chunks_of_document(chunks: DataFrame, document_id: Any) -> DataFrame:
    """A document's chunks in order."""
    return chunks.where(F.col("document_id") == F.lit(document_id)).orderBy("position")


def messages_of_conversation(messages: DataFrame, conversation_id: Any, key: str = "conversation_id") -> DataFrame:
    """A conversation's messages in order."""
    return messages.where(F.col(key) == F.lit(conversation_id)).orderBy("position")


def unique_first(new: DataFrame, existing: DataFrame | None, content_hash: str, order: list[str]) -> DataFrame:
    """Rows whose content hash is new, the first of each hash inside the batch."""
    least = new.groupBy(content_hash).agg(F.min(F.struct(*order)).alias("_first"))
    first = new.join(least, content_hash).where(F.struct(*order) == F.col("_first")).drop("_first")
    return first if existing is None else first.join(existing.select(content_hash).distinct(), content_hash, "left_anti")

"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import ann, cotraining, linededup, media, merkle, mixing, negatives, packing, sigtree, simhash, tokencounts, tokenpack, toxicity
from quillgrid.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(found.fp).alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencounts.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return counts.withColumnRenamed("key", "doc_id")


def op4_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotraining.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "content_score", "metadata_score", "quality_score", F.col("quality_keep").alias("keep"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_before", "lines_deleted")


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = tokenpack.write_matrices(tokenpack.pack_token_ids(table(spark, sf_dir, "documents")))
    return packed.select("sequence_id", "n_tokens", tokenpack.crc32("ids").alias("ids_crc32"), "cu_seqlens", "doc_ids", "doc_starts", "position_resets")


def op7_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(table(spark, sf_dir, "documents"))


def op9_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.without_newlines())


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.similar_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made for name, made in globals().items() if name.startswith("op") and name[2].isdigit()}


_HARD_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT own AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3"""


_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id"""


def _merkle_sql(levels: int = 9, outer: int = 4) -> str:
    """Level by level, as many as 19,683 rows a source and 81 sources need; a tree that has reached its root stays as it is."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({part('doc_id')} || {part('source')} || {part('lang')} || {part('n_chars')} || {part(text)})"
    # CRC-32 (reversed polynomial 0xEDB88320) of the digits of doc_id: its lowest bit
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substring(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda d, _: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END)), 4294967295)"
    made = [f"rows AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('later')} AS later FROM (SELECT *, CASE WHEN ({crc}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS later FROM documents))"]
    made.append("t0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, '' AS proof, later AS fold FROM rows), n0 AS (SELECT source, pos, leaf AS digest FROM t0)")

    def rise(tree: str, node: str, keys: str, i: int) -> None:
        over = f"(PARTITION BY {keys} pos // 3 ORDER BY pos ROWS BETWEEN"
        made.append(f"""s{tree}{i} AS (SELECT *, count(*) OVER ({"PARTITION BY " + keys.rstrip(", ") if keys else ""}) = 1 AS done, coalesce(string_agg(digest, '' ORDER BY pos) OVER {over} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(digest, '' ORDER BY pos) OVER {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {node}{i})""")
        same = "t.source IS NOT DISTINCT FROM s.source AND t.pos = s.pos" if keys else "t.pos = s.pos"
        made.append(f"""{tree}{i + 1} AS (SELECT t.* EXCLUDE (pos, proof, fold), t.pos // 3 AS pos, t.proof || s.before || s.after AS proof, CASE WHEN done THEN fold ELSE sha256(s.before || fold || s.after) END AS fold FROM {tree}{i} t JOIN s{tree}{i} s ON {same})""")
        digest = f"CASE WHEN any_value(done) THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest"
        made.append(f"{node}{i + 1} AS (SELECT {keys} pos // 3 AS pos, {digest} FROM s{tree}{i} GROUP BY {keys} pos // 3)")

    for i in range(levels):
        rise("t", "n", "source, ", i)
    made.append(f"subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM n{levels}), m0 AS (SELECT pos, subroot AS digest FROM subroots)")
    made.append(f"u0 AS (SELECT t.* EXCLUDE (pos), r.subroot, r.pos FROM t{levels} t JOIN subroots r ON t.source IS NOT DISTINCT FROM r.source)")
    for i in range(outer):
        rise("u", "m", "", i)
    return "WITH " + ", ".join(made) + f" SELECT doc_id, leaf, subroot, (SELECT digest FROM m{outer}) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT digest FROM m{outer}) AS verified FROM u{outer}"


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": _HARD_NEGATIVES, "op12_merkle_manifest": _merkle_sql(), "op13_ngram_jaccard": _JACCARD}

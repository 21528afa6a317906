"""English full-text queries: every sentence of every benchmark text asks all documents; with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import english, retrieval
from quillgrid.plans import catalog as C
from quillgrid.plans.catalog import r6, register, table


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.\n]", -1)).alias("at", "query"))
    return parts.select(F.concat_ws("-", "item_id", F.col("at") + 1).alias("qid"), "query")


def document_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kept(spark, sf_dir, "document-lexicon", lambda: english.lexicon(C.document_index(spark, sf_dir)))


def _replaced(endings: dict[str, str], region: str, but: str = "true") -> str:
    """One step of the stemmer as SQL: the new w, where s is the longest of the endings that w has."""
    made = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in endings.items())
    return f"CASE WHEN s <> '' AND length(w) - length(s) >= {region} AND ({but}) THEN left(w, length(w) - length(s)) || CASE s {made} END ELSE w END"


def _longest(endings: dict[str, str]) -> str:
    return f"regexp_extract(w, '({'|'.join(endings)})$', 0)"


_FIRST = "^.*?[aeiouy][^aeiouy]"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])"
_STOP = ", ".join(f"'{w}'" for w in english.STOP)
_WHOLE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in english.WHOLE.items())
_AFTER = ", ".join(f"'{w}'" for w in english.AFTER_PLURAL)

# stems(term, stem) of all words of documents and sentences
_STEMS = f"""q AS (SELECT item_id, unnest(regexp_split_to_array(text, '[.\\n]')) query, generate_subscripts(regexp_split_to_array(text, '[.\\n]'), 1) nth FROM benchmark),
qt AS (SELECT DISTINCT item_id || '-' || nth qid, unnest({C.terms_sql('query')}) term FROM q),
dt AS (SELECT doc_id, unnest({C.terms_sql('text')}) term, generate_subscripts({C.terms_sql('text')}, 1) pos FROM documents),
w0 AS (SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') w FROM (SELECT term FROM qt UNION SELECT term FROM dt) WHERE term NOT IN ({_STOP})),
w1 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun)') THEN (CASE WHEN w LIKE 'gener%' THEN 5 ELSE 6 END) WHEN w LIKE 'arsen%' THEN 5 WHEN regexp_matches(w, '{_FIRST}') THEN length(regexp_extract(w, '{_FIRST}', 0)) ELSE length(w) END p1 FROM w0),
w2 AS (SELECT *, CASE WHEN regexp_matches(substr(w, p1 + 1), '{_FIRST}') THEN p1 + length(regexp_extract(substr(w, p1 + 1), '{_FIRST}', 0)) ELSE length(w) END p2 FROM w1),
w3 AS (SELECT * REPLACE (CASE WHEN w LIKE '%sses' THEN left(w, -2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, CASE WHEN length(w) > 4 THEN -2 ELSE -1 END) WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, -1) ELSE w END AS w) FROM w2),
w4 AS (SELECT *, CASE WHEN w IN ({_AFTER}) THEN w END kept, regexp_extract(w, 'eed(ly)?$', 0) eed, CASE WHEN regexp_matches(w, '[aeiouy].*(edly|ingly|ed|ing)$') AND NOT regexp_matches(w, 'eed(ly)?$') THEN regexp_extract(w, '(edly|ingly|ed|ing)$', 0) ELSE '' END cut FROM w3),
w5 AS (SELECT * REPLACE (CASE WHEN eed <> '' THEN CASE WHEN length(w) - length(eed) >= p1 THEN left(w, length(w) - length(eed)) || 'ee' ELSE w END ELSE left(w, length(w) - length(cut)) END AS w) FROM w4),
w6 AS (SELECT * REPLACE (CASE WHEN cut = '' THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(w, length(w) - 1) WHEN length(w) <= p1 AND regexp_matches(w, '{_SHORT}$') THEN w || 'e' ELSE w END AS w) FROM w5),
w7 AS (SELECT * REPLACE (regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w) FROM w6),
w8 AS (SELECT *, {_longest(english.SECOND)} s FROM w7),
w9 AS (SELECT * REPLACE ({_replaced(english.SECOND, 'p1', "CASE s WHEN 'ogi' THEN w LIKE '%logi' WHEN 'li' THEN regexp_matches(w, '[cdeghkmnrt]li$') ELSE true END")} AS w) FROM w8),
w10 AS (SELECT * REPLACE ({_longest(english.THIRD)} AS s) FROM w9),
w11 AS (SELECT * REPLACE ({_replaced(english.THIRD, 'p1', "s <> 'ative' OR length(w) - 5 >= p2")} AS w) FROM w10),
w12 AS (SELECT * REPLACE ({_longest(english.FOURTH)} AS s) FROM w11),
w13 AS (SELECT * REPLACE ({_replaced(english.FOURTH, 'p2', "s <> 'ion' OR regexp_matches(w, '[st]ion$')")} AS w) FROM w12),
w14 AS (SELECT * REPLACE (CASE WHEN w LIKE '%e' AND (length(w) > p2 OR (length(w) > p1 AND NOT regexp_matches(w, '{_SHORT}e$'))) THEN left(w, length(w) - 1) WHEN w LIKE '%ll' AND length(w) > p2 THEN left(w, length(w) - 1) ELSE w END AS w) FROM w13),
stems AS (SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE coalesce(CASE term {_WHOLE} END, kept, replace(w, 'Y', 'y')) END stem FROM w14),
qs AS (SELECT DISTINCT qid, stem FROM qt JOIN stems USING (term)),
n AS (SELECT qid, count(*) wanted FROM qs GROUP BY 1),
met AS (SELECT qid, doc_id FROM (SELECT DISTINCT doc_id, stem FROM dt JOIN stems USING (term)) JOIN qs USING (stem) JOIN n USING (qid) GROUP BY qid, doc_id, wanted HAVING count(*) = wanted)"""


@register(f"WITH {_STEMS} SELECT stem, count(*) AS words, min(term) AS first_word FROM stems WHERE term IN (SELECT term FROM dt) GROUP BY stem")
def english_stems(spark, sf_dir):
    return document_lexicon(spark, sf_dir).groupBy("stem").agg(F.count("*").alias("words"), F.min("term").alias("first_word"))


@register(f"WITH {_STEMS} SELECT qid, doc_id FROM met")
def english_matches(spark, sf_dir):
    return english.matches(C.document_index(spark, sf_dir), english.asked(sentences(spark, sf_dir), document_lexicon(spark, sf_dir)))


@register(f"""WITH {_STEMS}, e AS (SELECT qid, doc_id, pos, stem, row_number() OVER (PARTITION BY qid, doc_id ORDER BY pos) i FROM met JOIN qs USING (qid) JOIN (SELECT doc_id, pos, stem FROM dt JOIN stems USING (term)) USING (doc_id, stem)),
lasts AS (SELECT a.qid, a.doc_id, a.i j, b.stem, max(b.i) last FROM e a JOIN e b ON a.qid = b.qid AND a.doc_id = b.doc_id AND b.i <= a.i GROUP BY ALL),
firsts AS (SELECT qid, doc_id, j, min(last) i FROM lasts JOIN n USING (qid) GROUP BY qid, doc_id, j, wanted HAVING count(*) = wanted),
covers AS (SELECT qid, doc_id, i, min(j) j FROM firsts GROUP BY ALL),
scored AS (SELECT c.qid, c.doc_id, sum(0.1::DOUBLE / (1 + z.pos - a.pos - (c.j - c.i))) score FROM covers c JOIN e a ON a.qid = c.qid AND a.doc_id = c.doc_id AND a.i = c.i JOIN e z ON z.qid = c.qid AND z.doc_id = c.doc_id AND z.i = c.j GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id::VARCHAR) rank FROM scored)
SELECT qid, doc_id, round(score, 6) score, rank::INT AS rank FROM ranked WHERE rank <= 10""")
def english_topk(spark, sf_dir):
    scored = english.ranked(C.documents(spark, sf_dir), C.document_index(spark, sf_dir), document_lexicon(spark, sf_dir), sentences(spark, sf_dir))
    best = retrieval.top_k(scored.withColumn("score", F.round("score", 9)), 10, "doc_id")
    return best.select("qid", "doc_id", r6(F.col("score")).alias("score"), "rank")

"""English full text over a written index (P5, A5, O2): stop words, stems, all words of a query, rank by cover density.

Words of a text and of a query meet by their stems, by the published English algorithm of the Snowball project. The index keeps
the words themselves; a lexicon, one row a different word of the corpus, gives each its stem, so a word is stemmed once however
often it occurs. A query asks for the lists of all words that have one of its stems. Stop words are neither asked for nor
matched, but count as places between words.

The rank of a match is that of cover density: a cover is a shortest stretch of the text with all stems of the query; each gives a
tenth, divided by one more than the words in it that aren't the query's. No list of places is cut short. Words are runs of
letters, digits and underscores: unlike in a database's parser, addresses, paths and numbers with points aren't kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import text as X
from quillgrid.operators.index import Index, met_lists, small_words
from quillgrid.operators.retrieval import query_terms, small
from quillgrid.sources.tables import written

# The English stop words, and the tables of the stemming algorithm.
STOP = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if
or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can
will just don should now""".split()
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
AFTER_PLURAL = "inning outing canning herring earring proceed exceed succeed".split()
SECOND = {"ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = dict.fromkeys("ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split(), "")
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])"  # a short syllable at the end


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _left(n: int) -> Column:
    return F.expr(f"left(_w, length(_w) - {n})")


def _ending(rows: DataFrame, endings: dict[str, str], region: Column, but: dict[str, Column]) -> DataFrame:
    """The longest of the endings replaced, where it lies in the region and ``but`` holds for it; shorter ones aren't tried."""
    found = rows.withColumn("_s", F.regexp_extract("_w", f"({'|'.join(endings)})$", 0))
    start = F.length("_w") - F.length("_s")
    good = (F.col("_s") != "") & (start >= region)
    for ending, condition in but.items():
        good &= (F.col("_s") != ending) | condition
    return found.withColumn("_w", F.when(good, F.concat(F.expr("left(_w, length(_w) - length(_s))"), _table(endings)[F.col("_s")])).otherwise(F.col("_w")))


def stemmed(words: DataFrame, word: str = "term", stem: str = "stem") -> DataFrame:
    """``words`` with the English stem of each, lower-case, word. Words of one or two letters are their own stems; null stays null.

    The rows are written: a filter on the stem that the optimizer moved below the steps would copy each step into the next."""
    w, size, p1, p2 = F.col("_w"), F.length("_w"), F.col("_p1"), F.col("_p2")
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")  # a y that is a consonant
    at = words.withColumn("_w", marked).withColumn("_p1", F.length(F.regexp_extract("_w", "^(?:gener|commun|arsen)|^.*?[aeiouy][^aeiouy]", 0)))
    at = at.withColumn("_p1", F.when(p1 == 0, size).otherwise(p1)).withColumn("_p2", F.length(F.regexp_extract(F.expr("substr(_w, _p1 + 1)"), "^.*?[aeiouy][^aeiouy]", 0)))
    at = at.withColumn("_p2", F.when(p2 == 0, size).otherwise(p1 + p2))
    at = at.withColumn("_w", F.when(w.rlike("sses$"), _left(2)).when(w.rlike("ie[ds]$"), F.when(size > 4, _left(2)).otherwise(_left(1))).when(w.rlike("(us|ss)$"), w).when(w.rlike("[aeiouy].+s$"), _left(1)).otherwise(w))
    at = at.withColumn("_kept", F.when(w.isin(AFTER_PLURAL), w))
    eed = w.rlike("eed(ly)?$")
    at = at.withColumn("_cut", ~eed & w.rlike("[aeiouy].*(edly|ingly|ed|ing)$"))
    at = at.withColumn("_w", F.when(eed, F.when(F.length(F.regexp_replace("_w", "eed(ly)?$", "")) >= p1, F.regexp_replace("_w", "eed(ly)?$", "ee")).otherwise(w)).when(F.col("_cut"), F.regexp_replace("_w", "(edly|ingly|ed|ing)$", "")).otherwise(w))
    at = at.withColumn("_w", F.when(~F.col("_cut"), w).when(w.rlike("(at|bl|iz)$") | ((size <= p1) & w.rlike(f"{_SHORT}$")), F.concat(w, F.lit("e"))).when(w.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _left(1)).otherwise(w))
    at = at.withColumn("_w", F.regexp_replace("_w", "^(.+[^aeiouy])[yY]$", "$1i"))
    at = _ending(at, SECOND, p1, {"ogi": w.rlike("logi$"), "li": w.rlike("[cdeghkmnrt]li$")})
    at = _ending(at, THIRD, p1, {"ative": size - 5 >= p2})
    at = _ending(at, FOURTH, p2, {"ion": w.rlike("[st]ion$")})
    e = w.endswith("e") & ((size - 1 >= p2) | ((size - 1 >= p1) & ~w.rlike(f"{_SHORT}e$")))
    at = at.withColumn("_w", F.when(e | (w.endswith("ll") & (size - 1 >= p2)), _left(1)).otherwise(w))
    whole = F.col(word)
    made = F.when(F.length(whole) <= 2, whole).otherwise(F.coalesce(_table(WHOLE)[whole], F.col("_kept"), F.translate("_w", "Y", "y")))
    return written(at.withColumn(stem, made).drop("_w", "_p1", "_p2", "_kept", "_cut", "_s"), "stems")


def lexicon(index: Index) -> DataFrame:
    """(part, term, stem), written: each different word of the index but stop words."""
    terms = index.meta().select("part", "term").where(F.col("term").isNotNull() & ~F.col("term").isin(STOP)).distinct()
    return stemmed(terms)


def asked(queries: DataFrame, words: DataFrame) -> DataFrame:
    """(qid, at, wanted, part, term): the words of the lexicon that have the at-th of a query's ``wanted`` different stems.

    Stems that no text has keep a row without a word. A query of stop words alone asks for nothing and matches nothing."""
    stems = stemmed(query_terms(queries).where(~F.col("term").isin(STOP))).select("qid", "stem").distinct()
    own = Window.partitionBy("qid")
    numbered = stems.withColumns({"at": F.row_number().over(own.orderBy("stem")) - 1, "wanted": F.count("*").over(own)})
    return words.join(small(numbered), "stem", "right").select("qid", "at", "wanted", "part", "term")


def _all_met(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """(more, qid, key) where each stem of the query is met; rows: more, qid, key, at, wanted, repeats allowed."""
    each = rows.groupBy(*more, "qid", key, "at", "wanted").agg(F.lit(1)).groupBy(*more, "qid", key, "wanted").agg(F.count("*").alias("met"))
    return each.where("met = wanted").select(*more, "qid", key)


def matches(index: Index, wanted: DataFrame) -> DataFrame:
    """P5: (qid, key) of the texts with all stems of a query. Slices of texts that lack one are not read.

    Lists are dealt by slice before they meet the queries, so what is counted, of slices and of texts, stays in the task of the slice."""
    words = wanted.where("term is not null")
    slices = written(_all_met(met_lists(index, words, index.meta()).select("qid", "slice", "at", "wanted"), "slice"), "slices")
    lists = met_lists(index, words, index.rows.select("part", "term", "slice", F.col("entries.key").alias("_keys")), slices)
    return _all_met(lists.select("slice", "qid", "at", "wanted", F.explode("_keys").alias(index.key)), index.key, "slice").select("qid", index.key)


def cover_density(entries: Column, wanted: Column) -> Column:
    """The rank of a text: entries are the places in it of a query's words, (pos, at) by pos, ``at`` being one of 0 .. wanted - 1.

    The fold holds the last entry of each stem; where the earliest of these moves on, a shortest stretch ends."""

    def met(state: Column, entry: Column) -> Column:
        last = F.transform(state["last"], lambda x, j: F.when(j == entry["at"], state["i"]).otherwise(x))
        first = F.array_min(last)
        others = entry["pos"] - F.get(entries, first)["pos"] - (state["i"] - first)
        score = F.when(first > state["first"], 0.1 / (1 + others)).otherwise(0.0)
        return F.struct(last.alias("last"), first.alias("first"), (state["i"] + 1).alias("i"), (state["score"] + score).alias("score"))

    start = F.struct(F.array_repeat(F.lit(-1), wanted.cast("int")).alias("last"), F.lit(-1).alias("first"), F.lit(0).alias("i"), F.lit(0.0).alias("score"))
    return F.aggregate(entries, start, met, lambda state: state["score"])


def ranked(texts: DataFrame, index: Index, words: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """A5 in English: (qid, key, score) of all matches of ``queries`` (qid, query), by cover density; top_k takes the best.

    ``words`` is the lexicon of ``index``, which is of ``texts``. Texts that match are cut into words once, for all queries."""
    key = index.key
    wanted = written(asked(queries, words), "asked")
    met = written(matches(index, wanted), "matches")
    asking = wanted.where("term is not null").groupBy("term").agg(F.collect_list(F.struct("qid", "wanted", "at")).alias("_asking"))
    few = small_words(asking)
    # each text goes to one task with the queries that it matches; its words meet what asks for them there
    own = met.groupBy(key).agg(F.collect_set("qid").alias("_qids")).hint("merge")
    cut = texts.select(key, text).join(own.select(key).hint("merge"), key).select(key, F.posexplode(X.terms(F.col(text))).alias("pos", "term"))
    places = cut.join(few(asking.select("term")), "term", "left_semi").groupBy(key, "term").agg(F.collect_list("pos").alias("places"))
    asked_here = places.join(own, key).join(few(asking), "term").select(key, "places", F.explode(F.filter("_asking", lambda x: F.array_contains("_qids", x["qid"]))).alias("_a"))
    each = asked_here.select(F.col("_a.qid").alias("qid"), key, F.col("_a.wanted").alias("wanted"), F.col("_a.at").alias("at"), F.explode("places").alias("pos"))
    rows = each.groupBy("qid", key, "wanted").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("at").cast("int").alias("at")))).alias("entries"))
    return rows.select("qid", key, cover_density(F.col("entries"), F.col("wanted")).alias("score"))

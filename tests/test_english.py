import itertools
import re
import random

import pytest
from pyspark.sql import functions as F
from quillgrid.operators import english, index
from quillgrid.sources.tables import written

# Published examples of the algorithm: words and stems.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist
consolation consol consolatory consolatori consolidate consolid consolingly consol consols consol consonant conson conspicuously conspicu conspiracy
conspiraci conspirators conspir conspired conspir constables constabl constancy constanc knackeries knackeri knaves knave knavish knavish kneaded knead
knees knee kneel kneel knelt knelt knif knif knightly knight knitted knit knitting knit knives knive knockers knocker knopp knopp knots knot
skies sky dying die news news generate generat generously generous communism communism arsenal arsenal hoping hope hopping hop hoped hope feed feed agreed
agre ties tie cries cri gas gas this this gaps gap kiwis kiwi cry cri by by say say bled bled luxuriated luxuri sized size proceeds proceed inning inning
rational ration relational relat happily happili apology apolog sensibility sensibl hopefulness hope youth youth boyish boyish yell yell electrical electr
formative format adoption adopt falling fall rolled roll controlling control bee bee as as""".split()


def test_stems_of_published_words(spark):
    pairs = list(zip(SAMPLE[::2], SAMPLE[1::2], strict=True))
    rows = english.stemmed(spark.createDataFrame(pairs, "term string, wanted string")).collect()
    assert len(rows) == len(pairs)
    assert [(r.term, r.stem) for r in rows if r.stem != r.wanted] == []


def test_stems_of_odd_words(spark):
    wanted = ["", "y", None, "1980s", "ééées", "s" * 5000]
    rows = english.stemmed(spark.createDataFrame([(w,) for w in wanted], "term string")).collect()
    assert {r.term: r.stem for r in rows} == {w: w for w in wanted}


def covers(entries: list[tuple[int, int]], wanted: int) -> float:
    """All shortest stretches, by trying every one."""
    full = [(i, j) for i, j in itertools.combinations_with_replacement(range(len(entries)), 2) if len({t for _, t in entries[i : j + 1]}) == wanted]
    least = [(i, j) for i, j in full if not any((x, y) != (i, j) and i <= x and y <= j for x, y in full)]
    return sum(0.1 / (1 + entries[j][0] - entries[i][0] - (j - i)) for i, j in least)


def test_cover_density_is_that_of_all_shortest_stretches(spark):
    draw, cases = random.Random(4), []
    for _ in range(60):
        wanted = draw.randint(1, 4)
        places = sorted(draw.sample(range(60), draw.randint(0, 14)))
        cases.append(([(p, draw.randrange(wanted)) for p in places], wanted))
    rows = spark.createDataFrame(cases, "entries array<struct<pos int, at int>>, wanted int")
    scores = [r.score for r in rows.select(english.cover_density(F.col("entries"), F.col("wanted")).alias("score")).collect()]
    assert scores == pytest.approx([covers(*c) for c in cases])


def test_search_by_stems(spark):
    texts = [(1, "The hoping dogs were running."), (2, "A dog hopes; the dog, of all, runs"), (3, "dogs and cats"), (4, None), (5, ""), (6, "hope hoped dog")]
    docs = spark.createDataFrame(texts, "id long, text string").withColumn("slice", F.lit(0)).withColumn("stem", F.lit("x"))
    made = index.write_index(docs, "id", "text", slice_texts=2)
    words = english.lexicon(made)
    queries = spark.createDataFrame([(1, "Dogs of hope"), (2, "the"), (3, ""), (4, "dog unheard"), (5, "cat"), (6, None)], "qid long, query string")
    found = {(r.qid, r.id): round(r.score, 9) for r in english.ranked(docs, made, words, queries).collect()}
    # 2: hope after dog, dog two places after hope ("the" between); 6: hoped dog
    assert found == {(1, 1): 0.1, (1, 2): pytest.approx(0.1 + 0.05), (1, 6): 0.1, (5, 3): 0.1}
    empty = index.write_index(docs.limit(0), "id", "text")
    assert english.ranked(docs.limit(0), empty, english.lexicon(empty), queries).count() == 0


def test_rows_of_words_are_not_shuffled(spark):
    """Lists went through shuffles by word, by query and by text; now lists and matches stay in the task of their slice."""
    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("dogs"), F.concat(F.lit("w"), F.col("id") % 7), F.lit("cat")).alias("text"))
    made = index.write_index(docs, "id", "text", slice_texts=4)
    queries = spark.createDataFrame([(1, "dog cats"), (2, "w3 dog"), (3, "w3 w4")], "qid long, query string")
    found = english.matches(made, written(english.asked(queries, english.lexicon(made)), "asked"))
    assert {q: found.where(f"qid = {q}").count() for q in (1, 2, 3)} == {1: 300, 2: 43, 3: 0}
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any(d.startswith("slice#") for d in dealt) and not any(re.search(r"\b(qid|id)#|term#\d+, slice#", d) for d in dealt)  # words of queries may be grouped

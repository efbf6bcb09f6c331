"""Search by words against a loop over all texts, and measured facts of odd corpora."""

import math
import random
import re
from collections import Counter

from docloom.operators import measures, ranked


def loop(docs, queries, k):
    words = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in docs if t}
    words = {i: w for i, w in words.items() if w}
    mean = sum(map(len, words.values())) / max(1, len(words))
    df = Counter(t for w in words.values() for t in set(w))
    out = {}
    for q, text in queries:
        scores = {}
        for i, w in words.items():
            tf = Counter(w)
            hit = [math.floor(0.5 + 1e6 * math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * (tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)))) for t in set(re.findall("[a-z0-9]+", (text or "").lower())) if tf[t]]
            if hit:
                scores[i] = sum(hit)
        for place, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:k], 1):
            out[q, place] = (i, scores[i])
    return out


def found(spark, docs, queries, k):
    index = ranked.postings(spark.createDataFrame(docs, "id long, text string"))
    return {(r.query, r.place): (r.id, round(r.score * 1e6)) for r in ranked.first(index, spark.createDataFrame(queries, "query long, text string"), k).collect()}


def test_first_texts_equal_the_loop(spark):
    """Frequent and rare words, copies (ties), one very long text, and queries of one word, of all words and of none."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(2000, " ".join(r.choices(vocabulary, weights, k=50_000))), (2001, None), (2002, ""), (2003, "…!")]
    queries = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 12)))) for i in range(30)] + [(90, "w0"), (91, " ".join(vocabulary)), (92, None), (93, "nowhere"), (94, ""), (95, docs[3][1])]
    for k in (1, 10, 500):
        assert found(spark, docs, queries, k) == loop(docs, queries, k)


def test_no_texts_and_no_queries(spark):
    assert found(spark, [], [(1, "a")], 3) == {}
    assert found(spark, [(1, "a b")], [], 3) == {}
    assert found(spark, [(1, None)], [(1, "a")], 3) == {}


def test_runs_of_three_words(spark):
    d = spark.createDataFrame([("a b c d a b c",), ("one two",), ("",)], "text string")
    assert [r[0] for r in d.select(ranked.shingles(d["text"])).collect()] == [["a b c", "b c d", "c d a", "d a b"], ["one two"], [""]]


def test_facts_of_odd_corpora(spark, tmp_path):
    rows = [(1, "# Title\nsome text here", "en", "a"), (2, "| x | y |\nmore", "fr", "a"), (3, None, "fr", "a"), (4, "", None, None), (5, "one two three", "en", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.name: r for r in measures.measured(spark, str(tmp_path)).collect()}
    assert set(got) == {"source a", "source b", "source none", "lang en", "lang fr", "lang none"}
    a = got["source a"]
    assert (a.words, a.titles, a.multilingual, a.section_median, a.probed, a.relations) == (11, 0.5, True, 9, True, 0.0)
    assert a.table_share == round(9 / 36, 2) and got["source b"].homogeneity is None
    assert got["source none"].words == 0 and got["source none"].section_median is None
    assert got["lang en"].relations is None and not got["lang en"].probed

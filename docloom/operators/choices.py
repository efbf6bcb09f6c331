"""Decisions over measured facts: which architecture, which settings, which candidate, at what cost, and how well each is founded.

A corpus is a row of facts; each rule is a projection over any number of such rows: those measured on documents (measures.py), and
rows given in code that stand at the edges of the rules.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import plain, texts
from docloom.functions.tables import given
from docloom.operators import chunks, measures

FACTS = "name string, words long, avg_words double, degree double, connectivity double, relations double, crossed double, reuse double, homogeneity double, titles double, section_median long, table_share double, multilingual boolean, live boolean, probed boolean"


def _facts(spark, at, **needed):
    return given(spark, CORPORA, FACTS).unionAll(measures.measured(spark, at, **needed))


def saturating(x, at: float):
    """0.5 at the threshold, never 1."""
    v = F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
    return v / (v + at)


def amortisation(words):
    """S5."""
    return 0.4 + 0.6 * F.least(words / 100_000, F.lit(1.0))


def router(spark, at):
    """The score for a graph, its threshold, the choice, and whether it is tight."""
    f = _facts(spark, at)
    probe = 100 * (0.45 * saturating(F.col("relations"), 8) + 0.35 * saturating(F.col("crossed"), 0.25) + 0.20 * saturating(F.col("reuse"), 0.30)) * amortisation(F.col("words"))
    count = F.when(F.col("degree").isNull(), 0.0).otherwise(100 * (0.5 * saturating(F.col("degree"), 3) + 0.5 * saturating(F.col("connectivity"), 0.30)) * amortisation(F.col("words")))
    small = F.col("words") < 15_000
    score = F.when(small, 0).when(F.col("probed"), F.round(probe)).otherwise(F.round(count)).cast("int")
    limit = F.when(small, 50).when(F.col("probed"), F.when(F.col("live"), 80).otherwise(50)).otherwise(F.when(F.col("live"), 80).otherwise(75))
    source = F.when(small, "volume").when(F.col("probed"), "probe").otherwise("counts")
    tight = F.abs(score - limit) <= F.when(source == "counts", 15).otherwise(8)
    return f.select("name", source.alias("source"), score.alias("score"), limit.alias("threshold"), F.when(score >= limit, "KAG").otherwise("RAG").alias("choice"), F.greatest(F.lit(0), F.least(F.lit(100), 100 - score)).alias("rag_score"), tight.alias("tight"))


def chunking_plan(spark, at):
    """Candidates to measure; sections give the size where they are long enough, titles and tables say what else is worth trying."""
    f = _facts(spark, at, of_names=False, of_probe=False)
    base = F.when(F.col("section_median") >= 400, F.least(F.lit(2400), F.greatest(F.lit(600), F.col("section_median")))).otherwise(F.when(F.col("avg_words") < 400, 700).otherwise(1400)).cast("int")
    one = lambda name, kind, size: F.struct(F.lit(name).alias("candidate"), F.lit(kind).alias("strategy"), size.cast("int").alias("target"))
    second = F.when(F.col("titles") >= 0.5, one("structural", "structural", base)).otherwise(one("fixed short", "fixed", F.greatest(F.lit(400), F.floor(base / 2))))
    wide = F.when(F.col("table_share") >= 0.15, one("structural wide", "structural", F.floor(base * 1.6)))
    return f.select("name", F.posexplode(F.array_compact(F.array(one("fixed", "fixed", base), second, one("semantic", "semantic", base), wide))).alias("place", "c")).select("name", "place", "c.*")


def rag_profiles(spark, at):
    """Three profiles of each corpus."""
    f = _facts(spark, at, of_names=False, of_probe=False)
    chunk = F.when(F.col("avg_words") < 400, 300).otherwise(650)
    overlap = F.round(chunk * 0.15).cast("int")
    n = F.greatest(F.lit(1), F.floor(F.floor(F.col("words") * 1.3) / F.greatest(F.lit(1), chunk - overlap))).cast("long")
    multi = F.col("multilingual")
    p = lambda name, rerank, top, got, check: F.struct(F.lit(name).alias("profile"), rerank.alias("rerank"), F.lit(top).alias("top_k"), got.cast("int").alias("retrieve_k"), F.lit(check).alias("verify"))
    three = F.array(p("speed", F.lit(False), 3, F.lit(3), False), p("balanced", multi, 5, F.when(multi, 12).otherwise(5), False), p("quality", F.lit(True), 5, F.lit(18), True))
    return f.select("name", chunk.alias("chunk"), overlap.alias("overlap"), n.alias("chunks"), F.when(n > 50_000, "HNSW").otherwise("FLAT").alias("index_kind"), F.explode(three).alias("p")).select("name", "chunk", "overlap", "chunks", "index_kind", "p.*")


def kag_plan(spark, at):
    """How to build a graph: chunk, ontology, resolution of names, passes, communities."""
    f = _facts(spark, at)
    crossed = F.coalesce(F.when(F.col("probed"), F.col("crossed")), F.col("connectivity"), F.lit(0.0))
    strict, frozen, big = crossed >= 0.25, ~F.col("live"), F.col("words")
    communities = (big >= 100_000) & strict & frozen
    return f.select("name", F.when(F.col("avg_words") < 400, 300).otherwise(500).alias("chunk"), F.when(F.col("homogeneity") >= 0.60, "constrained").otherwise("open").alias("ontology"), F.when(strict, "strict").otherwise("basic").alias("resolution"),
                    F.when(frozen & (big > 100_000), 2).otherwise(1).alias("passes"), communities.alias("communities"), F.when(communities, "local+global").otherwise("local").alias("query_modes"))


def costs(spark, at):
    """Seconds to build and to answer, of an index with reranking and checking, and of a graph in two passes with communities."""
    f = _facts(spark, at, of_names=False).withColumn("tokens", F.floor(F.col("words") * 1.3))
    t = F.col("tokens")
    index = t / 20_000 + t / (8_000 / F.when(F.col("multilingual"), 2.0).otherwise(1.0))
    ask = F.lit(0.05) + 2.0 + F.when(F.col("multilingual"), 0.03 * 12).otherwise(0.0)
    extract = (t / 1_500 + t * 0.5 / 12) * F.when(~F.col("live") & (F.col("words") > 100_000), 1.8).otherwise(1.0)
    graph = (t / 20_000 + extract + t / 8_000) * F.when(~F.col("live") & (F.col("words") >= 100_000) & (F.coalesce("crossed", F.lit(0.0)) >= 0.25), 1.6).otherwise(1.0)
    return f.select("name", F.round(index, 2).alias("index_s"), texts.duration(index).alias("index_took"), F.round(ask, 3).alias("ask_s"), F.round(graph, 2).alias("graph_s"), texts.duration(graph).alias("graph_took"), F.lit(2.4).alias("graph_ask_s"))


def candidate_winner(spark, at):
    """Notes from the measures at hand, weights shared out anew; of those within 0.03 of the best the simplest, then the
    fastest; candidates that failed are kept as not measured. Corpora are those below, and all documents as three strategies cut
    them, where a thousand chunks count as a second."""
    m = chunks.candidate_report(spark, at).select(F.lit("documents"), F.col("strategy"), F.col("strategy"), "size_score", "end_score", "begin_score", "cohesion", F.lit(None).cast("double"), F.col("chunks") / 1000, F.lit(None).cast("string"))
    c = given(spark, CANDIDATES, "corpus string, candidate string, strategy string, size double, ends double, begins double, cohesion double, coherence double, seconds double, error string").unionAll(m)
    weights = {"size": 0.15, "ends": 0.25, "begins": 0.25, "cohesion": 0.20, "coherence": 0.15}
    total = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    note = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0)) / F.when(total > 0, total)
    c = c.withColumn("note", F.when(F.col("error").isNull(), F.round(note, 3)))
    simple = F.when(F.col("strategy") == "fixed", 0).when(F.col("strategy") == "structural", 1).otherwise(2)
    best = F.max("note").over(Window.partitionBy("corpus"))
    near = F.coalesce(F.round(best - F.col("note"), 6) <= 0.03, F.lit(False))
    order = Window.partitionBy("corpus").orderBy(near.desc(), simple, "seconds", "candidate")
    return c.withColumn("near", near).withColumn("wins", (F.row_number().over(order) == 1) & F.col("near")).select("corpus", "candidate", "note", "near", "wins", F.when(F.col("note").isNull(), "not measured").otherwise("measured").alias("state"))


def tie_choice(spark, at):
    """Trials stand from simple to complex; the two best closer than 0.03 leave the simpler one."""
    t = given(spark, TRIALS, "setting string, place int, trial string, note double")
    w = Window.partitionBy("setting")
    ranked = t.withColumn("r", F.row_number().over(w.orderBy(F.desc("note"), "place"))).where("r <= 2")
    g = ranked.groupBy("setting").agg(F.max(F.when(F.col("r") == 1, F.struct("note", "place", "trial"))).alias("a"), F.max(F.when(F.col("r") == 2, F.struct("note", "place", "trial"))).alias("b"))
    tie = F.coalesce(F.round(F.col("a.note") - F.col("b.note"), 9) < 0.03, F.lit(False))
    return g.select("setting", F.when(tie & (F.col("b.place") < F.col("a.place")), F.col("b.trial")).otherwise(F.col("a.trial")).alias("chosen"), tie.alias("tie"))


def evidence_summary(spark, at):
    """Settings by how well they are founded; diagnostics say why a measure is missing and are no settings."""
    e = given(spark, EVIDENCE, "name string, value string, level string")
    n = e.where("level <> 'diagnostic'").groupBy("level").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    total = e.where("level <> 'diagnostic'").agg(F.count("*").alias("total"))
    phrase = F.when(F.col("level") == "measured", "measured on this corpus").when(F.col("level") == "constrained", "imposed by another choice").when(F.col("level") == "consequence", "follows from a measure").otherwise("set by rule, not measured")
    return n.join(F.broadcast(total)).select("level", "n", "total", F.round(F.col("n") / F.col("total"), 2).alias("share"), "names", phrase.alias("phrase"))


def machine_settings(spark, at):
    """A measure replaces the setting of its name; readable names become the keys that indexing reads, and private keys go."""
    e = given(spark, EVIDENCE, "name string, value string, level string").where("level <> 'diagnostic'")
    m = given(spark, MEASURES, "name string, value string")
    both = e.select("name", F.col("value").alias("set_value")).join(m, "name", "full").select("name", F.coalesce("value", "set_value").alias("value"), F.col("value").isNotNull().alias("measured"))
    key = F.coalesce(*(F.when(F.col("name") == n, F.lit(k)) for n, k in KEYS), F.col("name"))
    return both.select(key.alias("key"), "value", "measured").where(~F.col("key").startswith("_private"))


def ontology(spark, at):
    """The commonest predicates, fifteen at most, make a closed list if there are ten and more of them."""
    p = given(spark, PREDICATES, "corpus string, predicate string, n long").unionAll(measures.corpus_predicates(spark, at))
    r = p.where(F.trim("predicate") != "").withColumn("k", F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("n"), "predicate"))).where("k <= 15")
    return r.groupBy("corpus").agg(F.count("*").alias("n"), (F.count("*") >= 10).alias("closed"), F.when(F.count("*") >= 10, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "predicate"))), lambda x: x["predicate"]), ",")).alias("allowed"))


def marginal_signals(spark, at):
    """Signals within 20 % of their thresholds, whether the corpus fits a context window, and how tightly."""
    f = _facts(spark, at, of_names=False).where("probed")
    near = lambda c, at: F.when(F.abs(F.col(c) - at) <= 0.2 * at, F.lit(c))
    tokens = F.floor(F.col("words") * 1.3)
    budget = int(32_768 * 0.65)
    return f.select("name", F.array_join(F.array_compact(F.array(near("relations", 8.0), near("crossed", 0.25), near("reuse", 0.30))), ",").alias("marginal"), (tokens <= budget).alias("fits"), ((tokens <= budget) & (tokens > budget * 0.70)).alias("tightly"))


CORPORA = [
    ("tiny", 9_000, 250.0, 2.0, 0.4, 9.0, 0.3, 0.4, 0.7, 0.6, 900, 0.1, False, False, True), ("edge", 15_000, 500.0, 3.0, 0.30, 8.0, 0.25, 0.30, 0.60, 0.5, 399, 0.15, True, False, True), ("rich", 150_000, 900.0, 6.0, 0.6, 20.0, 0.6, 0.7, 0.8, 0.9, 3000, 0.3, True, False, True),
    ("live", 150_000, 900.0, 6.0, 0.6, 20.0, 0.6, 0.7, 0.5, 0.2, 400, 0.0, False, True, True), ("counted", 120_000, 399.0, 5.0, 0.5, None, None, None, 0.3, 0.0, None, None, False, False, False), ("blind", 50_000, 401.0, None, None, None, None, None, None, 0.49, 2400, 0.149, True, True, False),
    ("small context", 15_100, 300.0, 1.0, 0.1, 6.4, 0.2, 0.36, 0.61, 1.0, 601, 0.2, False, False, True), ("huge", 60_000_000, 2000.0, 9.0, 0.9, 7.0, 0.9, 0.1, 0.65, 0.5, 1200, 0.16, True, False, True),
]
CANDIDATES = [
    ("a", "fixed", "fixed", 0.8, 0.9, 0.95, 0.5, 0.6, 1.0, None), ("a", "structural", "structural", 0.82, 0.93, 0.97, 0.52, 0.62, 2.0, None), ("a", "semantic", "semantic", None, None, None, None, None, 9.0, "no model"), ("b", "fixed", "fixed", 0.5, 0.5, 0.5, None, None, 1.0, None),
    ("b", "semantic", "semantic", 0.9, 0.9, 0.9, 0.8, None, 20.0, None), ("b", "fixed short", "fixed", 0.9, 0.88, 0.87, 0.9, None, 3.0, None), ("b", "fixed long", "fixed", 0.9, 0.88, 0.87, 0.9, None, 2.0, None), ("c", "fixed", "fixed", None, None, None, None, None, 1.0, "unreadable"),
]
TRIALS = [("k", 0, "1", 0.655), ("k", 1, "3", 0.69), ("k", 2, "5", 0.862), ("k", 3, "10", 0.931), ("k", 4, "20", 0.931), ("model", 0, "small", 0.80), ("model", 1, "large", 0.83), ("rerank", 0, "none", 0.80), ("rerank", 1, "cross", 0.829), ("one", 0, "only", 0.1)]
EVIDENCE = [
    ("architecture", "RAG", "rule"), ("chunk_strategy", "structural", "measured"), ("chunk_chars", "1200", "measured"), ("top_k", "5", "rule"), ("retrieve_k", "10", "consequence"), ("embedding_type", "multilingual", "rule"), ("embedding_dim", "1024", "constrained"), ("index_type", "FLAT", "rule"), ("no_reranker", "not here", "diagnostic"), ("_private_note", "x", "rule"),
]
MEASURES = [("top_k", "10"), ("retrieve_k", "20"), ("reranker", "none")]
KEYS = [("embedding_type", "_embedding_type"), ("index_type", "_index_type"), ("chunk_strategy", "_chunk_strategy"), ("chunk_chars", "_chunk_chars"), ("distance", "_metric_type")]
PREDICATES = [("wide", f"p{i:02d}", 20 - i // 2) for i in range(18)] + [("narrow", f"q{i}", 5) for i in range(9)] + [("narrow", " ", 50)]

_F = f"(SELECT * FROM {plain.values(CORPORA, FACTS)} v UNION ALL SELECT * FROM {measures.MEASURED} m)"
_SAT = "greatest(coalesce({0}, 0), 0) / (greatest(coalesce({0}, 0), 0) + {1})".format
_AMORT = "(0.4 + 0.6 * least(words / 100000, 1))"
_SCORE = f"cast(CASE WHEN words < 15000 THEN 0 WHEN probed THEN round(100 * (0.45 * {_SAT('relations', '8.0')} + 0.35 * {_SAT('crossed', '0.25::double')} + 0.20 * {_SAT('reuse', '0.30::double')}) * {_AMORT}) WHEN degree IS NULL THEN 0 ELSE round(100 * (0.5 * {_SAT('degree', '3.0')} + 0.5 * {_SAT('connectivity', '0.30::double')}) * {_AMORT}) END AS int)"
_LIMIT = "CASE WHEN words < 15000 THEN 50 WHEN live THEN 80 WHEN probed THEN 50 ELSE 75 END"
_BASE = "cast(CASE WHEN section_median >= 400 THEN least(2400, greatest(600, section_median)) WHEN avg_words < 400 THEN 700 ELSE 1400 END AS int)"
_CAND = f"""(SELECT * FROM {plain.values(CANDIDATES, 'corpus string, candidate string, strategy string, size double, ends double, begins double, cohesion double, coherence double, seconds double, error string')} v
    UNION ALL SELECT 'documents', strategy, strategy, size_score, end_score, begin_score, cohesion, NULL, chunks / 1000, NULL FROM {chunks.CANDIDATE_REPORT} m)"""
_W = {"size": 0.15, "ends": 0.25, "begins": 0.25, "cohesion": 0.20, "coherence": 0.15}
_NOTE = "CASE WHEN error IS NULL THEN round((" + " + ".join(f"coalesce({k}, 0) * {w}::double" for k, w in _W.items()) + ") / nullif(" + " + ".join(f"CASE WHEN {k} IS NULL THEN 0.0::double ELSE {w}::double END" for k, w in _W.items()) + ", 0), 3) END"
_NEAR = f"(SELECT *, coalesce(round(max(note) OVER (PARTITION BY corpus) - note, 6) <= 0.03, false) AS near FROM (SELECT *, {_NOTE} AS note FROM {_CAND} c) n)"
_E = plain.values(EVIDENCE, "name string, value string, level string")
_TOKENS = "floor(words * 1.3)"
_INDEX = f"({_TOKENS} / 20000 + {_TOKENS} / CASE WHEN multilingual THEN 4000 ELSE 8000 END)"
_GRAPH = f"(({_TOKENS} / 20000 + ({_TOKENS} / 1500 + {_TOKENS} * 0.5 / 12) * CASE WHEN NOT live AND words > 100000 THEN 1.8 ELSE 1 END + {_TOKENS} / 8000) * CASE WHEN NOT live AND words >= 100000 AND coalesce(crossed, 0) >= 0.25 THEN 1.6 ELSE 1 END)"
_TOOK = "CASE WHEN {0} < 1 THEN cast(round({0} * 1000) AS int) || ' ms' WHEN {0} < 60 THEN cast(round({0}) AS int) || ' s' WHEN {0} < 3600 THEN cast(round({0} / 60) AS int) || ' min' ELSE format('{{:,.1f}}', cast({0} / 3600 AS double)) || ' h' END".format
_CROSSED = "coalesce(CASE WHEN probed THEN crossed END, connectivity, 0)"
QUERIES = {f.__name__: f for f in (router, chunking_plan, rag_profiles, kag_plan, costs, candidate_winner, tie_choice, evidence_summary, machine_settings, ontology, marginal_signals)}
ORACLES = {
    "router": f"SELECT name, CASE WHEN words < 15000 THEN 'volume' WHEN probed THEN 'probe' ELSE 'counts' END AS source, score, threshold, CASE WHEN score >= threshold THEN 'KAG' ELSE 'RAG' END AS choice, 100 - score AS rag_score, abs(score - threshold) <= CASE WHEN words >= 15000 AND NOT probed THEN 15 ELSE 8 END AS tight FROM (SELECT *, {_SCORE} AS score, {_LIMIT} AS threshold FROM {_F} f) s",
    "chunking_plan": f"""SELECT name, cast(row_number() OVER (PARTITION BY name ORDER BY o) - 1 AS int) AS place, candidate, strategy, target FROM (SELECT name, 1 AS o, 'fixed' AS candidate, 'fixed' AS strategy, {_BASE} AS target FROM {_F} f UNION ALL SELECT name, 2, 'structural', 'structural', {_BASE} FROM {_F} f WHERE titles >= 0.5
        UNION ALL SELECT name, 2, 'fixed short', 'fixed', greatest(400, {_BASE} // 2) FROM {_F} f WHERE titles < 0.5 UNION ALL SELECT name, 3, 'semantic', 'semantic', {_BASE} FROM {_F} f UNION ALL SELECT name, 4, 'structural wide', 'structural', cast(floor({_BASE} * 1.6) AS int) FROM {_F} f WHERE table_share >= 0.15) c""",
    "rag_profiles": f"""SELECT name, chunk, overlap, chunks, CASE WHEN chunks > 50000 THEN 'HNSW' ELSE 'FLAT' END AS index_kind, profile, rerank, top_k, retrieve_k, verify FROM (SELECT name, chunk, cast(round(chunk * 0.15) AS int) AS overlap, greatest(1, cast(floor({_TOKENS} / (chunk - cast(round(chunk * 0.15) AS int))) AS bigint)) AS chunks, multilingual FROM (SELECT *, CASE WHEN avg_words < 400 THEN 300 ELSE 650 END AS chunk FROM {_F} f) g) h,
        LATERAL (SELECT 'speed' AS profile, false AS rerank, 3 AS top_k, 3 AS retrieve_k, false AS verify UNION ALL SELECT 'balanced', multilingual, 5, CASE WHEN multilingual THEN 12 ELSE 5 END, false UNION ALL SELECT 'quality', true, 5, 18, true) p""",
    "kag_plan": f"SELECT name, chunk, ontology, resolution, passes, communities, CASE WHEN communities THEN 'local+global' ELSE 'local' END AS query_modes FROM (SELECT name, CASE WHEN avg_words < 400 THEN 300 ELSE 500 END AS chunk, CASE WHEN homogeneity >= 0.60 THEN 'constrained' ELSE 'open' END AS ontology, CASE WHEN {_CROSSED} >= 0.25 THEN 'strict' ELSE 'basic' END AS resolution, CASE WHEN NOT live AND words > 100000 THEN 2 ELSE 1 END AS passes, words >= 100000 AND {_CROSSED} >= 0.25 AND NOT live AS communities FROM {_F} f) g",
    "costs": f"SELECT name, round({_INDEX}, 2) AS index_s, {_TOOK(_INDEX)} AS index_took, round(cast(2.05 + CASE WHEN multilingual THEN 0.36 ELSE 0 END AS double), 3) AS ask_s, round({_GRAPH}, 2) AS graph_s, {_TOOK(_GRAPH)} AS graph_took, cast(2.4 AS double) AS graph_ask_s FROM {_F} f",
    "candidate_winner": f"SELECT corpus, candidate, note, near, near AND row_number() OVER (PARTITION BY corpus ORDER BY CASE WHEN near THEN 0 ELSE 1 END, CASE strategy WHEN 'fixed' THEN 0 WHEN 'structural' THEN 1 ELSE 2 END, seconds, candidate) = 1 AS wins, CASE WHEN note IS NULL THEN 'not measured' ELSE 'measured' END AS state FROM {_NEAR} n",
    "tie_choice": f"SELECT a.setting, CASE WHEN round(a.note - b.note, 9) < 0.03 AND b.place < a.place THEN b.trial ELSE a.trial END AS chosen, coalesce(round(a.note - b.note, 9) < 0.03, false) AS tie FROM (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY note DESC, place) AS r FROM {plain.values(TRIALS, 'setting string, place int, trial string, note double')} t) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY note DESC, place) AS r FROM {plain.values(TRIALS, 'setting string, place int, trial string, note double')} t) b ON a.setting = b.setting AND b.r = 2 WHERE a.r = 1",
    "evidence_summary": f"SELECT level, count(*) AS n, cast(sum(count(*)) OVER () AS bigint) AS total, round(count(*) / sum(count(*)) OVER (), 2) AS share, string_agg(name, ', ' ORDER BY name) AS names, CASE level WHEN 'measured' THEN 'measured on this corpus' WHEN 'constrained' THEN 'imposed by another choice' WHEN 'consequence' THEN 'follows from a measure' ELSE 'set by rule, not measured' END AS phrase FROM {_E} e WHERE level <> 'diagnostic' GROUP BY level",
    "machine_settings": f"SELECT coalesce(k.key, name) AS key, value, measured FROM (SELECT coalesce(e.name, m.name) AS name, coalesce(m.value, e.value) AS value, m.value IS NOT NULL AS measured FROM (SELECT * FROM {_E} e WHERE level <> 'diagnostic') e FULL JOIN {plain.values(MEASURES, 'name string, value string')} m ON m.name = e.name) b LEFT JOIN {plain.values(KEYS, 'n string, key string')} k ON k.n = b.name WHERE NOT starts_with(coalesce(k.key, name), '_private')",
    "ontology": f"SELECT corpus, count(*) AS n, count(*) >= 10 AS closed, CASE WHEN count(*) >= 10 THEN string_agg(predicate, ',' ORDER BY k) END AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, predicate) AS k FROM (SELECT * FROM {plain.values(PREDICATES, 'corpus string, predicate string, n long')} v UNION ALL SELECT * FROM {measures.PREDICATES} m) p WHERE trim(predicate) <> '') r WHERE k <= 15 GROUP BY corpus",
    "marginal_signals": f"SELECT name, concat_ws(',', CASE WHEN abs(relations - 8.0) <= 0.2 * 8.0::double THEN 'relations' END, CASE WHEN abs(crossed - 0.25::double) <= 0.2::double * 0.25::double THEN 'crossed' END, CASE WHEN abs(reuse - 0.30::double) <= 0.2::double * 0.30::double THEN 'reuse' END) AS marginal, {_TOKENS} <= 21299 AS fits, {_TOKENS} <= 21299 AND {_TOKENS} > 21299 * 0.70 AS tightly FROM {_F} f WHERE probed",
}

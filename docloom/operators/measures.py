"""Facts measured on a corpus, a row for each: what the decisions of choices.py are taken on.

The documents of one source are a corpus that was probed for relations; those of one language a corpus of which only names were
counted. Documents without a source or language are in the corpus "none". Paragraphs (lines with text) stand for sections; a line
that starts with # is a title, one that starts with | a row of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import plain, texts
from docloom.functions.tables import spread, written
from docloom.operators import facts

PASSAGE = 1500


def _texts(spark, at, by: str) -> DataFrame:
    d = spark.read.parquet(f"{at}/documents.parquet").where("text is not null")
    return spread(d.select("doc_id", F.coalesce(by, F.lit("none")).alias("corpus"), "lang", "text"))


def upper_median(column: str) -> Column:
    """Element n // 2 of n values in order, from counts of each value, which merge; no list of values is built."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)").cast("long")


def structure(d: DataFrame) -> DataFrame:
    """Volume, languages, titles, section lengths, tables, homogeneity (null for one document)."""
    lines, text = F.split("text", "\n"), F.col("text")
    rows = F.aggregate(F.transform(F.filter(lines, lambda x: x.startswith("|")), F.length), F.lit(0), lambda a, x: a + x)
    tables = F.when(text.startswith("|") | text.contains("\n|"), rows).otherwise(0)
    m = d.select("corpus", F.regexp_count("text", F.lit(r"\S+")).alias("words"), F.length("text").alias("chars"), (text.startswith("#") | text.contains("\n#")).cast("double").alias("titled"), tables.alias("tables"))
    g = m.groupBy("corpus").agg(F.count("*").alias("docs"), F.sum("words").alias("words"), F.avg("words").alias("avg_words"), F.stddev_pop("words").alias("dev"), F.round(F.avg("titled"), 2).alias("titles"),
                                F.round(F.coalesce(F.try_divide(F.sum("tables"), F.sum("chars")), F.lit(0.0)), 2).alias("table_share"), F.avg((F.col("tables") > 0).cast("double")).alias("with_tables"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("corpus"))
    langs = d.where("lang is not null").groupBy("corpus", "lang").agg(F.count("*").alias("n")).withColumn("share", share)
    langs = langs.groupBy("corpus").agg(F.max("share").alias("top"), (F.count_if(F.round("share", 2) >= 0.15) >= 2).alias("multilingual"))
    sections = d.select("corpus", F.explode(lines).alias("line")).where("trim(line) <> ''").select("corpus", F.length("line").alias("n"))
    sections = sections.groupBy("corpus").agg(upper_median("n").alias("section_median"))
    even = 1 - F.least(F.when(F.col("avg_words") > 0, F.col("dev") / F.col("avg_words")).otherwise(0.0), F.lit(1.0))
    alike = F.when(F.col("docs") > 1, F.round((F.col("top") + even + 2 * F.abs(F.col("with_tables") - 0.5)) / 3, 2))
    return g.join(langs, "corpus", "left").join(sections, "corpus", "left").select("corpus", "words", F.round("avg_words", 4).alias("avg_words"), alike.alias("homogeneity"), "titles", "section_median", "table_share", F.coalesce("multilingual", F.lit(False)).alias("multilingual"))


def mentions(spark, at) -> DataFrame:
    """(source, lang, doc_id, k, n, canon): the names of each passage of 1500 characters with their mentions, a row for each spelling,
    written once for all corpora."""
    d = spread(spark.read.parquet(f"{at}/documents.parquet").where("length(text) > 0").select("doc_id", *(F.coalesce(c, F.lit("none")).alias(c) for c in ("source", "lang")), "text"))
    p = d.select("doc_id", "source", "lang", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0))).alias("k", "text"))
    p = p.select("source", "lang", "doc_id", "k", F.explode(F.regexp_extract_all("text", F.lit(facts.MENTION), F.lit(0))).alias("name"))
    m = p.groupBy("source", "lang", "doc_id", "k", "name").agg(F.count("*").alias("n")).withColumn("canon", texts.canonical_mention(F.col("name")))
    return written(m.drop("name"), "mentions").where("canon is not null")  # a filter before would find each form twice


def names(m: DataFrame, by: str) -> DataFrame:
    """Of the names of two mentions and more the share in two documents and more, and how many others each stands beside
    in a passage. A passage holds a bounded number of names, so pairs are few for each; they are pairs of the names' numbers."""
    m = m.withColumnRenamed(by, "corpus")
    kept = m.groupBy("corpus", "canon", "doc_id").agg(F.sum("n").alias("n")).groupBy("corpus", "canon").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs")).where("n >= 2")
    kept = written(kept.withColumn("id", F.monotonically_increasing_id()), "names")
    met = m.where("doc_id is not null").join(kept.select("corpus", "canon", "id"), ["corpus", "canon"]).groupBy("corpus", "doc_id", "k").agg(F.collect_set("id").alias("ids"))
    pairs = met.select("ids", F.explode("ids").alias("id")).select("id", F.explode("ids").alias("other")).where("id < other").distinct().groupBy("id").agg(F.count("*").alias("pairs"))
    pairs = kept.select("corpus", "id").join(pairs, "id").groupBy("corpus").agg(F.sum("pairs").alias("pairs"))
    g = kept.groupBy("corpus").agg(F.count("*").alias("names"), F.avg((F.col("docs") >= 2).cast("double")).alias("connectivity"))
    return g.join(pairs, "corpus", "left").select("corpus", F.round(2 * F.coalesce("pairs", F.lit(0)) / F.col("names"), 4).alias("degree"), F.round("connectivity", 4).alias("connectivity"))


def kept_relations(d: DataFrame) -> DataFrame:
    """(corpus, doc, s, p, o) of the relations of documents that pass the checks."""
    return facts.checked(facts.relations(d.select("doc_id", "text"))).where("reason = 'kept'").join(d.select(F.col("doc_id").alias("doc"), "corpus"), "doc")


def probe(d: DataFrame) -> DataFrame:
    """Relations kept, the share of relations whose predicate stands twice and more, and of names in relations of two documents."""
    r = kept_relations(d)
    p = r.groupBy("corpus", "p").agg(F.count("*").alias("n")).groupBy("corpus").agg(F.sum("n").alias("kept"), F.round(F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("reuse"))
    n = r.select("corpus", "doc", F.explode(F.array("s", "o")).alias("name")).distinct().groupBy("corpus", "name").agg(F.count("*").alias("docs"))
    n = n.groupBy("corpus").agg(F.round(F.avg((F.col("docs") >= 2).cast("double")), 4).alias("crossed"))
    return p.join(n, "corpus")


def measured(spark, at, of_names: bool = True, of_probe: bool = True) -> DataFrame:
    """The facts of every corpus of documents; a corpus with no relation kept has a probe of zeros. Facts of names and of the probe
    are null where the caller does not ask for them, and are not computed."""
    none = lambda c: F.lit(None).cast("double").alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    relations = F.round(1000 * F.coalesce("kept", F.lit(0)) / F.greatest(F.floor(F.col("words") * 1.3), F.lit(1)), 4).alias("relations")

    m = mentions(spark, at) if of_names else None

    def one(by: str, probed: bool) -> DataFrame:
        d = _texts(spark, at, by)
        f = structure(d)
        f = f.join(names(m, by), "corpus", "left") if of_names else f.withColumns({c: none(c) for c in ("degree", "connectivity")})
        told = [relations, zero("crossed"), zero("reuse")] if probed and of_probe else [none(c) for c in ("relations", "crossed", "reuse")]
        f = f.join(probe(d), "corpus", "left") if probed and of_probe else f
        return f.select(F.concat(F.lit(f"{by} "), "corpus").alias("name"), "words", "avg_words", "degree", "connectivity", *told, "homogeneity", "titles", "section_median", "table_share", "multilingual", F.lit(False).alias("live"), F.lit(probed).alias("probed"))

    return one("source", True).unionAll(one("lang", False))


def measured_facts(spark, at):
    """A1 to A9, A19 by corpus: the row of facts that the router and the plans read."""
    return measured(spark, at)


def corpus_predicates(spark, at) -> DataFrame:
    """(corpus, predicate, n) of the relations kept of each source."""
    return kept_relations(_texts(spark, at, "source")).groupBy(F.concat(F.lit("source "), "corpus").alias("corpus"), F.col("p").alias("predicate")).agg(F.count("*").alias("n"))


def _sql(by: str) -> tuple[str, str, str]:
    d = f"(SELECT doc_id, coalesce({by}, 'none') AS corpus, lang, text FROM documents WHERE text IS NOT NULL)"
    lines = "string_split(text, chr(10))"
    structure_ = f"""(SELECT g.corpus, words, round(avg_words, 4) AS avg_words, CASE WHEN docs > 1 THEN round((top + 1 - least(CASE WHEN avg_words > 0 THEN dev / avg_words ELSE 0 END, 1) + 2 * abs(with_tables - 0.5)) / 3, 2) END AS homogeneity, titles, section_median, table_share, coalesce(multilingual, false) AS multilingual
        FROM (SELECT corpus, count(*) AS docs, cast(sum(len({plain.words('text')})) AS bigint) AS words, avg(len({plain.words('text')})) AS avg_words, stddev_pop(len({plain.words('text')})) AS dev, round(avg(CASE WHEN regexp_matches(text, '(^|\\n)#') THEN 1.0 ELSE 0.0 END), 2) AS titles,
        round(sum(coalesce(list_sum(list_transform(list_filter({lines}, lambda x: starts_with(x, '|')), lambda x: length(x))), 0)) / greatest(sum(length(text)), 1), 2) AS table_share, avg(CASE WHEN len(list_filter({lines}, lambda x: starts_with(x, '|') AND length(x) > 0)) > 0 THEN 1.0 ELSE 0.0 END) AS with_tables FROM {d} d GROUP BY corpus) g
        LEFT JOIN (SELECT corpus, max(share) AS top, count(*) FILTER (WHERE round(share, 2) >= 0.15::double) >= 2 AS multilingual FROM (SELECT corpus, lang, count(*) / sum(count(*)) OVER (PARTITION BY corpus) AS share FROM {d} d WHERE lang IS NOT NULL GROUP BY corpus, lang) l GROUP BY corpus) l ON l.corpus = g.corpus
        LEFT JOIN (SELECT corpus, list_sort(list(n))[count(*) // 2 + 1] AS section_median FROM (SELECT corpus, length(line) AS n FROM (SELECT corpus, unnest({lines}) AS line FROM {d} d) x WHERE trim(line) <> '') y GROUP BY corpus) s ON s.corpus = g.corpus)"""
    passages = f"(SELECT corpus, doc_id, k, substring(text, {PASSAGE} * k + 1, {PASSAGE}) AS piece FROM (SELECT *, unnest(range((length(text) - 1) // {PASSAGE} + 1)) AS k FROM {d} d WHERE length(text) > 0) q)"
    mentions = f"(SELECT * FROM (SELECT corpus, doc_id, k, {plain.canonical('name')} AS canon FROM (SELECT corpus, doc_id, k, unnest(regexp_extract_all(piece, '{facts.MENTION}')) AS name FROM {passages} p) m) c WHERE canon IS NOT NULL)"
    names_ = f"""(WITH m AS MATERIALIZED {mentions}, kept AS MATERIALIZED (SELECT corpus, canon, count(DISTINCT doc_id) AS docs FROM m GROUP BY ALL HAVING count(*) >= 2), met AS MATERIALIZED (SELECT DISTINCT m.corpus, doc_id, k, m.canon FROM m JOIN kept ON kept.corpus = m.corpus AND kept.canon = m.canon),
        pairs AS (SELECT corpus, count(*) AS pairs FROM (SELECT DISTINCT a.corpus, a.canon AS x, b.canon AS y FROM met a JOIN met b ON a.corpus = b.corpus AND a.doc_id = b.doc_id AND a.k = b.k AND a.canon < b.canon) z GROUP BY corpus)
        SELECT g.corpus, round(2 * coalesce(pairs, 0) / names, 4) AS degree, round(connectivity, 4) AS connectivity FROM (SELECT corpus, count(*) AS names, avg(CASE WHEN docs >= 2 THEN 1.0 ELSE 0.0 END) AS connectivity FROM kept GROUP BY corpus) g LEFT JOIN pairs ON pairs.corpus = g.corpus)"""
    kept = f"(SELECT d.corpus, doc, s, p, o FROM {facts.FOUND_CHECKED} c JOIN {d} d ON d.doc_id = c.doc WHERE reason = 'kept')"
    return structure_, names_, kept


def _measured_sql() -> str:
    s, n, kept = _sql("source")
    probe_ = f"""(WITH r AS MATERIALIZED {kept} SELECT a.corpus, kept, reuse, crossed FROM (SELECT corpus, sum(n) AS kept, round(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / sum(n), 4) AS reuse FROM (SELECT corpus, p, count(*) AS n FROM r GROUP BY ALL) x GROUP BY corpus) a
        JOIN (SELECT corpus, round(avg(CASE WHEN docs >= 2 THEN 1.0 ELSE 0.0 END), 4) AS crossed FROM (SELECT corpus, name, count(DISTINCT doc) AS docs FROM (SELECT corpus, doc, unnest([s, o]) AS name FROM r) y GROUP BY corpus, name) z GROUP BY corpus) b ON a.corpus = b.corpus)"""
    l, m, _ = _sql("lang")
    cols = "homogeneity, titles, section_median, table_share, multilingual, false AS live"
    return f"""(SELECT 'source ' || s.corpus AS name, words, avg_words, degree, connectivity, round(1000 * coalesce(kept, 0) / greatest(floor(words * 1.3), 1), 4) AS relations, coalesce(crossed, 0) AS crossed, coalesce(reuse, 0) AS reuse, {cols}, true AS probed FROM {s} s LEFT JOIN {n} n ON n.corpus = s.corpus LEFT JOIN {probe_} p ON p.corpus = s.corpus
        UNION ALL SELECT 'lang ' || l.corpus, words, avg_words, degree, connectivity, cast(NULL AS double), cast(NULL AS double), cast(NULL AS double), {cols}, false FROM {l} l LEFT JOIN {m} n ON n.corpus = l.corpus)"""


MEASURED = _measured_sql()
PREDICATES = f"(SELECT 'source ' || corpus AS corpus, p AS predicate, count(*) AS n FROM {_sql('source')[2]} k GROUP BY ALL)"
QUERIES = {"measured_facts": measured_facts}
ORACLES = {"measured_facts": f"SELECT * FROM {MEASURED} m"}

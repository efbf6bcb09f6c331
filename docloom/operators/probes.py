"""Where a probe reads, and structure metrics of a corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import plain, texts
from docloom.functions.tables import given
from docloom.operators.numbering import numbered

BUDGET, EACH, SIZE, SHARES = 20, 2, 2000, (0.20, 0.55, 0.80, 0.35, 0.70)


def probe_pieces(spark, at):
    """SA2: pieces at fixed shares of documents spread evenly over the usable ones, in rounds; pieces that begin alike count once."""
    d = spark.read.parquet(f"{at}/documents.parquet").where(F.length(F.trim("text")) > 200).select("doc_id", "text")
    placed = numbered(d.select("doc_id"), "doc_id")
    n = placed.agg(F.count("*").alias("n"))
    docs = max(1, BUDGET // EACH)
    spread = F.when(F.col("n") > docs, F.transform(F.sequence(F.lit(0), F.lit(docs - 1)), lambda k: F.floor(k * F.col("n") / docs).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    chosen = placed.join(F.broadcast(n.select(F.explode(spread).alias("place"))), "place").join(d, "doc_id")
    rounds = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(s).alias("share")) for r, s in enumerate(SHARES[:EACH]))))
    p = chosen.select("place", "doc_id", "text", rounds.alias("x"))
    start = F.greatest(F.lit(0), F.least(F.floor(F.length("text") * F.col("x.share")).cast("int"), F.greatest(F.lit(0), F.length("text") - SIZE)))
    p = p.select("place", "doc_id", F.col("x.r").alias("r"), F.trim(F.col("text").substr(start + 1, F.lit(SIZE))).alias("piece")).where(F.length("piece") > 200)
    first = F.row_number().over(Window.partitionBy(F.substring("piece", 1, 200)).orderBy("r", "place"))
    return p.withColumn("seen", first).where("seen = 1").orderBy("r", "place").limit(BUDGET).select("doc_id", "r", F.sha1("piece").alias("piece_sha"))


def json_texts(spark, at):
    """SC3: the text of JSON files: a string, the first text field of an object, or those of a list, a line each."""
    v = given(spark, FILES, "name string, raw string").withColumn("v", F.try_parse_json("raw"))
    field = lambda x, f: f"CASE WHEN schema_of_variant(try_variant_get({x}, '$.{f}', 'variant')) = 'STRING' THEN try_variant_get({x}, '$.{f}', 'string') END"
    one = lambda x: "coalesce(" + ", ".join(field(x, f) for f in ("text", "content", "full_text", "body")) + ")"
    text = f"""CASE WHEN schema_of_variant(v) = 'STRING' THEN try_variant_get(v, '$', 'string') WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN array_join(array_compact(transform(try_variant_get(v, '$', 'array<variant>'), i -> CASE WHEN schema_of_variant(i) = 'STRING' THEN try_variant_get(i, '$', 'string') ELSE {one('i')} END)), '\\n') ELSE {one('v')} END"""
    return v.select("name", F.coalesce(F.expr(text), F.lit("")).alias("text"))


def structure_metrics(spark, at):
    """Titles, the upper median of section lengths, empty pages by page, tables by character, homogeneity (null for one
    document) with its weakest part, and documents of images only."""
    d = given(spark, PROFILES, "corpus string, doc string, lang string, words long, pages long, empty_share double, chars long, table_share double, tables long, titled boolean, section_median long")
    part = F.count("*").over(Window.partitionBy("corpus", "lang")).cast("double")
    d = d.withColumn("lang_n", F.when(F.col("lang").isNotNull(), part))
    med = F.array_sort(F.collect_list(F.when(F.col("section_median") > 0, F.col("section_median"))))
    g = d.groupBy("corpus").agg(F.count("*").alias("docs"), F.round(F.avg(F.col("titled").cast("double")), 2).alias("titles"), med.alias("m"), F.round(F.sum(F.col("empty_share") * F.col("pages")) / F.sum("pages"), 2).alias("empty_pages"), F.round(F.sum(F.col("table_share") * F.col("chars")) / F.sum("chars"), 2).alias("table_share"),
                                (F.max("lang_n") / F.count("lang")).alias("l"), (1 - F.least(F.coalesce(F.stddev_pop("words") / F.avg("words"), F.lit(0.0)), F.lit(1.0))).alias("s"), (2 * F.abs(F.avg((F.col("tables") > 0).cast("double")) - 0.5)).alias("t"),
                                F.array_join(F.array_sort(F.collect_list(F.when((F.col("pages") >= 3) & (F.col("words") / F.col("pages") < 60), F.col("doc")))), ",").alias("image_only"))
    weakest = F.when((F.col("l") <= F.col("s")) & (F.col("l") <= F.col("t")), "language").when(F.col("s") <= F.col("t"), "length").otherwise("tables")
    many = F.col("docs") > 1
    return g.select("corpus", "docs", "titles", F.get("m", F.floor(F.size("m") / 2).cast("int")).alias("section_median"), "empty_pages", "table_share", F.when(many, F.round((F.col("l") + F.col("s") + F.col("t")) / 3, 2)).alias("homogeneity"), F.when(many, weakest).alias("weakest"), "image_only")


def relational_share(spark, at):
    """A4: labels of mentions, and the share of those that relate (persons, bodies, places)."""
    m = given(spark, LABELS, "label string, n long")
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    related = F.sum(F.when(F.col("label").isin("PER", "PERSON", "ORG", "LOC", "GPE"), F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    return m.select("label", "n", F.round(F.col("n") / total, 4).alias("share"), F.round(related / total, 2).alias("relational"))


FILES = [("a.json", '"only a string"'), ("b.json", '{"content": "two", "body": "three"}'), ("c.json", '[{"text": "x"}, {"body": "y"}, 3, "z", {"other": 1}]'), ("d.json", "{bad"), ("e.json", '{"text": 5, "body": "b"}'), ("f.json", "[]"), ("g.json", "17")]
PROFILES = [
    ("one", "a", "fr", 900, 10, 0.1, 6000, 0.2, 1, True, 800), ("two", "a", "fr", 900, 10, 0.1, 6000, 0.2, 1, True, 800), ("two", "b", "en", 300, 3, 0.0, 2000, 0.0, 0, False, None), ("two", "c", "fr", 40, 4, 0.75, 300, 0.5, 2, False, 1200), ("two", "d", None, 60, 1, None, 400, None, 0, True, 0), ("same", "a", "de", 100, 1, 0.0, 600, 0.0, 0, False, None), ("same", "b", "de", 100, 1, 0.0, 600, 0.0, 0, False, None),
]
LABELS = [("PER", 10), ("ORG", 7), ("MISC", 5), ("GPE", 2), ("DATE", 1)]

_D = "(SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents WHERE length(trim(text)) > 200)"
_PIECE = f"(SELECT doc_id, place, r, trim(substring(text, greatest(0, least(cast(floor(length(text) * share) AS int), greatest(0, length(text) - {SIZE}))) + 1, {SIZE})) AS piece FROM {_D} d, (VALUES (0, 0.20::double), (1, 0.55::double)) AS s(r, share) WHERE n <= {BUDGET // EACH} OR place IN (SELECT cast(floor(k * n / {BUDGET // EACH}) AS bigint) FROM range({BUDGET // EACH}) AS x(k)))"
_ONE = "CASE WHEN json_type({0}, '$.text') = 'VARCHAR' THEN {0} ->> '$.text' WHEN json_type({0}, '$.content') = 'VARCHAR' THEN {0} ->> '$.content' WHEN json_type({0}, '$.full_text') = 'VARCHAR' THEN {0} ->> '$.full_text' WHEN json_type({0}, '$.body') = 'VARCHAR' THEN {0} ->> '$.body' END".format
_P = plain.values(PROFILES, "corpus string, doc string, lang string, words long, pages long, empty_share double, chars long, table_share double, tables long, titled boolean, section_median long")
QUERIES = {f.__name__: f for f in (probe_pieces, json_texts, structure_metrics, relational_share)}
ORACLES = {
    "probe_pieces": f"SELECT doc_id, r, sha1(piece) AS piece_sha FROM (SELECT *, row_number() OVER (PARTITION BY substring(piece, 1, 200) ORDER BY r, place) AS seen FROM {_PIECE} p WHERE length(piece) > 200) q WHERE seen = 1 ORDER BY r, place LIMIT {BUDGET}",
    "json_texts": f"SELECT name, coalesce(CASE json_type(j) WHEN 'VARCHAR' THEN j ->> '$' WHEN 'ARRAY' THEN coalesce(array_to_string(list_filter(list_transform(from_json(j, '[\"json\"]'), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' WHEN json_type(x) = 'OBJECT' THEN {_ONE('x')} END), lambda x: x IS NOT NULL), chr(10)), '') WHEN 'OBJECT' THEN {_ONE('j')} END, '') AS text FROM (SELECT name, try_cast(raw AS json) AS j FROM {plain.values(FILES, 'name string, raw string')} f) g",
    "structure_metrics": f"""SELECT corpus, docs, titles, m[len(m) // 2 + 1] AS section_median, empty_pages, table_share, CASE WHEN docs > 1 THEN round((l + s + t) / 3, 2) END AS homogeneity, CASE WHEN docs > 1 THEN CASE WHEN l <= s AND l <= t THEN 'language' WHEN s <= t THEN 'length' ELSE 'tables' END END AS weakest, image_only FROM (
        SELECT p.corpus, count(*) AS docs, round(avg(CASE WHEN titled THEN 1.0 ELSE 0.0 END), 2) AS titles, list_sort(list(section_median) FILTER (WHERE section_median > 0)) AS m, round(sum(empty_share * pages) / sum(pages), 2) AS empty_pages, round(sum(table_share * chars) / sum(chars), 2) AS table_share, max(k) / count(p.lang) AS l,
        1 - least(coalesce(stddev_pop(words) / avg(words), 0), 1) AS s, 2 * abs(avg(CASE WHEN tables > 0 THEN 1.0 ELSE 0.0 END) - 0.5) AS t, coalesce(string_agg(CASE WHEN pages >= 3 AND words / pages < 60 THEN doc END, ',' ORDER BY doc), '') AS image_only FROM {_P} p LEFT JOIN (SELECT corpus, lang, count(*) AS k FROM {_P} q WHERE lang IS NOT NULL GROUP BY corpus, lang) c ON c.corpus = p.corpus AND c.lang = p.lang GROUP BY p.corpus) g""",
    "relational_share": f"SELECT label, n, round(n / sum(n) OVER (), 4) AS share, round(sum(CASE WHEN label IN ('PER', 'PERSON', 'ORG', 'LOC', 'GPE') THEN n ELSE 0 END) OVER () / sum(n) OVER (), 2) AS relational FROM {plain.values(LABELS, 'label string, n long')} m",
}

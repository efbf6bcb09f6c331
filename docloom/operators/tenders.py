"""From words on pages to sections and their children: lines, body size, titles, noise, tables, parents.

Words carry their place, size and weight as a page reader gives them; a document may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import plain, texts
from docloom.functions.tables import given

WORDS_KIND = "doc string, page int, top double, bottom double, x0 double, x1 double, size double, bold boolean, text string"
TABLES_KIND = "doc string, page int, x0 double, y0 double, x1 double, y1 double, row int, cells array<string>"
#: Lines that are no text: blanks, contents, page numbers, versions; names of the issuing house are a parameter.
NOISE = [r"^\s*$", r"\.{4,}\s*\d+\s*$", r"(?i)^classification\s*:", r"^\d+\s+of\s+\d+$", r"(?i)^version\s+\d"]
NUMBERED = r"^(\d{1,2}\.\d{1,2}(?:\.\d{1,2})?)\s+([A-Za-z].{2,80})$"
BUDGET, CARRY = 12, 3


def _words(spark) -> DataFrame:
    return given(spark, WORDS, WORDS_KIND)


def _tables(spark) -> DataFrame:
    return given(spark, TABLES, TABLES_KIND)


def lines(words: DataFrame) -> DataFrame:
    """SC5: words of nearly one height, from left to right, with the greatest size and whether all are bold."""
    g = words.groupBy("doc", "page", F.bround(F.col("top") / 3).alias("bucket"))
    g = g.agg(F.array_sort(F.collect_list(F.struct("x0", "text", "top"))).alias("ws"), F.max("size").alias("size"), F.bool_and("bold").alias("bold"))
    return g.select("doc", "page", "bucket", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("line"), "size", "bold", F.get("ws", F.lit(0))["top"].alias("top"))


def outside(words: DataFrame, tables: DataFrame) -> DataFrame:
    """SC10, J12: words that stand in no table, two points of slack allowed."""
    b = F.broadcast(tables.select("doc", "page", F.col("x0").alias("bx0"), "y0", F.col("x1").alias("bx1"), "y1").distinct())
    inside = (words["doc"] == b["doc"]) & (words["page"] == b["page"]) & (words["x0"] >= b["bx0"] - 2) & (words["x1"] <= b["bx1"] + 2) & (words["top"] >= b["y0"] - 2) & (words["bottom"] <= b["y1"] + 2)
    return words.join(b, inside, "left_anti")


def table_texts(tables: DataFrame) -> DataFrame:
    """SC9: cells of a row apart by bars, rows without any text dropped, line ends as spaces."""
    cells = F.transform("cells", lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")))
    r = tables.withColumn("cells", cells).where(F.exists("cells", lambda c: c != ""))
    return r.groupBy("doc", "page", F.col("y0").alias("top")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.array_join("cells", " | ").alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def word_lines(spark, at):
    return lines(_words(spark)).select("doc", "page", "line", "size", "bold")


def body_size(spark, at):
    """SC6: the half-point size that most characters have, the least of equals."""
    n = lines(_words(spark)).groupBy("doc", (F.bround(F.col("size") * 2) / 2).alias("s")).agg(F.sum(F.length("line")).alias("n"))
    return n.groupBy("doc").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))


def page_blocks(spark, at):
    """SC7: titles (larger by an eighth, short, without a final point) open sections; tables of more than 40 characters are blocks."""
    body = F.broadcast(body_size(spark, at))
    t = lines(_words(spark)).join(body, "doc").withColumn("title", (F.col("size") >= F.col("body") * 1.12) & (F.length("line") <= 120) & ~F.col("line").endswith("."))
    tables = table_texts(_tables(spark)).where(F.length("text") > 40).select("doc", "page", F.lit(1).alias("kind"), "top", F.col("text").alias("line"), F.lit(False).alias("title"))
    every = t.select("doc", "page", F.lit(0).alias("kind"), F.col("bucket").alias("top"), "line", "title").unionAll(tables)
    w = Window.partitionBy("doc").orderBy("page", "kind", "top")
    every = every.withColumn("part", F.sum(F.col("title").cast("int")).over(w)).withColumn("section", F.last(F.when(F.col("title"), F.col("line")), True).over(w)).withColumn("k", F.row_number().over(w))
    every = every.withColumn("cut", F.sum(F.when((F.col("kind") == 1) | F.col("title"), 1).otherwise(F.when(F.lag("kind", 1, 0).over(w) == 1, 1).otherwise(0))).over(w))
    g = every.where("not title").groupBy("doc", "cut", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"), F.first("section").alias("section"))
    return g.where("text <> ''").select("doc", "cut", (F.col("kind") == 1).alias("is_table"), F.coalesce("section", F.lit("")).alias("section"), "text")


def _read(spark) -> DataFrame:
    """SC10, F8, F9: lines outside tables without noise, and tables, in reading order, with the number and name of titles."""
    noise = F.lit(False)
    for p in NOISE:
        noise = noise | F.trim("line").rlike(p)
    t = lines(outside(_words(spark), _tables(spark))).where(~noise).withColumn("line", F.trim("line"))
    number = F.nullif(F.regexp_extract("line", NUMBERED, 1), F.lit(""))
    bare = F.col("bold") & F.length("line").between(3, 45) & F.col("line").rlike(r"^\p{Lu}") & ~F.col("line").rlike(r"[.:,;)]$|\d") & (F.size(texts.words(F.col("line"))) <= 6) & ~F.lower("line").isin("yes", "no", "note", "abstract")
    name = F.when(number.isNotNull(), F.trim(F.regexp_extract("line", NUMBERED, 2))).when(bare, F.col("line"))
    t = t.select("doc", "page", "top", F.lit(False).alias("is_table"), "line", number.alias("number"), name.alias("name"))
    return t.unionAll(table_texts(_tables(spark)).select("doc", "page", "top", F.lit(True), F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string")))


def tender_titles(spark, at):
    """F9."""
    return _read(spark).where("name is not null").select("doc", "page", F.coalesce("number", F.lit("")).alias("number"), "name")


def _parents(spark) -> DataFrame:
    """A numbered title opens a parent, a bold one a parent under the last number; empty parents go."""
    w = Window.partitionBy("doc").orderBy("page", "top", "is_table")
    r = _read(spark).withColumn("k", F.row_number().over(w)).withColumn("part", F.sum(F.col("name").isNotNull().cast("int")).over(w))
    r = r.withColumn("section", F.coalesce(F.last("number", True).over(w), F.lit("0"))).withColumn("title", F.coalesce(F.last("name", True).over(w), F.lit("Preambule")))
    some = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("k", "line")))), lambda x: x["line"])
    g = r.where("name is null").groupBy("doc", "part", "section", "title").agg(F.min("page").alias("page"), F.trim(F.regexp_replace(F.array_join(some(~F.col("is_table")), " "), r"\s{2,}", " ")).alias("text"), some(F.col("is_table")).alias("tables"))
    return g.withColumn("parent", F.row_number().over(Window.partitionBy("doc").orderBy("part")) - 1)


def tender_parents(spark, at):
    return _parents(spark).select("doc", "parent", "section", "title", "text", F.size("tables").alias("tables"), (F.length("text") + F.aggregate("tables", F.lit(0), lambda a, t: a + F.length(t))).alias("n_chars"))


def budgeted(text, budget: int, carry: int):
    """Parts between . : ; up to a budget of words; the last words of a piece begin the next."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.:;])\s+"), F.trim), lambda p: p != "")
    n = lambda c: F.size(texts.words(c))

    def step(a, p):
        cur = F.element_at(a, -1)
        w = texts.words(cur)
        tail = F.array_join(F.slice(w, F.greatest(F.size(w) - carry + 1, F.lit(1)), F.lit(carry)), " ")
        over = n(cur) + n(p) > budget
        return F.when(F.size(a) == 0, F.array(p)).when(over, F.concat(a, F.array(F.concat(tail, F.lit(" "), p)))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(cur, F.lit(" "), p))))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def tender_children(spark, at):
    """Children under their section's name; a table is one child."""
    p = _parents(spark).withColumn("head", F.concat(F.lit("["), "section", F.lit(" "), "title", F.lit("] ")))
    kids = F.concat(F.transform(budgeted(F.col("text"), BUDGET, CARRY), lambda c: F.struct(c.alias("t"), F.lit(False).alias("is_table"))), F.transform("tables", lambda c: F.struct(c.alias("t"), F.lit(True).alias("is_table"))))
    c = p.select("doc", "parent", "head", F.posexplode(kids).alias("k", "x"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("parent", "k")) - 1
    return c.select("doc", "parent", F.format_string("E%04d", place).alias("child"), "x.is_table", F.concat("head", "x.t").alias("text"))


def _line(doc, page, top, text, size=10.0, bold=False, x=50.0):
    return [(doc, page, top + 0.2 * (i % 2), top + size, x + 40 * i, x + 40 * i + 35, size, bold, w) for i, w in enumerate(text.split(" "))]


WORDS = [w for row in [
    _line("t", 1, 30.0, "Classification : internal"), _line("t", 1, 60.0, "An opening line before any title; it says: nothing more."), _line("t", 1, 90.0, "1.0 About the buyer", 14.0, True), _line("t", 1, 120.0, "The buyer runs a network in two countries. It serves many users: homes, firms; and more."),
    _line("t", 1, 150.0, "Standard Provisions", 10.0, True), _line("t", 1, 180.0, "Offers stay open for ninety days. Prices are in euros."), _line("t", 1, 210.0, "1.1 Empty part ........ 7"), _line("t", 1, 240.0, "1.2 Required staff", 14.0, True), _line("t", 1, 300.0, "Five certified engineers work on site, and one leads them; all speak the language of the buyer and hold a licence."),
    _line("t", 1, 342.0, "Level Hours"), _line("t", 1, 360.0, "High 4"), _line("t", 1, 780.0, "1 of 2"), _line("t", 2, 30.0, "Version 3"), _line("t", 2, 60.0, "Yes", 10.0, True), _line("t", 2, 90.0, "2.1 Nothing under it", 14.0, True), _line("t", 2, 120.0, "2.1.1 Support", 12.0, True), _line("t", 2, 150.0, "Answers come within four hours. Repairs take a day at most: parts are kept near; spare units too."),
    _line("u", 1, 50.0, "Only text here, no title at all."), _line("u", 1, 80.0, "And a second line of it"),
] for w in row]
TABLES = [("t", 1, 45.0, 340.0, 400.0, 375.0, 0, ["Level", "Hours to\nanswer", None]), ("t", 1, 45.0, 340.0, 400.0, 375.0, 1, ["High", "4", "days included"]), ("t", 1, 45.0, 340.0, 400.0, 375.0, 2, ["", None, " "]), ("t", 2, 45.0, 400.0, 400.0, 430.0, 0, ["a", "b"])]

_W, _T = plain.values(WORDS, WORDS_KIND), plain.values(TABLES, TABLES_KIND)
_LINES = "(SELECT doc, page, round_even(top / 3, 0) AS bucket, string_agg(text, ' ' ORDER BY x0, text) AS line, max(size) AS size, bool_and(bold) AS bold, arg_min(top, x0) AS top FROM {0} w GROUP BY doc, page, round_even(top / 3, 0))"
_OUT = f"(SELECT w.* FROM {_W} w WHERE NOT EXISTS (SELECT 1 FROM {_T} b WHERE b.doc = w.doc AND b.page = w.page AND w.x0 >= b.x0 - 2 AND w.x1 <= b.x1 + 2 AND w.top >= b.y0 - 2 AND w.bottom <= b.y1 + 2))"
_CELLS = "list_transform(cells, lambda c: trim(replace(coalesce(c, ''), chr(10), ' ')))"
_TEXTS = f"(SELECT doc, page, y0 AS top, string_agg(array_to_string({_CELLS}, ' | '), chr(10) ORDER BY row) AS text FROM {_T} t WHERE len(list_filter({_CELLS}, lambda c: c <> '')) > 0 GROUP BY doc, page, y0)"
_BODY = f"(SELECT doc, arg_max(s, n * 1000 - s) AS body FROM (SELECT doc, round_even(size * 2, 0) / 2 AS s, sum(length(line)) AS n FROM {_LINES.format(_W)} l GROUP BY ALL) g GROUP BY doc)"
_NOISY = "regexp_matches(trim(line), '^[ \\t]*$|\\.\\.\\.\\.+[ \\t]*[0-9]+[ \\t]*$|(?i)^classification[ \\t]*:|^[0-9]+ +of +[0-9]+$|(?i)^version +[0-9]')"
_NUM = "'^([0-9]{1,2}[.][0-9]{1,2}(?:[.][0-9]{1,2})?)[ \\t]+([A-Za-z].{2,80})$'"
_READ = f"""(SELECT doc, page, top, false AS is_table, line, number, CASE WHEN number IS NOT NULL THEN trim(regexp_extract(line, {_NUM}, 2)) WHEN bold AND length(line) BETWEEN 3 AND 45 AND regexp_matches(line, '^\\p{{Lu}}') AND NOT regexp_matches(line, '[.:,;)]$|[0-9]') AND len(string_split(line, ' ')) <= 6 AND lower(line) NOT IN ('yes', 'no', 'note', 'abstract') THEN line END AS name
    FROM (SELECT *, nullif(regexp_extract(line, {_NUM}, 1), '') AS number FROM (SELECT doc, page, top, bold, trim(line) AS line FROM {_LINES.format(_OUT)} l WHERE NOT {_NOISY}) a) b UNION ALL SELECT doc, page, top, true, text, NULL, NULL FROM {_TEXTS} x)"""
_PARTS = f"""(SELECT doc, part, section, title, min(page) AS page, trim(regexp_replace(coalesce(string_agg(CASE WHEN NOT is_table THEN line END, ' ' ORDER BY k), ''), '[ \\t\\n]{{2,}}', ' ', 'g')) AS text, list_filter(list(CASE WHEN is_table THEN line END ORDER BY k), lambda x: x IS NOT NULL) AS tables, row_number() OVER (PARTITION BY doc ORDER BY part) - 1 AS parent
    FROM (SELECT *, coalesce(last_value(number IGNORE NULLS) OVER w, '0') AS section, coalesce(last_value(name IGNORE NULLS) OVER w, 'Preambule') AS title, sum(CASE WHEN name IS NOT NULL THEN 1 ELSE 0 END) OVER w AS part, row_number() OVER w AS k FROM {_READ} r WINDOW w AS (PARTITION BY doc ORDER BY page, top, is_table)) q WHERE name IS NULL GROUP BY doc, part, section, title)"""
_KIDS = f"""list_reduce(list_transform(list_filter(list_transform(string_split(regexp_replace(text, '([.:;])[ \\t\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> ''), lambda p: [p]), lambda a, p: CASE WHEN len(a) = 0 THEN p WHEN len(string_split(a[-1], ' ')) + len(string_split(p[1], ' ')) > {BUDGET}
    THEN list_concat(a, [array_to_string(string_split(a[-1], ' ')[greatest(len(string_split(a[-1], ' ')) - {CARRY - 1}, 1):], ' ') || ' ' || p[1]]) ELSE list_concat(a[1:len(a) - 1], [a[-1] || ' ' || p[1]]) END, cast([] AS varchar[]))"""
_BLOCKS = f"""(SELECT doc, page, 0 AS kind, bucket AS top, line, size >= body * 1.12 AND length(line) <= 120 AND NOT ends_with(line, '.') AS title FROM {_LINES.format(_W)} l JOIN {_BODY} b USING (doc) UNION ALL SELECT doc, page, 1, top, text, false FROM {_TEXTS} t WHERE length(text) > 40)"""
QUERIES = {f.__name__: f for f in (word_lines, body_size, page_blocks, tender_titles, tender_parents, tender_children)}
ORACLES = {
    "word_lines": f"SELECT doc, page, line, size, bold FROM {_LINES.format(_W)} l",
    "body_size": f"SELECT * FROM {_BODY} b",
    "page_blocks": f"""SELECT doc, cast(cut AS bigint) AS cut, kind = 1 AS is_table, coalesce(any_value(section), '') AS section, string_agg(line, chr(10) ORDER BY k) AS text FROM (SELECT *, sum(CASE WHEN kind = 1 OR title OR before = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY k) AS cut FROM (SELECT *, row_number() OVER w AS k, coalesce(lag(kind) OVER w, 0) AS before,
        last_value(CASE WHEN title THEN line END IGNORE NULLS) OVER w AS section FROM {_BLOCKS} x WINDOW w AS (PARTITION BY doc ORDER BY page, kind, top)) y) z WHERE NOT title GROUP BY doc, cut, kind""",
    "tender_titles": f"SELECT doc, page, coalesce(number, '') AS number, name FROM {_READ} r WHERE name IS NOT NULL",
    "tender_parents": f"SELECT doc, cast(parent AS int) AS parent, section, title, text, cast(len(tables) AS int) AS tables, cast(length(text) + coalesce(list_sum(list_transform(tables, lambda t: length(t))), 0) AS int) AS n_chars FROM {_PARTS} p",
    "tender_children": f"SELECT doc, cast(parent AS int) AS parent, printf('E%04d', row_number() OVER (PARTITION BY doc ORDER BY parent, is_table, i) - 1) AS child, is_table, '[' || section || ' ' || title || '] ' || t AS text FROM (SELECT doc, parent, section, title, false AS is_table, i, ({_KIDS})[i] AS t FROM (SELECT *, unnest(range(1, len({_KIDS}) + 1)) AS i FROM {_PARTS} p) a UNION ALL SELECT doc, parent, section, title, true, i, tables[i] FROM (SELECT *, unnest(range(1, len(tables) + 1)) AS i FROM {_PARTS} p) b) c",
}

"""Sentences, chunks and index pieces: one pass over each text, no shuffle.

Spark deals the texts and hands them on in batches of Arrow; the loops over one text are in functions/cuts.py.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from docloom.functions import cuts, plain, texts
from docloom.functions.cuts import ABBREVIATIONS
from docloom.functions.tables import given, spread, written
from docloom.operators.numbering import numbered

TARGET, OVERLAP, LEAST, FACTOR, PER_TOKEN = 1200, 150, 200, 1.6, 4.6
#: Words that a chunk should not begin with.
DANGLING = "ce cet cette ces celui celle ceux celles il elle ils elles leur leurs lui y en dont lequel laquelle lesquels ci-dessus ci-dessous ledit ladite this that these those it they them their its such said above below".split()


def applied(f, kind: str, c: Column) -> Column:
    """f of each value of c that is not null, in batches of Arrow."""
    arrow = to_arrow_type(_parse_datatype_string(kind))
    return F.arrow_udf(lambda a: pa.array([None if x is None else f(x) for x in a.to_pylist()], arrow), kind)(c)


_CHUNK = "array<struct<body:string,n:int>>"


def sentences(text: Column) -> Column:
    """Cut after . ! ? … and white space; a part joins the one before it after an abbreviation, an initial, or a short start."""
    return applied(cuts.sentences, "array<string>", text)


def _cut(t: str, overlap: int = -1) -> list[tuple[str, int]]:
    s = cuts.sentences(t)
    return cuts.chunked(s, cuts.merged(cuts.packed([*map(len, s)], TARGET), LEAST), overlap)


def fixed(text: Column) -> Column:
    """The chunks of a text."""
    return applied(lambda t: _cut(t, OVERLAP), _CHUNK, text)


def structural(text: Column) -> Column:
    """Chunks never cross a section, and are counted in each; a text without two titles is cut as a fixed one."""

    def cut(t):
        every = cuts.sections(t)
        titled = sum(title is not None for title, _ in every) >= 2
        return [(b, k, title or "" if titled else "", *g) for b, (title, body) in enumerate(every) if body for k, g in enumerate(_cut(body, -1 if titled else OVERLAP))]

    return applied(cut, "array<struct<block:int,chunk:int,title:string,body:string,n:int>>", text)


def semantic(text: Column) -> Column:
    """C1, C3, C6 with bags of words for an embedder: the chunks of a text."""

    def cut(t):
        s = cuts.sentences(t)
        return cuts.chunked(s, cuts.merged(cuts.semantic(s, TARGET, FACTOR), LEAST))

    return applied(cut, _CHUNK, text)


def sections(text: Column) -> Column:
    """SC8: (title, body) of Markdown; a line that starts with # opens a section."""
    return applied(cuts.sections, "array<struct<title:string,body:string>>", text)


def split_pieces(text: Column, size: int, overlap: int) -> Column:
    """Windows of at most `size` characters that end after the last paragraph, line, sentence or word break of their final
    quarter; the next begins `overlap` before that end."""
    return applied(lambda t: cuts.pieces(t, size, overlap), "array<string>", text)


def records(doc: Column, section: Column, g: Column) -> list[Column]:
    """Text under a header that names document and section, the body, and counts."""
    text = F.concat(doc, F.when(section != "", F.concat(F.lit(" > "), section)).otherwise(F.lit("")), F.lit("\n\n"), g["body"])
    return [text.alias("text"), g["body"].alias("body"), F.length(text).alias("n_chars"), g["n"].alias("n_sentences")]


def _documents(spark, at) -> DataFrame:
    return spread(spark.read.parquet(f"{at}/documents.parquet")).where("text is not null").select(F.col("doc_id").cast("string").alias("doc"), "text")


def _marked(spark, at) -> DataFrame:
    return _documents(spark, at).unionAll(given(spark, MARKDOWN, "doc string, text string"))


def sentence_pieces(spark, at):
    return _documents(spark, at).select("doc", F.posexplode(sentences(F.col("text"))).alias("place", "piece"))


def fixed_chunks(spark, at):
    """C4, C7 over all documents."""
    g = _documents(spark, at).select("doc", F.posexplode(fixed(F.col("text"))).alias("chunk", "g"))
    return g.select("doc", "chunk", *records(F.col("doc"), F.lit(""), F.col("g")))


def markdown_blocks(spark, at):
    """SC8: blocks of documents and of the Markdown texts below."""
    s = _marked(spark, at).select("doc", sections(F.col("text")).alias("all"))
    s = s.select("doc", (F.size(F.filter("all", lambda x: x["title"].isNotNull())) >= 2).alias("titled"), F.posexplode("all").alias("block", "s")).where("s.body <> ''")
    return s.select("doc", "block", "titled", F.coalesce("s.title", F.lit("")).alias("title"), F.length("s.body").alias("n_chars"))


def structural_chunks(spark, at):
    """C5, C7 over all documents and the Markdown texts below."""
    s = _marked(spark, at).select("doc", F.explode(structural(F.col("text"))).alias("g"))
    return s.select("doc", "g.block", "g.chunk", *records(F.col("doc"), F.col("g.title"), F.col("g")))


def semantic_chunks(spark, at):
    """C6 with bags of words for an embedder."""
    return _documents(spark, at).select("doc", F.posexplode(semantic(F.col("text"))).alias("chunk", "g")).select("doc", "chunk", F.col("g.body").alias("body"), F.col("g.n").alias("n_sentences"))


def flat_pieces(spark, at):
    """650 tokens of 4.6 characters, an overlap of 15 %."""
    return _documents(spark, at).select("doc", F.posexplode(split_pieces(F.col("text"), 2990, 450)).alias("chunk_index", "piece"))


def parent_children(spark, at):
    """Parents of 650 tokens, children of 120; the child index runs on over the parents of a document."""
    deep = applied(lambda t: [(i, p, c) for i, p in enumerate(cuts.pieces(t, 2990, 299)) for c in cuts.pieces(p, 552, 110)], "array<struct<i:int,p:string,c:string>>", F.col("text"))
    x = _documents(spark, at).select("doc", F.posexplode(deep).alias("chunk_index", "x"))
    return x.select("doc", "chunk_index", F.col("x.i").alias("parent_index"), F.sha1("x.p").alias("parent_sha"), F.col("x.c").alias("child"))


def measured_children(spark, at):
    """C11: children of the measured chunks; their index starts anew in each parent, and parents are numbered over the corpus."""
    wide = F.col("doc").cast("decimal(38,0)") * F.lit(10_000_000_000).cast("decimal(11,0)") + F.col("chunk")  # a chunk's number is under 2^31
    p = written(fixed_chunks(spark, at).select(wide.cast("decimal(38,0)").alias("key"), "text"), "parents")
    p = numbered(p, "key").select(F.col("place").alias("parent_index"), "text")
    kids = applied(lambda t: cuts.pieces(t, 552, 110) or [t], "array<string>", F.col("text"))
    return p.select("parent_index", F.posexplode(kids).alias("chunk_index", "child"))


def requirement_children(spark, at):
    """C14: children of 200 tokens of the structural chunks, under a key of parent and child."""
    x = structural_chunks(spark, at).select("doc", "block", "chunk", "text", F.posexplode(split_pieces(F.col("text"), 920, 184)).alias("child_index", "child"))
    return x.select("doc", "block", "chunk", "child_index", F.length("child").alias("n_chars"), F.sha1(F.concat("text", F.lit("||"), "child")).alias("key"))


def middle_sentence(text: Column) -> Column:
    """Of the sentences of eight words and more the one in the middle; null where there is none."""
    return applied(cuts.middle, "string", text)


def middle_queries(spark, at):
    """A query for each fixed chunk of sixteen words and more, from its middle, where a title does not give it away."""
    one_or_none = applied(lambda t: [q] if cuts.words(t) >= 16 and (q := cuts.middle(t)) else [], "array<string>", F.col("text"))  # a filter would cut again
    return fixed_chunks(spark, at).select("doc", "chunk", F.explode(one_or_none).alias("query"))


def chunk_report(spark, at):
    """Counts, and scores of size, endings, beginnings and cohesion of the fixed chunks, with their weighted note.

    Cohesion is the mean likeness of neighbours among a chunk's first twelve sentences, over all chunks of two sentences and more.
    """
    return _report(fixed_chunks(spark, at).select("doc", "body", "n_chars", F.lit("fixed").alias("strategy"))).drop("strategy")


def _report(c: DataFrame) -> DataFrame:
    """The row of chunk_report for each strategy of chunks (doc, body, n_chars, strategy)."""
    end = F.col("body").rlike(r"[.!?…:;)\]»\"']\s*$") | (F.col("body").rlike(r"[0-9]\s*$") & (F.size(texts.words(F.col("body"))) > 3))
    loose = F.col("body").rlike("(?i)^(?:" + "|".join([*DANGLING, "the former", "the latter"]) + r")(?![\p{L}\p{N}_])")
    mean = applied(lambda t: cuts.cohesion(t, 12), "double", F.col("body"))
    r = c.select("strategy", "doc", "n_chars", F.length("body").between(0.5 * TARGET, 1.5 * TARGET).alias("sized"), end.alias("ended"), (~loose).alias("begun"), mean.alias("cohesion"))
    share = lambda x: F.avg(F.col(x).cast("double"))
    r = r.groupBy("strategy").agg(F.count("*").alias("chunks"), F.countDistinct("doc").alias("docs"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.round(F.avg("n_chars"), 4).alias("mean"),
              F.round(F.avg((F.col("n_chars") < 300).cast("double")), 6).alias("tiny"), share("sized").alias("size_score"), share("ended").alias("end_score"), share("begun").alias("begin_score"), F.avg("cohesion").alias("cohesion"))
    note = (0.15 * F.col("size_score") + 0.25 * F.col("end_score") + 0.25 * F.col("begin_score") + 0.20 * F.col("cohesion")) / 0.85
    return r.select("strategy", "chunks", "docs", "low", "high", "mean", "tiny", *(F.round(x, 6).alias(x) for x in ("size_score", "end_score", "begin_score", "cohesion")), F.round(note, 6).alias("note"))


def candidate_report(spark, at):
    """The report of fixed, structural and semantic chunks of the same documents, a row for each strategy."""
    told = {"fixed": fixed_chunks(spark, at), "structural": structural_chunks(spark, at), "semantic": semantic_chunks(spark, at).withColumn("n_chars", F.length("body"))}
    every = [c.select("doc", "body", "n_chars", F.lit(name).alias("strategy")) for name, c in told.items()]
    return _report(every[0].unionAll(every[1]).unionAll(every[2]))


MARKDOWN = [
    ("guide", "Intro line before any title.\n# First title\nDr. Smith came. He saw the valley, which lies far below the town, and he stayed for a long while there.\n## Second one\n\nShort.\nA list: one; two; three.\n#\nNo name here, but words.\n# Empty\n# Last\nThe end of it."),
    ("plain", "No title at all.\nOnly a few lines; see art. 5 of it. They end here! Do they? Yes."),
    ("single", "# Only one\nSome text under one title only, which is not enough to cut by."),
    ("long", "# Part one\n" + " ".join(f"Sentence number {i} of the first part says a little more than the one before it did." for i in range(40)) + "\n# Part two\n" + " ".join(f"Here the second part goes on with sentence {i}, and says so." for i in range(30)) + "\n# Part three\nTiny."),
    ("abbreviations", "We met Mr. Jones and Mrs. Brown at 5 p.m. on a fine day in the old town (cf. fig. 3). It was cold, etc. Then J. Doe left the house by the back door."),
]

_WS = "[ \\t\\n\\r\\f\\v]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_JOINS = f"(lower(regexp_extract(regexp_replace(a[-1], '\\.+$', ''), '([^ \\t\\n\\r\\f\\v(]*)$', 1)) IN {plain.listed(ABBREVIATIONS)} OR regexp_matches(lower(regexp_extract(regexp_replace(a[-1], '\\.+$', ''), '([^ \\t\\n\\r\\f\\v(]*)$', 1)), '^[a-z]$') OR (length(a[-1]) < 25 AND a[-1][-1] NOT IN (':', '?', '!')))"


def _sentences(x: str) -> str:
    parts = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '([.!?…]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda p: {_strip('p')}), lambda p: p <> '')"
    return f"list_reduce(list_transform({parts}, lambda p: [p]), lambda a, p: CASE WHEN len(a) > 0 AND {_JOINS} THEN list_concat(a[1:len(a) - 1], [a[-1] || ' ' || p[1]]) ELSE list_concat(a, p) END, cast([] AS varchar[]))"


_NONE = "cast([] AS struct(b varchar, n integer, l varchar)[])"


def _packed(s: str) -> str:
    return f"list_reduce(list_transform({s}, lambda x: [{{'b': x, 'n': 1, 'l': x}}]), lambda a, x: CASE WHEN len(a) > 0 AND length(a[-1].b) + length(x[1].b) + 2 <= {TARGET} THEN list_concat(a[1:len(a) - 1], [{{'b': a[-1].b || ' ' || x[1].b, 'n': a[-1].n + 1, 'l': x[1].b}}]) ELSE list_concat(a, x) END, {_NONE})"


def _merged(g: str) -> str:
    return f"list_reduce(list_transform({g}, lambda x: [x]), lambda a, x: CASE WHEN len(a) > 0 AND length(x[1].b) < {LEAST} THEN list_concat(a[1:len(a) - 1], [{{'b': a[-1].b || ' ' || x[1].b, 'n': a[-1].n + x[1].n, 'l': x[1].l}}]) ELSE list_concat(a, x) END, {_NONE})"


def _headed(g: str) -> str:
    return f"CASE WHEN len({g}) >= 2 AND length({g}[1].b) < {LEAST} THEN list_concat([{{'b': {g}[1].b || ' ' || {g}[2].b, 'n': {g}[1].n + {g}[2].n, 'l': {g}[2].l}}], {g}[3:]) ELSE {g} END"


def _groups(source: str, keep: str = "") -> str:
    """(doc, keep, g): merged groups of the sentences of source's text."""
    return f"(SELECT doc {keep}, {_headed('g')} AS g FROM (SELECT doc {keep}, {_merged('g')} AS g FROM (SELECT doc {keep}, {_packed('s')} AS g FROM (SELECT doc {keep}, {_sentences('text')} AS s FROM {source} x) a) b) c)"


_DOCS = "(SELECT cast(doc_id AS varchar) AS doc, text FROM documents WHERE text IS NOT NULL)"
_ALL = f"(SELECT * FROM {_DOCS} d UNION ALL SELECT * FROM {plain.values(MARKDOWN, 'doc string, text string')} m)"
_TAIL = f"CASE WHEN i > 1 AND length(g[i - 1].l) <= {OVERLAP} THEN g[i - 1].l || ' ' || g[i].b ELSE g[i].b END"
_MORE = f"CASE WHEN i > 1 AND length(g[i - 1].l) <= {OVERLAP} THEN g[i].n + 1 ELSE g[i].n END"


def _fixed(source: str, name: str = "doc") -> str:
    return f"(SELECT doc, cast(i - 1 AS int) AS chunk, {name} || chr(10) || chr(10) || ({_TAIL}) AS text, {_TAIL} AS body, cast(length({name}) + 2 + length({_TAIL}) AS int) AS n_chars, {_MORE} AS n_sentences FROM (SELECT doc, g, unnest(range(1, len(g) + 1)) AS i FROM {_groups(source)} q) r)"


_CUT = f"string_split(regexp_replace(text, '(\\n)([ \\t]*#)', chr(1) || '\\2', 'g'), chr(1))"
_HASHED = r"regexp_matches(c[i], '^[ \t]*#')"
_TITLE = r"regexp_replace(string_split(c[i], chr(10))[1], '^[ \t]*#+', '')"
_BODY = f"CASE WHEN {_HASHED} THEN array_to_string(string_split(c[i], chr(10))[2:], chr(10)) ELSE c[i] END"
_BLOCK = f"""(SELECT doc, text, cast(block AS int) AS block, titled, coalesce(title, '') AS title, body FROM (SELECT doc, text, len(list_filter(c, lambda x: regexp_matches(x, '^[ \\t]*#'))) >= 2 AS titled, i - 1 AS block,
    CASE WHEN {_HASHED} THEN {_strip(_TITLE)} END AS title, {_strip(_BODY)} AS body FROM (SELECT doc, text, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc, text, {_CUT} AS c FROM {_ALL} x) y) z) w WHERE body <> '')"""
_STRUCTURAL = f"""(SELECT doc, block, cast(i - 1 AS int) AS chunk, doc || CASE WHEN title <> '' THEN ' > ' || title ELSE '' END || chr(10) || chr(10) || g[i].b AS text, g[i].b AS body, g[i].n AS n_sentences FROM (SELECT doc, block, title, g, unnest(range(1, len(g) + 1)) AS i FROM {_groups(f"(SELECT doc, block, title, body AS text FROM {_BLOCK} k WHERE titled)", ", block, title")} q) r
    UNION ALL SELECT doc.d, doc.b, chunk, doc.d || chr(10) || chr(10) || body, body, n_sentences FROM {_fixed(f"(SELECT {{'d': doc, 'b': block}} AS doc, body AS text FROM {_BLOCK} k WHERE NOT titled)", "doc.d")} f)"""

_CHUNKED = f"(SELECT {{'d': doc, 'b': block, 'c': chunk, 't': text}} AS key, text FROM {_STRUCTURAL} s)"


def _cosine(a: str, b: str) -> str:
    x, y = plain.tokens(a), plain.tokens(b)
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN len(list_intersect({x}, {y})) / sqrt(len({x}) * len({y})) ELSE 0.0 END"


def _pieces(source: str, size: int, overlap: int) -> str:
    """(key columns of source, i, piece): windows by recursion."""
    zone = max(1, size // 4)
    last = f"reverse(substring(t, s + {size - zone + 1}, {zone}))"
    found = "coalesce(" + ", ".join(f"nullif(strpos({last}, {sep}), 0)" for sep in ("chr(10) || chr(10)", "chr(10)", "' .'", "' '")) + ")"
    cut = f"CASE WHEN s + {size} >= length(t) THEN length(t) ELSE coalesce(s + {size} - {found} + 1, s + {size}) END"
    return f"""(WITH RECURSIVE w AS (SELECT key, t, s, {cut} AS e FROM (SELECT key, {_strip('text')} AS t, cast(0 AS bigint) AS s FROM {source} x) a WHERE t <> ''
        UNION ALL SELECT key, t, s, {cut} AS e FROM (SELECT key, t, greatest(s + 1, e - {overlap}) AS s FROM w WHERE e < length(t)) b)
        SELECT key, cast(row_number() OVER (PARTITION BY key ORDER BY s) - 1 AS int) AS i, piece FROM (SELECT key, s, {_strip('substring(t, s + 1, e - s)')} AS piece FROM w) c WHERE piece <> '')"""


_KEYED = "(SELECT cast(doc_id AS varchar) AS key, text FROM documents WHERE text IS NOT NULL)"
_PARENTS = _pieces(_KEYED, 2990, 299)
_KIDS = _pieces(f"(SELECT {{'d': key, 'p': i, 't': piece}} AS key, piece AS text FROM {_PARENTS} p)", 552, 110)
_SEMANTIC = f"""(SELECT doc, {_headed('g')} AS g FROM (SELECT doc, {_merged('g')} AS g FROM (SELECT doc, CASE WHEN len(s) < 3 THEN [{{'b': array_to_string(s, ' '), 'n': cast(len(s) AS int), 'l': s[-1]}}] ELSE
    list_transform(list_reduce(list_transform(range(1, len(s) + 1), lambda i: [{{'b': s[i], 'n': 1, 'l': s[i], 'c': CASE WHEN i > 1 THEN sims[i - 1] ELSE 2.0 END}}]), lambda a, x: CASE WHEN len(a) = 0 OR (x[1].c <= limit_at AND length(a[-1].b) + CASE WHEN len(a) > 1 THEN 1 ELSE 0 END >= {TARGET} / 2)
        OR length(a[-1].b) + CASE WHEN len(a) > 1 THEN 1 ELSE 0 END + length(x[1].b) + 1 > {int(TARGET * FACTOR)} THEN list_concat(a, x) ELSE list_concat(a[1:len(a) - 1], [{{'b': a[-1].b || ' ' || x[1].b, 'n': a[-1].n + 1, 'l': x[1].l, 'c': x[1].c}}]) END, cast([] AS struct(b varchar, n integer, l varchar, c double)[])), lambda x: {{'b': x.b, 'n': x.n, 'l': x.l}}) END AS g
    FROM (SELECT doc, s, sims, list_sort(sims)[greatest(0, cast(floor(len(sims) * 0.25) AS int) - 1) + 1] AS limit_at FROM (SELECT doc, s, list_transform(range(1, len(s)), lambda i: {_cosine('s[i]', 's[i + 1]')}) AS sims FROM (SELECT doc, {_sentences('text')} AS s FROM {_DOCS} x) a WHERE len(s) > 0) b) c) d) e)"""
_BEGINS = "^(?:" + "|".join([*DANGLING, "the former", "the latter"]) + ")(?:[^\\p{L}\\p{N}_]|$)"
_REPORT = f"""SELECT *, round((0.15 * size_raw + 0.25 * end_raw + 0.25 * begin_raw + 0.20 * cohesion_raw) / 0.85, 6) AS note FROM (SELECT strategy, count(*) AS chunks, count(DISTINCT doc) AS docs, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 4) AS mean, round(avg(CASE WHEN n_chars < 300 THEN 1.0 ELSE 0.0 END), 6) AS tiny,
    avg(CASE WHEN length(body) BETWEEN {TARGET // 2} AND {TARGET * 3 // 2} THEN 1.0 ELSE 0.0 END) AS size_raw, avg(CASE WHEN regexp_matches(body, '[.!?…:;)\\]»"'']{_WS}*$') OR (regexp_matches(body, '[0-9]{_WS}*$') AND len({plain.words('body')}) > 3) THEN 1.0 ELSE 0.0 END) AS end_raw,
    avg(CASE WHEN regexp_matches(lower(body), '{_BEGINS}') THEN 0.0 ELSE 1.0 END) AS begin_raw, avg(CASE WHEN len(s) >= 2 THEN list_avg(list_transform(range(1, len(s)), lambda i: {_cosine('s[i]', 's[i + 1]')})) END) AS cohesion_raw FROM (SELECT *, ({_sentences('body')})[1:12] AS s FROM $chunks f) h GROUP BY strategy) r"""
_FIXED_ROWS = f"(SELECT 'fixed' AS strategy, doc, body, n_chars FROM {_fixed(_DOCS)} x)"
_CANDIDATES = f"""(SELECT * FROM {_FIXED_ROWS} a UNION ALL SELECT 'structural', doc, body, cast(length(text) AS int) FROM {_STRUCTURAL} b
    UNION ALL SELECT 'semantic', doc, g[i].b, cast(length(g[i].b) AS int) FROM (SELECT doc, g, unnest(range(1, len(g) + 1)) AS i FROM {_SEMANTIC} f) c)"""
_SCORES = "strategy, chunks, docs, low, high, mean, tiny, round(size_raw, 6) AS size_score, round(end_raw, 6) AS end_score, round(begin_raw, 6) AS begin_score, round(cohesion_raw, 6) AS cohesion, note"
CANDIDATE_REPORT = f"(SELECT {_SCORES} FROM ({_REPORT.replace('$chunks', _CANDIDATES)}) z)"
QUERIES = {f.__name__: f for f in (sentence_pieces, fixed_chunks, markdown_blocks, structural_chunks, semantic_chunks, flat_pieces, parent_children, measured_children, requirement_children, middle_queries, chunk_report, candidate_report)}
ORACLES = {
    "sentence_pieces": f"SELECT doc, cast(i - 1 AS int) AS place, s[i] AS piece FROM (SELECT doc, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc, {_sentences('text')} AS s FROM {_DOCS} x) a) b",
    "fixed_chunks": f"SELECT doc, chunk, text, body, n_chars, n_sentences FROM {_fixed(_DOCS)} f",
    "markdown_blocks": f"SELECT doc, block, titled, title, cast(length(body) AS int) AS n_chars FROM {_BLOCK} k",
    "structural_chunks": f"SELECT doc, block, chunk, text, body, cast(length(text) AS int) AS n_chars, n_sentences FROM {_STRUCTURAL} f",
    "semantic_chunks": f"SELECT doc, cast(i - 1 AS int) AS chunk, g[i].b AS body, g[i].n AS n_sentences FROM (SELECT doc, g, unnest(range(1, len(g) + 1)) AS i FROM {_SEMANTIC} f) h",
    "flat_pieces": f"SELECT key AS doc, i AS chunk_index, piece FROM {_pieces(_KEYED, 2990, 450)} p",
    "parent_children": f"SELECT key.d AS doc, cast(row_number() OVER (PARTITION BY key.d ORDER BY key.p, i) - 1 AS int) AS chunk_index, key.p AS parent_index, sha1(key.t) AS parent_sha, piece AS child FROM {_KIDS} k",
    "measured_children": f"SELECT p.place AS parent_index, k.i AS chunk_index, k.piece AS child FROM (SELECT key AS place, i, piece FROM {_pieces(f'(SELECT row_number() OVER (ORDER BY cast(doc AS bigint), chunk) - 1 AS key, text FROM {_fixed(_DOCS)} f)', 552, 110)} q) k, (SELECT k.place) p",
    "requirement_children": f"SELECT key.d AS doc, key.b AS block, key.c AS chunk, i AS child_index, cast(length(piece) AS int) AS n_chars, sha1(key.t || '||' || piece) AS key FROM {_pieces(_CHUNKED, 920, 184)} k",
    "middle_queries": f"SELECT doc, chunk, q[cast(len(q) // 2 AS int) + 1] AS query FROM (SELECT doc, chunk, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda p: {_strip('p')}), lambda p: len({plain.words('p')}) >= 8) AS q FROM {_fixed(_DOCS)} f WHERE len({plain.words('text')}) >= 16) g WHERE len(q) > 0",
    "chunk_report": f"SELECT * EXCLUDE (strategy) FROM (SELECT {_SCORES} FROM ({_REPORT.replace('$chunks', _FIXED_ROWS)}) z) y",
    "candidate_report": f"SELECT * FROM {CANDIDATE_REPORT} c",
}

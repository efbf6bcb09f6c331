"""The registered queries and their SQL equivalents."""

from __future__ import annotations

from functools import partial

from docloom.functions import dialect
from docloom.operators import answers, choices, chunking, chunks, facts, fusion, layout, measures, numbering, probes, ranked, relational, retrieval, sequences, substring, tenders, vectors
from docloom.streaming import live

#: Capitalised words after a space stand in for named entities.
_NAMES = "regexp_extract_all(text, ' ([A-ZÀ-Þ][a-zà-ÿ][a-zà-ÿ]+)', 1)"
_MENTIONS = {"spark": f"(SELECT doc_id, explode({_NAMES}) AS name FROM {{documents}})", "plain": f"(SELECT doc_id, unnest({_NAMES}) AS name FROM documents)"}
_PARTS = "regexp_extract_all(text, '[A-Za-zÀ-ÿ]+', 0)"
_WORDS = {"spark": f"(SELECT doc_id, explode({_PARTS}) AS word FROM {{documents}})", "plain": f"(SELECT doc_id, unnest({_PARTS}) AS word FROM documents)"}
_WIDE = relational.WIDE | layout.WIDE


def _texts():
    for name, text in (relational.TEXTS | layout.TEXTS).items():
        ours, theirs = (text.replace("{mentions}", _MENTIONS[d]).replace("{words}", _WORDS[d]) for d in ("spark", "plain"))
        ours = ours.replace(", 'g')", ")").replace("\t", "\\t").replace("' \\t\n", "' \\t\n")
        theirs = theirs.replace("explode(sequence(", "unnest(generate_series(").replace("regexp_like(", "regexp_matches(").replace("explode(split(", "unnest(string_split(").replace("explode(regexp_extract_all(", "unnest(regexp_extract_all(")
        yield name, ours, theirs


def _run(name, text, spark, at):
    df = dialect.run(spark, at, text)
    return df.withColumns({c: df[c].cast("bigint") for c in _WIDE.get(name, [])})


def _plain(name, text):
    wide = ", ".join(f"cast({c} AS bigint) AS {c}" for c in _WIDE.get(name, []))
    return f"SELECT * REPLACE ({wide}) FROM ({dialect.plain_sql(text)}) w" if wide else dialect.plain_sql(text)


#: Modules whose Spark side is columns and whose SQL is written apart.
_APART = (answers, choices, chunks, facts, fusion, live, measures, probes, ranked, retrieval, sequences, tenders)
QUERIES = {name: partial(_run, name, ours) for name, ours, _ in _texts()} | chunking.QUERIES | vectors.QUERIES | substring.QUERIES | numbering.QUERIES
ORACLES = {name: _plain(name, theirs) for name, _, theirs in _texts()} | chunking.ORACLES | vectors.ORACLES
for _module in _APART:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

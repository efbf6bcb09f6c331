"""Models as functions over tables: embedding, generating, relations, names, languages, rerankers, judges and questions.

Each takes the model as a function of plain values and runs it in Arrow batches on the workers; a call that fails gives an error in
its row, never the end of the job. Stand-ins that need no model serve tests and corpora without one.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import texts

#: Small words by language, for the stand-in that names a text's language.
SMALL_WORDS = {"en": "the and of to is that for with".split(), "fr": "le la les et des que pour dans".split(), "de": "der die das und ist nicht mit ein".split(), "es": "el los las que por con una del".split()}
#: Requests in this package's own words; %s is the text.
REQUESTS = {
    "relations": "List the relations that the text states, as JSON {\"relations\": [{\"subject\", \"predicate\", \"object\"}]}.\n\n%s",
    "missed": "These relations were found already:\n%s\nList only those that the text states and the list lacks, in the same form.\n\n%s",
    "question": "Write one question that this passage answers, as JSON {\"question\", \"answer\"}; the answer must stand in the passage word for word.\n\n%s",
    "judge": "For each numbered statement say supported, partly, unsupported or unclear, as JSON {\"1\": verdict, ...}.\n\nPassage:\n%s\n\nStatements:\n%s",
    "requirements": "List the requirements of this passage, as JSON {\"rows\": [{\"requirement\", \"category\", \"status\"}]}.\n\n%s",
}


def request(kind: str, *parts: str) -> str:
    """M9."""
    return REQUESTS[kind] % parts


def hashed_bag(batch: list[str], size: int = 64) -> list[list[float]]:
    """M1 stand-in: counts of hashed words, of length one."""
    x = np.zeros((len(batch), size))
    for i, t in enumerate(batch):
        np.add.at(x[i], [zlib.crc32(w.encode()) % size for w in (t or "").lower().split()], 1)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).tolist()


def embed(df: DataFrame, model: Callable[[list[str]], list[list[float]]] = hashed_bag, text: str = "text", size: int = 64) -> DataFrame:
    """M1: df with an embedding and an error; a batch that fails is tried again one by one."""
    kept = [c for c in df.columns if c not in ("embedding", "error")]
    kind = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", embedding array<double>, error string"

    def one(t):
        try:
            return model([t])[0], None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), size):
                part = pdf.iloc[a : a + size]
                try:
                    got = [(v, None) for v in model(part[text].tolist())]
                except Exception:
                    got = [one(t) for t in part[text]]
                yield part[kept].assign(embedding=[v for v, _ in got], error=[e for _, e in got])

    return df.mapInPandas(run, kind)


def generate(df: DataFrame, model: Callable[[str], str], prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """M2: df with the model's answer to each prompt, or an error."""
    kept = [c for c in df.columns if c not in (answer, "error")]
    kind = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + f", {answer} string, error string"

    def one(p):
        try:
            return model(p), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for pdf in batches:
            got = [one(p) for p in pdf[prompt]]
            yield pdf[kept].assign(**{answer: [a for a, _ in got], "error": [e for _, e in got]})

    return df.mapInPandas(run, kind)


_RELATIONS = "struct<relations:array<struct<subject:string,predicate:string,object:string>>>"


def relations(chunks: DataFrame, model: Callable[[str], str], passes: int = 1, key: str = "id") -> DataFrame:
    """(key, s, p, o) that a model finds in each chunk; a further pass is asked for what the one before missed, and gives
    only relations that are new in lower case. Rows without subject, predicate or object go."""
    found = None
    for k in range(passes):
        if not k:
            asked = chunks.select(key, "text", F.format_string(REQUESTS["relations"], "text").alias("prompt"))
        else:
            had = found.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" | ", "s", "p", "o"))), "\n").alias("had"))
            asked = chunks.join(had, key, "left").select(key, "text", F.format_string(REQUESTS["missed"], F.coalesce("had", F.lit("")), "text").alias("prompt"))
        rows = generate(asked, model).select(key, F.explode(F.from_json(texts.unfenced(F.col("answer")), _RELATIONS)["relations"]).alias("r"))
        rows = rows.select(key, F.trim("r.subject").alias("s"), F.trim("r.predicate").alias("p"), F.trim("r.object").alias("o")).where("s <> '' and p <> '' and o <> ''")
        if found is not None:
            low = lambda t: [F.lower(t[c]) for c in ("s", "p", "o")]
            old = found.alias("old")
            rows = rows.join(old, (rows[key] == old[key]) & (F.struct(*low(rows)) == F.struct(*low(old))), "left_anti")
        found = rows if found is None else found.unionAll(rows)
    return found


def language(text):
    """M5: the language whose small words a text's first 5,000 characters hold most of, or null."""
    words = F.split(F.lower(F.substring(text, 1, 5000)), r"[^\p{L}]+")
    count = lambda some: F.size(F.filter(words, lambda w: w.isin(some)))
    counts = F.array(*(F.struct(count(some).alias("n"), F.lit(k).alias("lang")) for k, some in SMALL_WORDS.items()))
    best = F.element_at(F.array_sort(counts), -1)
    return F.when(best["n"] > 0, best["lang"])


def rerank(hits: DataFrame, model: Callable[[str, list[str]], list[float]], cut: int, query: str = "query", text: str = "text") -> DataFrame:
    """The hits of each query in the order of a cross-encoder's scores, cut; ties keep their order of text."""
    kind = f"{query} string, {text} string, score double"

    def run(pdf):
        return pdf[[query, text]].assign(score=[float(s) for s in model(pdf[query].iloc[0], pdf[text].tolist())])

    scored = hits.select(query, text).groupBy(query).applyInPandas(run, kind)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), text))).where(F.col("place") <= cut)


def shared_words(query: str, passages: list[str]) -> list[float]:
    """M6 stand-in: the share of a query's words in each passage."""
    q = set(query.lower().split())
    return [len(q & set(p.lower().split())) / max(len(q), 1) for p in passages]


def judge(statements: DataFrame, model: Callable[[str], str], size: int = 10) -> DataFrame:
    """(id, verdict) of statements (id, passage, statement), asked in batches of ten of a passage; what the model leaves out
    or names otherwise is unjudged."""
    k = F.row_number().over(Window.partitionBy("passage").orderBy("id")) - 1
    s = statements.withColumn("k", k).withColumn("batch", (F.col("k") / size).cast("int")).withColumn("no", F.col("k") % size + 1)

    def run(pdf):
        pdf = pdf.sort_values("no")
        try:
            said = json.loads(model(request("judge", pdf["passage"].iloc[0], "\n".join(f"{n}. {t}" for n, t in zip(pdf["no"], pdf["statement"])))))
        except Exception:
            said = {}
        known = {"supported", "partly", "unsupported", "unclear"}
        verdict = [said.get(str(n)) if isinstance(said, dict) else None for n in pdf["no"]]
        return pd.DataFrame({"id": pdf["id"], "verdict": [v if v in known else "unjudged" for v in verdict]})

    return s.groupBy("passage", "batch").applyInPandas(run, f"id {statements.schema['id'].dataType.simpleString()}, verdict string")


def questions(excerpts: DataFrame, model: Callable[[str], str], key: str = "id") -> DataFrame:
    """(key, question, answer) written for each excerpt, kept where the answer stands in it."""
    asked = generate(excerpts.select(key, "text", F.format_string(REQUESTS["question"], "text").alias("prompt")), model)
    q = asked.select(key, "text", F.from_json(texts.braced(F.col("answer")), "struct<question:string,answer:string>").alias("q")).select(key, "text", F.trim("q.question").alias("question"), F.trim("q.answer").alias("answer"))
    norm = lambda c: F.lower(texts.squeezed(F.col(c)))
    return q.where((F.col("question") != "") & (F.col("answer") != "") & F.contains(norm("text"), norm("answer"))).select(key, "question", "answer")


def swept(children: DataFrame, model: Callable[[str], str], cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, cache) of requirements asked of every child (key, text) once; answers kept in a cache are not asked again."""
    asked = children.join(cache.select("key"), "key", "left_anti") if cache is not None else children
    new = generate(asked.select("key", F.format_string(REQUESTS["requirements"], "text").alias("prompt")), model).where("error is null").select("key", "answer")
    every = new if cache is None else cache.select("key", "answer").unionAll(new)
    rows = every.select("key", F.explode(F.from_json(texts.unfenced(F.col("answer")), "struct<rows:array<struct<requirement:string,category:string,status:string>>>")["rows"]).alias("r")).select("key", "r.*")
    return rows.where(F.length(F.trim("requirement")) > 0), every


def whole_context(docs: DataFrame, question: str, window: int = 32_768) -> DataFrame:
    """M11, X20, SC11: one prompt of all texts in order of name before a question, its tokens, and whether they pass the window."""
    one = docs.where(F.trim("text") != "").agg(F.expr("listagg(text, '\\n\\n') WITHIN GROUP (ORDER BY name)").alias("text"))
    tokens = F.floor(F.size(texts.words(F.col("text"))) * 1.3)
    return one.select(F.concat("text", F.lit("\n\n" + question)).alias("prompt"), tokens.alias("tokens"), (tokens > window).alias("truncated"))

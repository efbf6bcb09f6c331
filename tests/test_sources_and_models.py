import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import models
from docloom.sources import files
from docloom.streaming import live


def test_scan(spark, tmp_path):
    for name, content in {"b.txt": "Été", "a.md": "# x", "d.json": '[{"text": "x"}, {"body": "y"}, 3]', "e.json": "{bad", "f.json": '"s"', "g.json": '{"text": 5, "content": "two"}'}.items():
        (tmp_path / name).write_text(content, encoding="utf-8")
    (tmp_path / "h.txt").write_bytes("Noël".encode("utf-16"))
    (tmp_path / "i.txt").write_bytes("caf\xe9 \x80".encode("latin-1"))
    (tmp_path / "j.pdf").write_bytes(b"not a pdf")
    (tmp_path / "k.png").write_bytes(b"x")
    got = files.scan(spark, str(tmp_path)).collect()
    assert [r.name for r in got] == sorted(r.name for r in got) and {r.name: r.text for r in got} == {"a.md": "# x", "b.txt": "Été", "d.json": "x\ny", "e.json": "", "f.json": "s", "g.json": "two", "h.txt": "Noël", "i.txt": "café €", "j.pdf": ""}
    assert [r.name for r in got if r.error] == ["j.pdf"]
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "nothing" if (tmp_path / "nothing").mkdir() is None else ""))


def test_encodings():
    for name in ("utf-8", "utf-8-sig", "utf-16", "utf-32", "utf-16-le", "utf-16-be", "cp1252"):
        assert files.decoded("Prix : 5 €, été".encode(name)) == "Prix : 5 €, été"


def test_names_references_and_runs(spark, tmp_path):
    assert files.fields(spark.createDataFrame([(1, [1.0], "x")], "PK int, Embedding array<double>, chunk string")) == {"vector": "Embedding", "text": "chunk", "id": "PK"}
    with pytest.raises(ValueError):
        files.fields(spark.createDataFrame([(1,)], "id int"))
    (tmp_path / "ref.json").write_text(json.dumps({"note": "x", "criteria": [{"id": "A", "words": [["a", "b"]]}, {"id": "B", "words": []}]}))
    assert [r.id for r in files.references(spark, str(tmp_path / "ref.json")).collect()] == ["A", "B"]
    for n in ("rag_long_prompt_run2.txt", "rag_long_prompt_run10.txt", "other.txt"):
        (tmp_path / n).write_text(n)
    assert [(r.system, r.prompt, r.run) for r in files.run_files(spark, str(tmp_path)).collect()] == [("rag", "long_prompt", 10), ("rag", "long_prompt", 2)]


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id int, embedding array<double>")
    assert files.write_vectors(v, f"{tmp_path}/v") == 2 and spark.read.parquet(f"{tmp_path}/v").count() == 2
    with pytest.raises(Exception, match="exists"):
        files.write_vectors(v, f"{tmp_path}/v")
    with pytest.raises(ValueError):
        files.write_vectors(v.unionAll(spark.createDataFrame([(3, [1.0])], v.schema)), f"{tmp_path}/w")
    assert files.write_vectors(v.limit(1), f"{tmp_path}/v", recreate=True) == 2 and spark.read.parquet(f"{tmp_path}/v").count() == 1
    edge = lambda rows: spark.createDataFrame(rows, "s string, p string, o string, sources array<string>")
    files.upsert_graph(spark, edge([("a", "p", "b", ["x"]), ("a", "p", "b", ["y"])]), f"{tmp_path}/g")
    files.upsert_graph(spark, edge([("a", "p", "b", ["x", "z"]), ("c", "p", "d", ["z"])]), f"{tmp_path}/g")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/g").collect())) == [("a", "p", "b", ["x", "y", "z"]), ("c", "p", "d", ["z"])]
    files.reset_graph(spark, edge([]), f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g").count() == 0
    rows = spark.createDataFrame([("hr", "Two; engineers", "must", None), ("a", "é", "must", "s")], "category string, requirement string, status string, source string")
    files.write_report(rows, f"{tmp_path}/r")
    assert {r.requirement: r.source for r in spark.read.json(f"{tmp_path}/r").collect()} == {"Two; engineers": None, "é": "s"}
    m = files.compliance_matrix(rows)
    assert len(m.columns) == 9 and [(r.no, r.category) for r in m.collect()] == [(1, "a"), (2, "hr")]
    files.write_matrix(m.coalesce(1), f"{tmp_path}/m", ["no", "requirement"])
    (part,) = [p for p in (tmp_path / "m").iterdir() if p.name.startswith("part")]
    assert part.read_bytes().decode("utf-8").lstrip("﻿").split() == ["no;requirement", "1;é", '2;"Two;', 'engineers"'] and part.read_bytes().startswith(b"\xef\xbb\xbf")
    facts = spark.createDataFrame([("B", "k", "5", "measured"), ("A", "m", "x", "rule"), ("A", "a", "y", "measured")], "section string, name string, value string, level string")
    assert [r.text for r in files.report_lines(facts).collect()] == ["## A", "- a: y (measured)", "- m: x (rule)", "## B", "- k: 5 (measured)"]
    assert files.public_columns(spark.createDataFrame([(1, 2)], "a int, _b int")).columns == ["a"]
    docs = spark.createDataFrame([("b", "two"), ("a", "one"), ("c", " ")], "name string, text string")
    assert files.concatenated(docs).first()[0] == "=== a ===\none\n\n=== b ===\ntwo"
    w = models.whole_context(docs, "Why?", 2).first()
    assert (w.prompt, w.tokens, w.truncated) == ("one\n\ntwo\n\nWhy?", 2, False)


def test_models(spark):
    def failing(batch):
        if any("bad" in t for t in batch):
            raise RuntimeError("no")
        return models.hashed_bag(batch)

    t = spark.createDataFrame([(1, "one two"), (2, "bad"), (3, "two one")], "id int, text string")
    e = {r.id: r for r in models.embed(t, failing).collect()}
    assert e[1].embedding == e[3].embedding and e[2].embedding is None and "no" in e[2].error
    g = models.generate(t.withColumnRenamed("text", "prompt"), lambda p: p.upper() if p != "bad" else 1 / 0).collect()
    assert {r.id: (r.answer, bool(r.error)) for r in g} == {1: ("ONE TWO", False), 2: (None, True), 3: ("TWO ONE", False)}

    def finder(prompt):
        if "already" in prompt:
            return '{"relations": [{"subject": "ANNA", "predicate": "Leads", "object": "nordic"}, {"subject": "Bob", "predicate": "met", "object": "Anna"}]}'
        return '```json\n{"relations": [{"subject": "Anna", "predicate": "leads", "object": "Nordic"}, {"subject": " ", "predicate": "p", "object": "x"}]}\n```'

    assert sorted(map(tuple, models.relations(t.where("id = 1"), finder, 2).collect())) == [(1, "Anna", "leads", "Nordic"), (1, "Bob", "met", "Anna")]
    lang = spark.createDataFrame([("the cat and the dog",), ("le chat et les chiens",), ("xyz",), (None,)], "t string").select(models.language(F.col("t"))).collect()
    assert [r[0] for r in lang] == ["en", "fr", None, None]
    hits = spark.createDataFrame([("red car", "blue"), ("red car", "a red car"), ("red car", "car")], "query string, text string")
    assert [(r.text, r.place) for r in models.rerank(hits, models.shared_words, 2).orderBy("place").collect()] == [("a red car", 1), ("car", 2)]
    s = spark.createDataFrame([(i, "p", f"s{i}") for i in range(25)], "id int, passage string, statement string")
    v = models.judge(s, lambda p: json.dumps({"1": "supported", "2": "maybe", "3": "unclear"})).groupBy("verdict").count().collect()
    assert {r.verdict: r[1] for r in v} == {"supported": 3, "unclear": 3, "unjudged": 19}
    q = models.questions(spark.createDataFrame([(1, "The  Sky is blue"), (2, "x")], "id int, text string"), lambda p: 'So: {"question": "What?", "answer": "the sky"} ok')
    assert [tuple(r) for r in q.collect()] == [(1, "What?", "the sky")]
    asked = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, text string")
    cache = spark.createDataFrame([("k1", '{"rows": [{"requirement": "old"}]}')], "key string, answer string")
    rows, kept = models.swept(asked, lambda p: '{"rows": [{"requirement": "new", "category": "hr"}, {"requirement": " "}]}', cache)
    assert sorted((r.key, r.requirement) for r in rows.collect()) == [("k1", "old"), ("k2", "new")] and kept.count() == 2


def test_live_tables(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:0{i}:00", "text": t, "event_type": "e"}) for i, t in enumerate(["a", "b", "a"])))
    s = spark.readStream.schema("ts timestamp, text string, event_type string").json(str(src))
    for name, df in (("fresh", live.new_texts(s, "ts")), ("counted", live.event_counts(s))):
        df.writeStream.format("memory").queryName(name).outputMode("append" if name == "fresh" else "complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.text for r in spark.table("fresh").collect()) == ["a", "b"] and [r.n for r in spark.table("counted").collect()] == [3]

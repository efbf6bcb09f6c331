"""Versions that a killed writer can't break, chunks and graphs that follow batches."""

import pytest

from docloom.sources import files, snapshots
from docloom.streaming import live


def docs(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def chunks(spark, path):
    return {(r.doc_id, r.chunk): r.body for r in snapshots.current(spark, path).collect()}


def test_only_changed_documents_are_cut_again(spark, tmp_path):
    path = str(tmp_path / "c")
    assert live.merge_chunks(docs(spark, (1, "One here."), (2, "Two there."), (3, None), (None, "lost")), path, 0)
    assert chunks(spark, path) == {(1, 0): "One here.", (2, 0): "Two there.", (3, None): None}
    before = {r.doc_id: r.sha for r in snapshots.current(spark, path).collect()}
    assert not live.merge_chunks(docs(spark, (1, "Seen again.")), path, 0), "a batch seen before changes nothing"
    assert live.merge_chunks(docs(spark, (2, "Two changed."), (1, "One here."), (4, "Four."), (4, "Four.")), path, 1)
    assert chunks(spark, path) == {(1, 0): "One here.", (2, 0): "Two changed.", (3, None): None, (4, 0): "Four."}
    assert {r.sha for r in snapshots.current(spark, path).where("doc_id = 1").collect()} == {before[1]}


def test_killed_between_any_two_steps(spark, tmp_path, monkeypatch):
    """Writing dies before the data, after the data, and after the mark: the graph is the old one or the new one."""
    path = str(tmp_path / "g")
    edge = lambda *rows: spark.createDataFrame(rows, "s string, p string, o string, source long")
    read = lambda: {tuple(r)[:3]: r.sources for r in live.graph(spark, path).collect()}
    live.merge_graph(edge(("a", "p", "b", 1), ("a", "p", "b", 1)), path, 0)
    old = {("a", "p", "b"): [1]}
    assert read() == old

    def dying(change):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        snapshots.replace(spark, path, dying, 1)
    assert read() == old
    edge(("x", "x", "x", 9)).write.parquet(f"{path}/data/1_1")  # data without a mark, as a killed writer leaves them
    assert read() == old
    assert live.merge_graph(edge(("a", "p", "b", 2), ("c", "p", "d", 2)), path, 1)
    assert read() == {("a", "p", "b"): [1, 2], ("c", "p", "d"): [2]}
    for n in (2, 3, 4):
        live.merge_graph(edge(("a", "p", "b", n)), path, n)
    assert len(snapshots.versions(spark, path)) == 2 and read()["a", "p", "b"] == [1, 2, 3, 4]
    assert live.merge_graph(edge(("e", "p", "f", 5)), path) and not live.merge_graph(edge(("z", "p", "z", 5)), path, 4)


def test_graph_file_is_restored(spark, tmp_path):
    path = f"{tmp_path}/g"
    edges = spark.createDataFrame([("a", "p", "b", ["x"])], "s string, p string, o string, sources array<string>")
    files.upsert_graph(spark, edges, path)
    (tmp_path / "g").rename(tmp_path / "g.old")  # killed while the new graph takes its place
    files.upsert_graph(spark, edges.limit(0), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a", "p", "b", ["x"])] and not (tmp_path / "g.old").exists()


def test_restarted_stream_goes_on(spark, tmp_path):
    path, source = str(tmp_path / "c"), str(tmp_path / "in")
    follow = lambda: live.follow(spark.readStream.schema("doc_id long, text string").parquet(source), live.merge_chunks, path).awaitTermination()
    docs(spark, (1, "One here.")).write.parquet(source)
    follow()
    docs(spark, (1, "One anew."), (2, "Two.")).write.mode("append").parquet(source)
    follow()
    follow()
    assert chunks(spark, path) == {(1, 0): "One anew.", (2, 0): "Two."}

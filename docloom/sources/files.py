"""Scans of text, Markdown and JSON files, answers and references; sinks for vectors, graphs, reports and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that a table's fields go by: what is asked for, and the names it may have, in order.
FIELDS = {"vector": ("vector", "embedding", "vec", "dense"), "text": ("text", "chunk", "content", "body"), "id": ("id", "pk", "vec_id", "doc_id"), "source": ("source", "doc", "file", "document")}


def decoded(content: bytes) -> str:
    """SC2, SC12: text of bytes: a byte order mark decides; then UTF-8; then UTF-16 where zero bytes show it; then Windows-1252.

    Bytes that fit nowhere are left out.
    """
    for mark, name in ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "ignore")
    for name in ("utf-8", "utf-16-le" if content[1:2] == b"\0" else "utf-16-be" if content[:1] == b"\0" else "cp1252"):
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        if "\0" not in text:
            return text
    if b"\0" in content[:2]:
        return content.decode("utf-16-le" if content[1:2] == b"\0" else "utf-16-be", "ignore")
    return content.decode("cp1252", "ignore")


def raw_texts(spark: SparkSession, folder: str, kinds: str = "txt,md,json,pdf") -> DataFrame:
    """SC1, SC2, SC4: (name, text, error) of the files of a folder, in order of name; a folder without any raises.

    A file that can't be read keeps its row: an empty text and the error. PDF needs pdfplumber on the workers.
    """
    import pyarrow as pa

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + kinds + "}").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def pdf(content):
        import io

        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as book:
            return "\n\n".join(p.extract_text() or "" for p in book.pages)

    def run(batches):
        for b in batches:
            texts, errors = [], []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    texts.append(pdf(content) if name.endswith(".pdf") else decoded(content))
                    errors.append(None)
                except Exception as e:  # one file must not end the scan: the error is its row
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["name", "text", "error"])

    out = files.mapInArrow(run, "name string, text string, error string")
    if files.select("name").isEmpty():
        raise FileNotFoundError(f"no text files in {folder}")
    return out.orderBy("name")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """SC1 to SC3: (name, text, error); JSON files give a string, the first of text, content, full_text, body, or those of a list."""
    v = raw_texts(spark, folder).withColumn("v", F.when(F.col("name").endswith(".json"), F.try_parse_json("text")))
    field = lambda x, f: f"CASE WHEN schema_of_variant(try_variant_get({x}, '$.{f}', 'variant')) = 'STRING' THEN try_variant_get({x}, '$.{f}', 'string') END"
    one = lambda x: "coalesce(" + ", ".join(field(x, f) for f in ("text", "content", "full_text", "body")) + ")"
    text = f"""CASE WHEN schema_of_variant(v) = 'STRING' THEN try_variant_get(v, '$', 'string') WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN array_join(array_compact(transform(try_variant_get(v, '$', 'array<variant>'), i -> CASE WHEN schema_of_variant(i) = 'STRING' THEN try_variant_get(i, '$', 'string') ELSE {one('i')} END)), '\\n') ELSE {one('v')} END"""
    return v.select("name", F.when(F.col("name").endswith(".json"), F.coalesce(F.expr(text), F.lit(""))).otherwise(F.col("text")).alias("text"), "error")


def concatenated(docs: DataFrame) -> DataFrame:
    """SC11: non-empty texts by name under their names, joined by a blank line."""
    part = F.concat(F.lit("=== "), "name", F.lit(" ===\n"), "text")
    return docs.where(F.trim("text") != "").select("name", part.alias("part")).agg(F.expr("listagg(part, '\\n\\n') WITHIN GROUP (ORDER BY name)").alias("text"))


def fields(df: DataFrame) -> dict[str, str]:
    """SC13: the names by which a table calls its vector, text, id and source; a missing vector raises."""
    low = {c.lower(): c for c in df.columns}
    found = {k: low[n] for k, names in FIELDS.items() for n in reversed(names) if n in low}
    if "vector" not in found:
        raise ValueError(f"no vector field among {df.columns}")
    return found


def references(spark: SparkSession, path: str, key: str = "criteria") -> DataFrame:
    """SC15: the rows of a list kept under a key of a JSON file."""
    return spark.read.option("multiLine", True).json(path).select(F.inline(key))


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    """SC16: (system, prompt, run, name, text) of files named <system>_<prompt>_run<N>.txt; others are left out."""
    form = r"^([A-Za-z0-9]+)_(.+)_run(\d+)\.txt$"
    r = raw_texts(spark, folder, "txt").where(F.col("name").rlike(form))
    return r.select(F.regexp_extract("name", form, 1).alias("system"), F.regexp_extract("name", form, 2).alias("prompt"), F.regexp_extract("name", form, 3).cast("int").alias("run"), "name", "text")


def write_vectors(df: DataFrame, path: str, vector: str = "embedding", recreate: bool = False) -> int:
    """SK1, SK2: the table at a path that must not exist, unless recreated; all vectors must have one dimension, which is returned."""
    dims = [r[0] for r in df.select(F.size(vector).alias("d")).distinct().limit(2).collect()]
    if len(dims) > 1:
        raise ValueError("vectors of several dimensions")
    df.write.mode("overwrite" if recreate else "errorifexists").parquet(path)
    return dims[0] if dims else 0


def upsert_graph(spark: SparkSession, edges: DataFrame, path: str) -> None:
    """SK3: edges (s, p, o, sources) merged into the graph at a path; an edge gets the sources that it lacks.

    The new graph is written beside the old one and takes its place when it is whole. A run that was killed while the two change
    places is finished by the next call; docloom.streaming.live has a graph that readers never find missing.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at, new, aside = (hadoop.Path(path + end) for end in ("", ".new", ".old"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) and fs.exists(aside):
        fs.rename(new if fs.exists(new) else aside, at)
    new_edges = edges.groupBy("s", "p", "o").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("b"))
    none = F.array().cast(edges.schema["sources"].dataType)
    old = spark.read.parquet(path).withColumnRenamed("sources", "a") if fs.exists(at) else new_edges.select("s", "p", "o", none.alias("a")).limit(0)
    both = old.join(new_edges, ["s", "p", "o"], "full")
    both.select("s", "p", "o", F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none))).alias("sources")).write.mode("overwrite").parquet(path + ".new")
    fs.delete(aside, True)
    if fs.exists(at):
        fs.rename(at, aside)
    fs.rename(new, at)
    fs.delete(aside, True)


def reset_graph(spark: SparkSession, edges: DataFrame, path: str) -> None:
    """SK4: an empty graph at a path."""
    edges.select("s", "p", "o", "sources").limit(0).write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """SK5: rows as JSON lines, nulls written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_matrix(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """SK6: given columns apart by semicolons under their names, a byte order mark first."""
    columns = columns or df.columns
    some = df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    first = "﻿" + columns[0]
    some.withColumnRenamed(columns[0], first).write.mode("overwrite").option("header", True).option("sep", ";").option("encoding", "UTF-8").csv(path)


def compliance_matrix(rows: DataFrame) -> DataFrame:
    """SK7: nine columns of each requirement, its place first and three to be filled in."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("category", "requirement"))
    blank = F.lit("")
    return rows.select(place.alias("no"), "category", "requirement", "status", "source", F.lit("to fill").alias("compliance"), blank.alias("answer"), blank.alias("evidence"), blank.alias("owner"))


def report_lines(facts: DataFrame) -> DataFrame:
    """SK8: (section, line, text) of facts (section, name, value, level): a title a section, its facts by level and name."""
    from pyspark.sql import Window

    w = Window.partitionBy("section").orderBy("level", "name")
    body = facts.select("section", F.row_number().over(w).alias("line"), F.concat(F.lit("- "), "name", F.lit(": "), "value", F.lit(" ("), "level", F.lit(")")).alias("text"))
    return facts.select("section").distinct().select("section", F.lit(0).alias("line"), F.concat(F.lit("## "), "section").alias("text")).unionAll(body).orderBy("section", "line")


def public_columns(df: DataFrame) -> DataFrame:
    """without the columns whose names start with an underscore."""
    return df.select([c for c in df.columns if not c.startswith("_")])

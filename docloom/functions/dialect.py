"""One relational text for Spark SQL and for plain SQL engines.

A query names its tables as {documents}, and writes $size(x), $n_words(x), $upper_median(x), $list(x) for what the dialects spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_SPARK = {
    "$size(": "size(", "$list(": "collect_list(", "$set(": "array_sort(collect_set(", "$one": "1.0D", "$zero": "0.0D", "$str": "string",
}
_PLAIN = {"$size(": "len(", "$list(": "list(", "$set(": "list_sort(list(DISTINCT ", "$one": "CAST(1 AS double)", "$zero": "CAST(0 AS double)", "$str": "varchar"}


def spark_sql(text: str) -> str:
    text = re.sub(r"\$n_words\((\w+)\)", r"size(regexp_extract_all(\1, '[^ \t\n\r]+', 0))", text)
    text = re.sub(r"\$upper_median\((\w+)\)", r"int(percentile_disc(0.5) WITHIN GROUP (ORDER BY \1 DESC))", text)
    text = re.sub(r"\$json\((\w+), ('[^']+')\)", r"cast(get_json_object(\1, \2) AS int)", text)
    text = re.sub(r"\$join\((\w+), (\w+)\)", r"listagg(\1, ' ') WITHIN GROUP (ORDER BY \2)", text)
    for k, v in _SPARK.items():
        text = text.replace(k, v)
    return text


def plain_sql(text: str) -> str:
    text = re.sub(r"\$n_words\((\w+)\)", r"len(regexp_extract_all(\1, '[^ \t\n\r]+', 0))", text)
    text = re.sub(r"\$upper_median\((\w+)\)", r"list_sort(list(\1))[count(\1) // 2 + 1]", text)
    text = re.sub(r"\$json\((\w+), ('[^']+')\)", r"try_cast(json_extract_string(\1, \2) AS int)", text)
    text = re.sub(r"\$join\((\w+), (\w+)\)", r"string_agg(\1, ' ' ORDER BY \2)", text)
    for k, v in _PLAIN.items():
        text = text.replace(k, v)
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def run(spark: SparkSession, at: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{at}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(spark_sql(text), **used)

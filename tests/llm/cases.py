"""Small tables with awkward rows, and DuckDB on the same rows."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

LONG = " ".join(f"word{i % 977} the mit license." for i in range(20_000))

TEXTS = [
    None, "", " ", "\n\t ", "a", "Released under the MIT License.", "UNDER THE MIT-LICENSE, under the mit license!",
    "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0.", "cc by nc cc by nc",
    "Ünder thé Straße ÇA la lumière! Ne pas. Über 100 Euro\n\nZweiter Absatz.", "naïve\u00a0café\u2003x  y\r\n z<|endoftext|>tail",
    "中文文本没有空格 そして 日本語", "𝔘𝔫𝔦 😀😀 \u0000 \x1c \x7f end", "!!! ??? ... ---", "12345 67.89", LONG,
    "one two three four five six", "one two three four five six", "One TWO three\tfour five six",
]


def documents(spark: SparkSession) -> DataFrame:
    """Nulls in every column, repeated rows, a repeated id, and columns named like those of the operators."""
    rows = [(i, t, ["en", "de", None][i % 3], ["b", None, "a", "ä", "B"][i % 5], len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (6, "another text with the same id", "en", "a", None), (None, "text without an id", "fr", "b", 3), (None, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ("score", "size", "key", "words", "hits", "label", "class", "taken", "root", "vec")
    return table.selectExpr("*", *[f"'x' AS {c}" for c in extra])


def no_documents(spark: SparkSession) -> DataFrame:
    return documents(spark).limit(0)


def duck(**tables: DataFrame) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name, table in tables.items():
        frame = table.toPandas().astype({c: "Int64" for c, t in table.dtypes if t in ("bigint", "int")})
        con.register(f"{name}_frame", frame)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_frame")
    return con


def sentences(seed: int, n: int, words: int = 400) -> list[str]:
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 7))) for _ in range(words)]
    return [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(20, 60))) for _ in range(n)]


def rows(frame: pd.DataFrame) -> list[tuple]:
    from check import canonical

    return canonical(frame)

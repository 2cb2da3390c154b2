"""Small tables with every odd case: nulls, empty and long texts, repeats, extra columns whose names clash."""

import duckdb
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, `row` long, fp long, kept long, bad long, keep boolean, id long, `a.b` string"
ROWS = [
    (1, "The cat sat on the mat and looked at the other cat.", "en"),
    (2, "The cat sat on the mat and looked at the other cat.", "en"),
    (3, "", "en"),
    (4, None, None),
    (None, "A text without an id stands here.", "en"),
    (5, "12345 !!! ???", None),
    (6, "ein \U0001f600 Wort und noch ein Wort  mit Leerzeichen\n\n und Zeilen ", "de"),
    (7, "x" * 6_000, "fr"),
    (8, "word " * 20_000, "en"),
    (9, "Licensed under CC BY 4.0. All Rights Reserved. cc by cc by", None),
    (9, "Licensed under CC BY 4.0. All Rights Reserved. cc by cc by", None),
    (10, "\x00\x1c\x85 <|endoftext|> ́ <|im_end|>", "es"),
    (11, "one", None),
    (12, "one two", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, "src", len(t or ""), 0.5, "x", 7, 3, 1, 1, False, 9, "dot") for i, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture()
def duck():
    """Run SQL over pandas tables."""

    def run(sql, **tables):
        con = duckdb.connect()
        for name, t in tables.items():
            con.register(name, t if isinstance(t, pd.DataFrame) else t.toPandas())
        return sorted((tuple(r) for r in con.sql(sql).fetchall()), key=str)

    return run


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)

"""The pipeline against a plain version of it, and its place among the registered queries."""

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from tuplewise.llm import bpe, decontaminate, langid, quality

from .conftest import DATA, plain
from .test_near_copies import classes


def test_run_equals_a_plain_version(spark, docs):
    rows = docs.collect()
    model = langid.train(docs)
    pairs = model.predict([r.text or "" for r in rows])
    rows = [r for r, v, s in zip(rows, *pairs, strict=True) if v != "und" and s >= langid.MIN_SCORE]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    weights, offset = quality.train(spark.createDataFrame(rows, docs.schema), labels).folded()
    rows = [r for r, s in zip(rows, quality.score_texts([r.text for r in rows], weights, offset), strict=True) if s >= quality.MIN_SCORE]
    rows = [r for r, least in zip(rows, classes([(r.doc_id, r.text) for r in rows]), strict=True) if r.doc_id == least]
    words = lambda t: decontaminate_words(t)
    windows = set()
    for item in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(item.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    clean = []
    for r in rows:
        w = words(r.text)
        hit = set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r)
    path, pattern = bpe._vocabulary()
    codec = bpe.codec(path, pattern)
    want = plain((r.doc_id, len(x) // 4) for r, x in zip(clean, codec.encode_bytes([r.text for r in clean]), strict=True))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert plain((r.doc_id, r.n_tokens) for r in got) == want and 0 < len(want) < docs.count()


def decontaminate_words(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def test_stages_keep_the_columns(spark, docs, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), DATA).columns == docs.columns
        assert stage(spark, odd, DATA).columns == odd.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_run_on_odd_and_empty_tables(spark, odd, docs, tmp_path):
    from pyspark.sql import functions as F

    for name, frame in (("odd", docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", "lang", "source", "n_chars")).withColumn("h1", F.lit(1)).withColumn("kept_id", F.lit(2))), ("empty", odd.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{tmp_path}/{name}/{t}.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}/odd").collect()
    ids = [r.doc_id for r in rows]
    # the row without an id is a text of its own; 3 to 5 have no words
    assert ids.count(None) <= 1 and len(set(ids)) == len(ids) and len(rows) > 50 and all(r.n_tokens > 0 for r in rows)
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").count() == 0


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and {"op7_decontaminate", "op9_chat", "op10_licenses"} <= set(entry.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5 and decontaminate.SPAN == 13 and np.isfinite(quality.MIN_SCORE)

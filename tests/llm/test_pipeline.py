"""The pipeline on the smallest tables and on odd rows: each stage's decisions take effect and nothing else changes."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryflow.llm import pii, toxicity

from .test_cases import PASSAGE, ROWS, SAID, SCHEMA
from .test_queries import LOW, SF, base_spans, classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def first_of_groups(rows):
    rows = sorted(rows)
    sets, links = [shingles(t) for _, t in rows], []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links.append((b, a))
    return {rows[r][0] for r in classes(len(rows), links)}


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out.append(docs)
    return [spark.read.parquet(f"{SF}/documents.parquet"), *out]


def test_stages(spark, kept):
    before, *after = kept
    rows = [{r["doc_id"]: r["text"] for r in df.collect()} for df in (before, *after[:4])]
    assert all(df.columns == COLUMNS for df in after[:4])
    for a, b in zip(rows[:3], rows[1:4]):
        assert b.items() <= a.items() and b
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = [labels[i] for i in rows[0].keys() - rows[1].keys() if i in labels]
    assert not gone or sum(gone) / len(gone) > 0.5
    assert set(rows[2]) == first_of_groups(rows[1].items())
    assert rows[4].keys() == rows[3].keys()
    for i, text in rows[4].items():
        assert not base_spans(text) and (text == rows[3][i]) == (not pii_in(rows[3][i], text))
    assert after[3].where(F.length("text") != F.col("n_chars")).count() == 0
    assert {r["doc_id"] for r in after[4].select("doc_id").distinct().collect()} == set(rows[4])


def pii_in(before, after):
    return before != after and "[" in after


def test_run_is_its_stages(spark, kept):
    ran = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, ran.select(columns).collect())) == sorted(map(tuple, kept[-1].select(columns).collect()))


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for df in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            assert out.count() == 0 if df is not docs else out.count() > 0
            assert k == 4 or out.schema.names == docs.columns
    stay = corpus_pipeline.distinct(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] for r in stay.collect()), key=str) == sorted((first_of_odd()), key=str)


def first_of_odd():
    """One row of each group, the null id being the smallest; ids that repeat are told apart by text."""
    order = sorted(set(ROWS), key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    return [order[k][0] for k in first_of_groups([(k, t or "") for k, (_, t) in enumerate(order)])]


def test_toxic_rows_go(spark):
    clean, toxic = [(k, SAID(60)) for k in range(400)], [(1000 + k, SAID(30) + " vilest " + SAID(30)) for k in range(200)]
    docs = spark.createDataFrame(clean + toxic, SCHEMA)
    labels = spark.createDataFrame([(k, 0) for k in range(100)] + [(1000 + k, 1) for k in range(100)], "doc_id long, toxic int")
    left = {r["doc_id"] for r in toxicity.keep_civil(docs, docs, labels).collect()}
    assert len(left & set(range(400))) >= 390 and len(left - set(range(400))) <= 10


def test_redaction_is_whole(spark):
    text = "write a@b.cd call +1 (555) 123-4567 4111111111111111 from 10.0.0.1"
    assert pii.redact(spark.createDataFrame([(1, text)], SCHEMA)).first()["text"] == "write [EMAIL] call [PHONE] [CARD] from [IP]"

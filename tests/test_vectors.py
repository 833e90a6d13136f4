"""Nearest vectors against plain Python and the query's own SQL: ties, copies, zeros, nulls, and a table of some size."""

import math
import random
import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarryflow.operators import vectors
from quarryflow.plans import catalog


def plain(rows, k):
    def alike(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return None
        lengths = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / lengths, 6) if lengths else math.nan

    out = []
    for asked in {i for i, _ in rows if i is not None and i % 20 == 0}:
        own = [(alike(a, b), j) for i, a in rows if i == asked for j, b in rows if j not in (None, asked)]
        own.sort(key=lambda x: (x[0] is None, -(math.inf if x[0] is not None and math.isnan(x[0]) else x[0] or 0), x[1]))
        out += [(asked, j, str(s)) for s, j in own[:k]]
    return sorted(out)


@pytest.mark.parametrize("block, part, held", [(8192, 1 << 18, 1 << 21), (3, 50, 64)])
def test_nearest_is_brute_force(spark, monkeypatch, block, part, held):
    for name, value in (("BLOCK", block), ("PART", part), ("HELD", held)):
        monkeypatch.setattr(vectors, name, value)
    dice = random.Random(5)
    rows = [(k - 40, [dice.choice((-1.5, 0.5, 2.0)) for _ in range(4)]) for k in range(300)]
    rows += [(400, [0.0] * 4), (401, None), (402, []), (403, [1.0, 2.0]), (404, [1.0, None, 2.0, 3.0]), (420, None), (440, [1.0, 2.0]), (None, [1.0] * 4), (20, [2.0] * 4), (21, rows[61][1])]
    for own in (rows, [(20, [1.0, 2.0]), (21, None)], [(20, [1.0])], []):
        got = vectors.nearest(spark.createDataFrame(own, "vec_id long, e array<double>").repartition(3), "vec_id", "e", F.col("vec_id") % 20 == 0, 7)
        assert sorted((r["asked"], r["id"], str(r["alike"])) for r in got.collect()) == plain(own, 7)


def written(folder, rows):
    ids, embeddings = zip(*rows)
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(embeddings, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())})
    pq.write_table(table, folder / "embeddings.parquet")
    return str(folder)


def test_zeros_and_copies_as_in_sql(spark, tmp_path):
    dice = random.Random(6)
    rows = [(k, [0.0] * 8 if k in (7, 40) else [1.0] * 8 if k % 3 == 0 else [dice.gauss(0, 1) for _ in range(8)]) for k in range(120)]
    folder = written(tmp_path, rows)
    want = duckdb.sql(f"with embeddings as (select * from '{folder}/embeddings.parquet') {catalog.oracle_sql()['nearest_vectors'].replace('with q', ', q', 1)}").fetchall()
    got = catalog.nearest_vectors(spark, folder)
    assert got.columns == ["asked", "vec_id", "alike"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_table_of_some_size_takes_seconds(spark, tmp_path):
    """12,000 vectors: pairs one by one in Spark's expressions took 216 s on four cores."""
    dice = random.Random(7)
    folder = written(tmp_path, [(k, [dice.random() - 0.5 for _ in range(64)]) for k in range(12_000)])
    start = time.monotonic()
    assert catalog.nearest_vectors(spark, folder).count() == 6_000
    assert time.monotonic() - start < 40

"""Composed operators against plain Python on made-up rows, ties and gaps included."""

import random

import pytest
from pyspark.sql import functions as F

from quarryflow.functions import scalar, settings
from quarryflow.operators import groups, joins
from quarryflow.sources import files
from quarryflow.streaming import events as stream


def test_as_of(spark):
    rng = random.Random(1)
    left = [(k, rng.randrange(3), rng.randrange(400)) for k in range(300)]
    right = [(rng.randrange(3), rng.randrange(400), rng.randrange(50)) for _ in range(120)]
    got = joins.as_of(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int"), "k", "t", "v", F.floor(F.col("t") / 50))
    want = {i: max(((b, v) for a, b, v in right if a == k and b <= t), default=(0, None))[1] for i, k, t in left}
    assert {r["id"]: r["v"] for r in got.collect()} == want


def test_in_range(spark):
    rng = random.Random(2)
    points, ranges = [rng.randrange(-500, 500) for _ in range(200)], [(a, a + rng.randrange(-5, 120)) for a in (rng.randrange(-500, 500) for _ in range(60))]
    got = joins.in_range(spark.createDataFrame([(p,) for p in points], "p int"), "p", spark.createDataFrame(ranges, "a int, b int"), "a", "b", 40)
    assert sorted(map(tuple, got.select("p", "a", "b").collect())) == sorted((p, a, b) for p in points for a, b in ranges if a <= p <= b)


def test_salted(spark):
    left, right = [(k % 3, k) for k in range(90)], [(0, "a"), (0, "b"), (1, "c")]
    l, r = spark.createDataFrame(left, "k int, x int"), spark.createDataFrame(right, "k int, y string")
    for how in ("inner", "left"):
        assert sorted(map(tuple, joins.salted(l, r, ["k"], 5, how).collect()), key=repr) == sorted(map(tuple, l.join(r, "k", how).collect()), key=repr)
    with pytest.raises(ValueError):
        joins.salted(l, r, ["k"], 2, "full")


def test_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 5), ("b", 5)], "g string, v int")
    assert sorted(map(tuple, groups.top_per_group(df, ["g"], [F.desc("v")], 2).collect())) == [("a", 2), ("a", 3), ("b", 5), ("b", 5)]
    assert sorted(map(tuple, groups.distinct_in_two(df, ["g"], "v", "n").collect())) == [("a", 3), ("b", 1)]


def test_settings(spark):
    lines = spark.createDataFrame([("A=1",), ("# B=2",), ("export C='x y'",), ("",), (None,), ("D=",), ('E="q=1"',), ("no",)], "value string")
    parsed = settings.parse(lines)
    assert sorted(map(tuple, parsed.collect())) == [("A", "1"), ("C", "x y"), ("D", ""), ("E", "q=1")]
    changed = settings.upsert(parsed, spark.createDataFrame([("A", "2"), ("Z", "9")], "key string, value string"))
    assert dict(map(tuple, changed.collect())) == {"A": "2", "C": "x y", "D": "", "E": "q=1", "Z": "9"}
    once = settings.append_absent(parsed, changed, ["key"])
    assert sorted(map(tuple, settings.append_absent(once, changed, ["key"]).collect())) == sorted(map(tuple, once.collect()))
    c = spark.createDataFrame([("g", "x", 1), ("g", "y", 2), ("h", "z", 1)], "g string, n string, p int")
    assert [tuple(r) for r in settings.first_present(c, spark.createDataFrame([("y",)], "n string"), "g", "n", "p").collect()] == [("g", "y")]


def test_scalars(spark):
    df = spark.createDataFrame([("v18.2.1", "s"), ("20", "S\n"), ("x", None), (None, "si")], "v string, a string")
    got = [tuple(r) for r in df.select(scalar.major_version(F.col("v")), scalar.affirmative(F.col("a")), scalar.or_default(F.col("v"), "d")).collect()]
    assert got == [(18, True, "v18.2.1"), (20, False, "20"), (None, False, "x"), (None, False, "d")]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] and round(r[0], 6) for r in v.select(scalar.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None]


@pytest.mark.parametrize("format", files.FORMATS)
def test_files(spark, tmp_path, format):
    df = spark.range(20).select(F.col("id").cast("string").alias("value")) if format == "text" else spark.range(20).withColumn("s", F.lit("a,b"))
    files.write(df, str(tmp_path / format), format)
    schema = None if format == "text" else df.schema
    assert sorted(map(tuple, files.read(spark, str(tmp_path / format), format, schema).collect())) == sorted(map(tuple, df.collect()))
    assert sum(map(len, files.rows(df, 7))) == 20


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k % 5}:10:00", k % 3, "click", 1.0, "{}") for k in range(30)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    feed = stream.source(spark, str(tmp_path / "in"), "*.parquet")
    counts = stream.drain(stream.windowed(feed, "1 hour", "10 hours"), "t_windows", str(tmp_path / "c1"), "complete")
    assert sorted(r["n"] for r in counts.collect()) == [7] * 5
    assert stream.drain(stream.once(feed, "10 hours"), "t_once", str(tmp_path / "c2")).count() == 30
    state = stream.drain(stream.running(feed), "t_running", str(tmp_path / "c3"), "update")
    assert {r["user_id"]: r["n"] for r in state.collect()} == {0: 12, 1: 12, 2: 11}


@pytest.mark.parametrize("order", ["rank", "row_number"])
def test_ranked_in_ranges(spark, order):
    rng = random.Random(2)
    rows = [(rng.choice("aaaaaaaab"), rng.choice([None, *range(40)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = sorted(((r["g"], r["v"], r["n"]) for r in groups.ranked(df, "g", "v", "n", order, ranges=7).collect()), key=repr)
    low = lambda v: -1 if v is None else v
    if order == "rank":
        assert got == sorted(((g, v, 1 + sum(h == g and low(w) < low(v) for h, w in rows)) for g, v in rows), key=repr)
    for g in "ab":
        own = sorted((n, low(v)) for h, v, n in got if h == g)
        assert [v for _, v in own] == sorted(low(v) for h, v in rows if h == g)
        assert order == "rank" or [n for n, _ in own] == list(range(1, len(own) + 1))


def test_percentiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(g, rng.random()) for g in "xyz" for _ in range({"x": 1, "y": 2, "z": 501}[g])] + [("z", None)]
    got = groups.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"low": 0.1, "mid": 0.5, "most": 1.0})
    for r in got.collect():
        own = sorted(v for g, v in rows if g == r["g"] and v is not None)
        for name, p in (("low", 0.1), ("mid", 0.5), ("most", 1.0)):
            at = p * (len(own) - 1)
            k = int(at)
            assert abs(r[name] - (own[k] + (own[min(k + 1, len(own) - 1)] - own[k]) * (at - k))) < 1e-12


def test_late_events_are_left_out(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for k, hours in enumerate(([1, 2, 20], [19, 30], [1, 40])):  # Spark holds events against the watermark of a batch before, so the third file's first is late
        rows = [(10 * k + j, "2024-01-01 00:00:00", 1, "click", 1.0, "{}", h) for j, h in enumerate(hours)]
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string, h int")
        df = df.withColumn("ts", (F.col("ts").cast("timestamp") + F.make_interval(hours=F.col("h"))).cast("timestamp_ntz")).drop("h")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream.drain(stream.windowed(feed, "1 hour", "2 hours"), "late", str(tmp_path / "c"))
    assert {r["window"]["start"].hour: r["n"] for r in out.collect() if r["window"]["start"].day == 1}[1] == 1

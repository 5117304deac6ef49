import math

from pyspark.sql import functions as F

from tributary.functions import statistics, values
from tributary.streaming import events


def test_values_wrap(spark):
    rows = [(a, b) for a in (0, 1, 7, 128, 255, 300, -1) for b in (0, 1, 3, 200, 255)]
    df = spark.createDataFrame(rows, "a long, b long")
    a, b = F.col("a"), F.col("b")
    out = df.select("a", "b", *(f(a, b).alias(f.__name__) for f in (values.plus, values.minus, values.times, values.quotient, values.remainder, values.both, values.either, values.differ)), values.negate(a).alias("negate"), values.shift_left(a, 3).alias("left"), values.shift_right(a, 3).alias("right")).collect()
    for r in out:
        x, y = r.a % 256, r.b % 256
        assert (r.plus, r.minus, r.times) == ((x + y) % 256, (x - y) % 256, x * y % 256)
        assert (r.quotient, r.remainder) == ((x // y, x % y) if y else (None, None))
        assert (r.both, r.either, r.differ, r.negate, r.left, r.right) == (x & y, x | y, x ^ y, -x % 256, (x << 3) % 256, x >> 3)


def test_levels_and_cache(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "k int, level int")
    assert {(r.k, r.j, r.m) for r in df.groupBy("k").agg(values.join(F.col("level")).alias("j"), values.meet(F.col("level")).alias("m")).collect()} == {(1, 1, 0), (2, 0, 0)}
    cache = spark.createDataFrame([(["a", "b", "c"], "b"), (["a", "b", "c"], "d"), ([], "x")], "cache array<string>, line string")
    assert [r.c for r in cache.select(values.touch(F.col("cache"), F.col("line"), 3).alias("c")).collect()] == [["b", "a", "c"], ["d", "a", "b"], ["x"]]


def test_statistics(spark):
    counts = {(0, "a"): 10, (0, "b"): 30, (1, "a"): 25, (1, "b"): 15, (1, "c"): 5}
    df = spark.createDataFrame([(k, o, n) for (k, o), n in counts.items()], "k int, o string, n long")
    rows, cols, total = {0: 40, 1: 45}, {"a": 35, "b": 45, "c": 5}, 85
    g = 2 * sum(n * math.log(n * total / rows[k] / cols[o]) for (k, o), n in counts.items())
    r = statistics.g_test(df, "k", "o").first()
    assert abs(r.g - g) < 1e-9 and r.df == 2
    d2 = sum((counts.get((0, o), 0) / 40 - counts.get((1, o), 0) / 45) ** 2 for o in cols)
    assert abs(statistics.squared_distance(df, "k", "o", 0, 1).first().d2 - d2) < 1e-12
    chi = sum((counts.get((0, o), 0) * math.sqrt(45 / 40) - counts.get((1, o), 0) * math.sqrt(40 / 45)) ** 2 / cols[o] for o in cols)
    r = statistics.two_sample(df, "k", "o", 0, 1).first()
    assert abs(r.chi2 - chi) < 1e-9 and r.df == 2


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 5, ["click", "error"][i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "t string, user_id long, event_type string").select(F.to_timestamp("t").alias("ts"), "user_id", "event_type")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = events.steps(stream).writeStream.outputMode("complete").format("memory").queryName("steps").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted(map(str, spark.table("steps").collect())) == sorted(map(str, events.steps(df).collect()))

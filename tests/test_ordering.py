import random

from pyspark.sql import functions as F

from memloom.operators.ordering import with_position


def test_positions_of_a_dominant_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(20)}", rng.random(), i)
            for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, t double, i bigint").repartition(5)
    got = with_position(df, ["k"], [F.col("t"), F.col("i")]).collect()
    want = {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(k, []).append(i)
    seen = {}
    for r in sorted(got, key=lambda r: r.pos):
        seen.setdefault(r.k, []).append(r.i)
    assert seen == want
    assert sorted(r.pos for r in got if r.k == "hot") == list(range(len(want["hot"])))


def test_equal_and_null_orders_with_columns_along(spark):
    rows = [("a", 1), ("a", None), ("a", 1), ("b", None), ("b", None), (None, 2), (None, 1)]
    df = spark.createDataFrame(rows, "k string, i bigint")
    along = spark.createDataFrame([("a", 7)], "k string, last bigint")
    got = with_position(df, ["k"], [F.col("i")], along=along).collect()
    assert sorted(((r.k or "", r.pos, r.i or 0, r["last"]) for r in got), key=repr) == sorted([
        ("a", 0, 0, 7), ("a", 1, 1, 7), ("a", 2, 1, 7), ("b", 0, 0, None), ("b", 1, 0, None),
        ("", 0, 1, None), ("", 1, 2, None)], key=repr)

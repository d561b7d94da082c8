import pytest
from pyspark.sql import functions as F

from chronomesh.functions.scalar import dictionary_code
from chronomesh.operators import split, timebin
from chronomesh.operators.scaling import dense_index, hash_rank, running_sums


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_expansion_boundaries(spark):
    df = spark.createDataFrame(
        [(1, None, 50.0), (2, 0.0, 50.0), (3, 20.0, 50.0), (4, 20.5, 50.0), (5, 65.0, 100.0), (6, 45.0, 30.0)], "id int, duration double, ts double"
    )
    out = rows(timebin.expand_duration(df, 20), "id", "ts", "conn_status")
    assert out == [
        (1, 50.0, "closing"), (2, 50.0, "closing"), (3, 50.0, "closing"),
        (4, 29.5, "starting"), (4, 50.0, "closing"),
        (5, 35.0, "starting"), (5, 55.0, "open"), (5, 75.0, "open"), (5, 100.0, "closing"),
        (6, 5.0, "open"), (6, 30.0, "closing"),
    ]


def test_expansion_from_the_start_and_without(spark):
    df = spark.createDataFrame([(20.5, 50.0)], "duration double, ts double")
    assert rows(timebin.expand_duration(df, 20, anchor="start"), "ts", "conn_status") == [(50.0, "starting"), (70.5, "closing")]
    assert rows(timebin.without_duration(df), "ts", "conn_status", "status_code") == [(50.0, "closing", 2)]


def test_expansion_has_no_python_worker(spark, tiny):
    from chronomesh.plans import inputs

    plan = inputs.conn_binned(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_bins_round_down(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (19.99,), (20.0,), (7000.0,)], "ts double")
    out = rows(timebin.bin_events(df, "ts", 20, 350), "ts", "bin_abs", "batch", "bin")
    assert out == [(-1.0, -1, -1, 349), (0.0, 0, 0, 0), (19.99, 0, 0, 0), (20.0, 1, 0, 1), (7000.0, 350, 1, 0)]


def test_strict_dictionary(spark):
    df = spark.createDataFrame([("b",), (None,)], "v string")
    assert [r[0] for r in df.select(dictionary_code(F.col("v"), ["a", "b"])).collect()] == [1, None]
    bad = spark.createDataFrame([("zz",)], "v string")
    assert bad.select(dictionary_code(F.col("v"), ["a", "b"], strict=False)).first()[0] is None
    with pytest.raises(Exception, match="not in dictionary"):
        bad.select(dictionary_code(F.col("v"), ["a", "b"])).collect()


@pytest.mark.parametrize("n,sizes", [(1, (1, 0, 0)), (2, (2, 0, 0)), (7, (5, 1, 1)), (15, (10, 3, 2)), (100, (60, 25, 15))])
def test_split_sizes(spark, n, sizes):
    out = split.split_batches(spark.range(n).withColumnRenamed("id", "batch"), [])
    found = {r["stage"]: r["batches"] for r in split.split_sizes(out).collect()}
    assert tuple(found.get(i, 0) for i in range(3)) == sizes
    assert out.select("batch").distinct().count() == n


def hot(spark, n=3000):
    """A third of all rows share one time."""
    return spark.range(n).select(
        F.col("id").alias("conn_id"), F.when(F.col("id") % 3 == 0, 7.25).otherwise(F.col("id") * 1.5).alias("ts")
    )


def test_time_shuffle_keeps_bins_and_offsets(spark):
    before = hot(spark).cache()
    after = split.random_time_shuffle(before, 10)
    bins = lambda df: sorted(r[0] for r in df.select(F.floor(F.col("ts") / 10)).collect())
    assert bins(before) == bins(after)
    joined = before.withColumnRenamed("ts", "old").join(after, "conn_id")
    assert joined.count() == 3000
    assert joined.filter(F.abs(F.pmod("old", F.lit(10.0)) - F.pmod("ts", F.lit(10.0))) > 1e-6).count() == 0
    assert joined.filter("floor(old / 10) <> floor(ts / 10)").count() > 1000


def test_bin_permutation_moves_whole_bins(spark):
    before = hot(spark)
    after = split.bin_permutation_shuffle(before, 10)
    pairs = before.withColumnRenamed("ts", "old").join(after, "conn_id").selectExpr("floor(old / 10) a", "floor(ts / 10) b").distinct()
    assert pairs.count() == pairs.select("a").distinct().count() == pairs.select("b").distinct().count()


def test_even_parts(spark):
    for n, parts, sizes in ((10, 3, [4, 3, 3]), (2, 3, [1, 1]), (9, 3, [3, 3, 3])):
        out = split.even_parts(hot(spark, n), parts, ["ts", "conn_id"])
        got = [r["count"] for r in out.groupBy("part").count().orderBy("part").collect()]
        assert got == sizes
        edges = [(r["lo"], r["hi"]) for r in out.groupBy("part").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("part").collect()]
        assert all(a[1] <= b[0] for a, b in zip(edges, edges[1:]))


def test_dense_index_and_ranks_are_dense(spark):
    df = hot(spark).repartition(5)
    ids = [r["i"] for r in dense_index(df, ["ts", "conn_id"], "i").orderBy("ts", "conn_id").collect()]
    assert ids == list(range(3000))
    ranks = [r["r"] for r in hash_rank(df, F.col("conn_id").cast("string"), "r", digits=2).collect()]
    assert sorted(ranks) == list(range(3000))


def test_running_sums_match_a_plain_loop(spark):
    df = spark.range(2000).select((F.when(F.col("id") < 1400, 0).otherwise(F.col("id") % 5)).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = {(r["g"], r["o"]): r["s"] for r in running_sums(df.repartition(6), ["g"], ["o"], {"s": "v"}).collect()}
    want, totals = {}, {}
    for i in range(2000):
        g = 0 if i < 1400 else i % 5
        totals[g] = totals.get(g, 0) + i % 7
        want[(g, i)] = totals[g]
    assert got == want


def test_sequential_bins_close_gaps(spark):
    df = spark.createDataFrame([(5,), (5,), (9,), (100,)], "b int")
    assert rows(timebin.sequential_bins(df, "b", 2), "b", "seq_bin", "seq_batch") == [(5, 0, 0), (5, 0, 0), (9, 1, 0), (100, 2, 1)]

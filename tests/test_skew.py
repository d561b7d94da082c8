"""One key holds a third of the rows; the joins must still be split over tasks."""

import pytest
from pyspark.sql import functions as F

from chronomesh.operators import dims, propagate
from chronomesh.operators.label import label_redteam

KEYS = ["batch", "bin"]
FORCED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def forced(spark):
    old = {k: spark.conf.get(k, None) for k in FORCED}
    for k, v in FORCED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def skewed_edges(spark, n=60000):
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 8).select(
        F.lit(0).alias("batch"), F.when(hot, 0).otherwise(F.col("id") % 50).cast("int").alias("bin"),
        (F.col("id") * 7919 % 400).alias("src"), F.when(hot, 5).otherwise(F.col("id") * 31 % 400).cast("long").alias("dst"),
        (F.col("id") % 10).cast("double").alias("v"), F.md5(F.col("id").cast("string")).alias("pad"),
    )


def test_host_lookup_splits_a_hot_host(forced):
    hot = F.col("id") % 3 == 0
    events = forced.range(0, 60000, 1, 8).select(
        "id", F.when(hot, "h0").otherwise(F.concat(F.lit("h"), F.col("id") % 500)).alias("src_ip"), F.md5(F.col("id").cast("string")).alias("pad")
    )
    hosts = dims.build_map(events, [["src_ip"]], ["host"], "host_id")
    out = dims.encode(events, hosts, {"src_ip": "host"}, "host_id", "src")
    plan = final_plan(out)
    assert "skew=true" in plan
    assert out.filter("src is null").count() == 0 and out.count() == 60000


def test_softmax_join_splits_a_hot_node(forced):
    edges = skewed_edges(forced)
    scored = edges.withColumn("s", F.col("v") / 10)
    out = propagate.softmax_sums(scored, KEYS, "s", ["v"])
    plan = final_plan(out)
    assert "skew=true" in plan
    hot = out.filter("bin = 0 and node = 5").first()["v"]
    rows = [r["v"] for r in edges.filter("bin = 0 and dst = 5").select("v").collect()]
    import math

    want = sum(math.exp(v / 10) * v for v in rows) / sum(math.exp(v / 10) for v in rows)
    assert math.isclose(hot, want)


def test_redteam_list_stays_whole_under_skew(forced):
    hot = F.col("id") % 3 == 0
    log = forced.range(0, 9000, 1, 4).select(
        F.col("id").alias("auth_id"), F.when(hot, 1).otherwise(F.col("id")).alias("time"), F.when(hot, "u").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("src_user"),
        F.lit("w").alias("dst_user"), F.lit("a").alias("src_computer"), F.lit("b").alias("dst_computer"),
    )
    listed = log.filter("auth_id % 3 = 0").select("time", F.col("src_user").alias("user_name"), "src_computer", "dst_computer")
    out = label_redteam(log, listed)
    assert out.count() == 9000 and out.filter("malicious").count() == 3000


def test_redteam_labels_exchange_the_log_once(forced):
    log = forced.range(0, 3000, 1, 4).select(
        F.col("id").alias("auth_id"), (F.col("id") % 50).alias("time"), F.concat(F.lit("u"), F.col("id") % 7).alias("src_user"),
        F.concat(F.lit("u"), F.col("id") % 5).alias("dst_user"), F.lit("a").alias("src_computer"), F.lit("b").alias("dst_computer"))
    listed = forced.createDataFrame([(3, "u1", "a", "b"), (3, "u2", "a", "b"), (4, None, "a", "b"), (None, "u1", "a", "b")],
                                    "time long, user_name string, src_computer string, dst_computer string")
    out = label_redteam(log, listed)
    rows = out.collect()
    assert all(r.malicious == (r.time == 3 and bool({r.src_user, r.dst_user} & {"u1", "u2"})) for r in rows) and len(rows) == 3000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 4  # log and list, in the first and the final plan

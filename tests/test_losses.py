"""Nulls, unknown classes and more files than expected: nothing is lost without a word."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronomesh.operators import metrics, stats
from chronomesh.operators.scaling import hash_rank, running_sums
from chronomesh.plans import inputs
from chronomesh.sources import views


def test_class_tables_add_up(spark):
    rows = [(0, "none", 3), (0, None, 2), (0, "Unheard of", 4), (1, "Discovery", 1), (None, "none", 5)]
    counts = spark.createDataFrame(rows, "batch int, label string, events long")
    wide = {r["batch"]: r.asDict() for r in stats.label_pivot(counts, "batch", "label", ["none", "Discovery"]).collect()}
    assert {b: sum(v for k, v in r.items() if k != "batch") for b, r in wide.items()} == {0: 9, 1: 1, None: 5}
    assert wide[0]["other"] == 6
    running = stats.label_cumulative(counts, "batch", "label", ["none", "Discovery"])
    assert running.agg(F.sum("events")).first()[0] == 15 and running.count() == 9


def test_running_sums_keep_a_null_group(spark):
    rows = [("a", 1, 10), (None, 1, 1), (None, 2, 2), ("a", 2, 20)]
    got = running_sums(spark.createDataFrame(rows, "g string, o int, v long"), ["g"], ["o"], {"s": "v"}).collect()
    assert {(r["g"], r["o"], r["s"]) for r in got} == {("a", 1, 10), ("a", 2, 30), (None, 1, 1), (None, 2, 3)}


def test_summary_keeps_a_null_data_set(spark):
    rows = [("a", 1.0, "h"), (None, 2.0, None)]
    got = stats.dataset_summary(spark.createDataFrame(rows, "d string, t double, h string"), "d", "t", ["h"]).collect()
    assert {(r["d"], r["events"], r["unique_hosts"]) for r in got} == {("a", 1, 1), (None, 1, 1)}


@pytest.mark.parametrize("row", [(None, 0), (0, None), (3, 0), (0, -1)])
def test_confusion_matrix_rejects_what_is_no_class(spark, row):
    df = spark.createDataFrame([row, (1, 1)], "label int, pred int")
    with pytest.raises(Exception, match="is no class"):
        metrics.confusion_matrix(df, 3).collect()


def test_positions_take_one_file_key():
    with pytest.raises(ValueError):
        stats.bin_position(["a", "b", "batch"], 10)


def test_rank_offsets_are_bounded(spark):
    with pytest.raises(ValueError):
        hash_rank(spark.range(3), F.col("id").cast("string"), "r", digits=5)


@pytest.mark.parametrize("name", ["relative_time", "time_range", "auth_edges", "trade_degrees"])
def test_results_do_not_depend_on_the_time_zone(spark, tiny, name):
    from chronomesh.plans.registry import QUERIES

    found = []
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found.append(sorted(map(repr, QUERIES[name](spark, tiny).collect())))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("name", ["time_range", "topology_slice", "label_counts_tail", "expand_time_range"])
def test_time_bounds_reach_the_scan(spark, tiny, name):
    plan = entry.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts," in plan


def test_range_without_any_duration(spark, tiny):
    from chronomesh.operators import timebin

    flat = views.conn(spark, tiny).withColumn("duration", F.lit(None).cast("double"))
    longest = flat.agg(F.max("duration")).first()[0] or 0.0
    rel = timebin.relative_time(flat, float(views.FIRST_EVENT))
    assert timebin.expand_range(rel, 0, 1e9, 3600, longest).count() == inputs.relative(spark, tiny).count()


@pytest.mark.parametrize("name, most", [
    ("random_time_shuffle", 1), ("random_time_shuffle_widths", 1), ("dataset_stats", 1), ("novelty_by_stage", 1), ("running_mean_metric", 1),
    ("stage_events", 1),
])
def test_the_log_is_scanned_once(spark, tiny, name, most, monkeypatch):
    """Every plan that runs, staged steps included, is searched for scans of the event log."""
    from pyspark.sql import DataFrame, DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def recorded(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    out = entry.queries()[name](spark, tiny)
    assert isinstance(out, DataFrame)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("event_id#") > 0 and p.count("/events.parquet") for p in plans) == most


def test_density_adds_up_and_follows_the_kernel(spark):
    from chronomesh.operators import stats

    rows = [("a", float(v)) for v in [3, 3, 3, 10, 50, 51, 52, 90] * 20] + [(None, 7.0)] * 5 + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = stats.time_density(df, ["g"], "v", step=0.5).toPandas()
    sums = got.groupby(got.g.fillna("null")).density.sum() * 0.5
    assert abs(sums - 1).max() < 1e-9 and len(sums) == 2
    import numpy as np
    v = np.array([x for g, x in rows if g == "a" and x is not None and x == x])
    q = np.percentile(v, [25, 75])
    h = 0.9 * min(v.std(), (q[1] - q[0]) / 1.34) * len(v) ** -0.2
    mine = got[got.g == "a"].set_index("point").density
    for point in (3.0, 30.0, 51.0):
        want = np.exp(-((point - v) / h) ** 2 / 2).mean() / (h * np.sqrt(2 * np.pi))
        assert abs(mine[point] - want) < 2e-4

import gzip
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chronomesh.operators import scaling, stats, timebin
from chronomesh.operators.scaling import new_path, shared_dir
from chronomesh.plans import inputs
from chronomesh.sources import files, schemas, views
from chronomesh.streaming import jobs


def test_materialize_once_skips_complete_tables_only(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = spark.range(3), spark.range(5)
    assert files.materialize_once(one, path).count() == 3
    assert files.materialize_once(two, path).count() == 3
    assert files.materialize_once(two, path, force=True).count() == 5
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert files.materialize_once(one, path).count() == 3


def test_malformed_csv_fails(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("x,u,v,c,d,K,N,L,S",)], "value string").write.text(path)
    with pytest.raises(Exception):
        files.read_csv(spark, path, schemas.AUTH).collect()


def test_unknown_value_fails_the_conversion(spark, tmp_path):
    row = (1, "u", "v", "c", "d", "Nonsense", "Network", "LogOn", "Success")
    path = files.write_csv(spark.createDataFrame([row], schemas.AUTH), str(tmp_path / "c"))
    with pytest.raises(Exception, match="not in dictionary"):
        files.csv_to_parquet(spark, path, str(tmp_path / "p"), schemas.AUTH, {"auth_type": schemas.AUTH_TYPE}, ["time"])


def test_manifest_numbers_each_file(spark, tmp_path):
    manifest = {}
    for i in (1, 10):
        path = str(tmp_path / f"w={i}")
        spark.range(i).write.parquet(path)
        manifest[path] = i
    out = files.read_manifest(spark, manifest, spark.range(1).schema)
    assert {r["file_id"]: r["count"] for r in out.groupBy("file_id").count().collect()} == {1: 1, 10: 10}


def test_scan_prunes_and_pushes(spark, tiny):
    pruned = views.conn(spark, tiny).select("conn_id", "src_ip")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in pruned
    ranged = views.conn(spark, tiny).filter("datetime >= timestamp_ntz'2024-01-11 00:00:00'")
    assert "GreaterThanOrEqual(ts" in ranged._jdf.queryExecution().executedPlan().toString()


def test_no_single_task_exchange_over_events(spark, tiny):
    from chronomesh.operators.scaling import hash_rank

    ranked = hash_rank(inputs.relative(spark, tiny), F.col("conn_id").cast("string"), "r")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # the only unpartitioned window is the one over bucket offsets
    assert any("sum(_n" in line for line in windows)
    assert all("_bucket" in line for line in windows)


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
    assert new_path(spark, "a") != new_path(spark, "a")


def test_folder_for_intermediates_without_the_setting(tmp_path):
    """With an empty configuration folder nothing sets spark.checkpoint.dir: a local session works, and the builder's setting counts."""
    script = (
        "import sys; from pyspark.sql import SparkSession; from chronomesh.session import configure; from chronomesh.operators import scaling\n"
        "b = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')\n"
        "b = b.config('spark.checkpoint.dir', sys.argv[1]) if len(sys.argv) > 1 else b\n"
        "spark = configure(b.getOrCreate())\n"
        "print('FOUND', scaling.stage(spark.range(3), 'x').count(), scaling.shared_dir(spark))\n"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    for more in ([], [str(tmp_path / "own")]):
        ran = subprocess.run([sys.executable, "-c", script, *more], env=env, capture_output=True, text=True, timeout=120)
        assert "FOUND 3" in ran.stdout, ran.stderr[-2000:]
        assert not more or more[0] in ran.stdout


def test_a_cluster_must_name_the_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scaling.checkpoint_folder(Session)


def test_later_parts_are_not_opened(spark, tmp_path):
    log = spark.range(100).select(
        F.expr("id div 2").alias("time"), *[F.lit(n).alias(n) for n in schemas.AUTH.names[1:]]).repartitionByRange(5, "time").sortWithinPartitions("time")
    path = files.write_csv(log, str(tmp_path / "log"))
    parts = sorted(p for p in os.listdir(path) if p.endswith(".gz"))
    assert len(parts) == 5
    firsts = [int(gzip.open(f"{path}/{p}", "rt").readline().split(",")[0]) for p in parts]
    for part in parts[3:]:
        (tmp_path / "log" / part).write_bytes(b"no gzip")
        (tmp_path / "log" / f".{part}.crc").unlink(missing_ok=True)
    limit = firsts[2] - 1
    got = files.read_csv_ordered_until(spark, path, schemas.AUTH, limit)
    assert sorted(r.time for r in got.collect()) == sorted(t // 2 for t in range(100) if t // 2 <= limit)
    assert [os.path.basename(p) for p in files.parts_until(spark, path, schemas.AUTH, firsts[1])] == parts[:2]
    assert files.read_csv_ordered_until(spark, path, schemas.AUTH, -1).collect() == []


def test_manifest_takes_the_longest_entry_and_rejects_strangers(spark, tmp_path):
    manifest = {}
    for n, name in enumerate(("w", "w/inner", "w2", "x/w")):
        path = str(tmp_path / name)
        spark.range(n + 1).coalesce(1).write.mode("append").parquet(path)
        manifest[path] = n
    out = files.read_manifest(spark, {k: v for k, v in manifest.items() if v}, spark.range(1).schema)
    assert {r["file_id"]: r["count"] for r in out.groupBy("file_id").count().collect()} == {1: 2, 2: 3, 3: 4}
    df = files.read_manifest(spark, {str(tmp_path / "w2"): 7}, spark.range(1).schema)
    assert {r["file_id"] for r in df.collect()} == {7}


def test_numbered_folders_need_no_list(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id % 3 as int) as week").write.partitionBy("week").parquet(str(tmp_path / "t"))
    out = files.read_numbered(spark, str(tmp_path / "t"), "week", spark.range(1).schema)
    assert out.columns == ["id", "file_id"] and all(r["id"] % 3 == r["file_id"] for r in out.collect())


def test_data_sets_keep_their_own_clock_and_file_numbers(spark):
    a = spark.createDataFrame([(10.0, 0), (15.0, 1)], "ts double, file_id int")
    b = spark.createDataFrame([(700.0, 0), (None, None)], "ts double, file_id int")
    got = files.combine({"a": files.DataSet(a), "b": files.DataSet(b, 600.0)}).collect()
    assert {(r["dataset"], r["ts"], r["file_id"]) for r in got} == {("a", 0.0, "a-0"), ("a", 5.0, "a-1"), ("b", 100.0, "b-0"), ("b", None, None)}


def _batch_bins(spark, tiny, size=3600):
    b = views.conn(spark, tiny).groupBy((F.floor(F.col("ts") / size) * size).alias("b")).count()
    return {r["b"]: r["count"] for r in b.collect()}


def _feed(spark, tiny, folder, cuts):
    events = views.table(spark, tiny, "events")
    for cut in cuts:
        events.filter(cut).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in the order of their time


def test_stream_reads_a_file_and_a_folder_of_files(spark, tiny, tmp_path):
    folder = str(tmp_path / "events.parquet")
    _feed(spark, tiny, folder, ("event_id < 400", "event_id >= 400 and event_id < 700", "event_id >= 700"))
    want = _batch_bins(spark, tiny)
    for name, path, pace in (("one", f"{tiny}/events.parquet", 64), ("many", folder, 1)):
        stream = jobs.bin_stats(jobs.read_conn_stream(spark, path, pace), 3600)
        got = {r["bin_start"]: r["events"] for r in jobs.run_to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).collect()}
        open_bins = set(want) - set(got)
        assert got and all(want[b] == n for b, n in got.items())
        assert len(open_bins) <= 2 and (not open_bins or min(open_bins) > max(got))


def test_stream_goes_on_after_a_restart_and_leaves_late_rows_out(spark, tiny, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("events.parquet", "out", "state"))

    def run():
        return jobs.run_to_table(jobs.bin_stats(jobs.read_conn_stream(spark, folder, 1), 3600), out, state).collect()

    _feed(spark, tiny, folder, ("event_id < 500",))
    first = run()
    _feed(spark, tiny, folder, ("event_id >= 500",))
    second = run()
    assert {tuple(r) for r in first} < {tuple(r) for r in second}
    assert len({r["bin_start"] for r in second}) == len(second)  # nothing is counted twice
    _feed(spark, tiny, folder, ("event_id < 5",))  # long after their bins have closed
    assert {tuple(r) for r in run()} == {tuple(r) for r in second}


def test_stream_edges_are_single_in_bins_longer_than_the_delay(spark, tmp_path):
    day = 86400
    rows = [(i, f"2024-01-0{1 + t // day} {t % day // 3600:02d}:00:00", 7, "click", 1.0, '{"k": 6}') for i, t in enumerate(
        [0, 5 * 3600, 11 * 3600, 20 * 3600, day + 3600, 3 * day])]
    folder = str(tmp_path / "events.parquet")
    for row in rows:
        spark.createDataFrame([row], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn(
            "ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = jobs.dedup_edges(jobs.read_conn_stream(spark, folder, 1), day)
    got = jobs.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sorted(r["copies"] for r in got) == [1, 4]


def test_stream_novelty_survives_several_triggers(spark, tiny, tmp_path):
    """Files arrive one per trigger and in time order; the result is that of the batch operator."""
    folder = str(tmp_path / "feed")
    _feed(spark, tiny, folder, ("event_id < 400", "event_id >= 400 and event_id < 700", "event_id >= 700"))
    fields = {"hosts": ["src_ip", "dest_ip"]}
    stream = jobs.value_sightings(jobs.read_conn_stream(spark, folder, 1), 3600, fields)
    sightings = jobs.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    closed = sightings.agg(F.max("bin_start")).first()[0]
    got = jobs.novelty_from_sightings(sightings).agg(F.sum("new_values")).first()[0]
    conn = views.conn(spark, tiny).filter(F.floor(F.col("ts") / 3600) * 3600 <= closed)
    assert got == conn.select(F.explode(F.array("src_ip", "dest_ip"))).distinct().count()


def test_spine_lists_empty_bins(spark):
    df = timebin.bin_events(spark.createDataFrame([(5.0,), (95.0,)], "ts double"), "ts", 10, 5)
    assert timebin.bin_spine(df, ["batch"], 5).count() == 10


def test_last_cumulative_row_is_the_total(spark, tiny):
    counts = stats.label_counts(inputs.conn_plain_binned(spark, tiny), ["batch"], "label_tactic")
    totals = {r[0]: r[1] for r in stats.label_counts(views.conn(spark, tiny), [], "label_tactic").collect()}
    cumulative = stats.label_cumulative(counts, "batch", "label_tactic", schemas.LABEL_TACTIC)
    last = {r["label_tactic"]: r["m"] for r in cumulative.groupBy("label_tactic").agg(F.max("cumulative").alias("m")).collect()}
    assert {k: v for k, v in last.items() if v} == totals


def test_expansion_range_reaches_the_scan(spark, tiny, tmp_path):
    path = str(tmp_path / "conn")
    inputs.relative(spark, tiny).select("conn_id", "ts", "duration").write.parquet(path)
    stored = spark.read.parquet(path)
    ranged = timebin.expand_range(stored, 864000, 1728000, 3600, 60000.0)
    assert "GreaterThanOrEqual(ts,864000.0), LessThan(ts,1788000.0)" in ranged._jdf.queryExecution().executedPlan().toString()
    full = timebin.time_range(timebin.expand_duration(stored, 3600), 864000, 1728000)
    assert ranged.count() == full.count() > 0


def _click(i, hour, user, minute=0):
    return (i, f"2024-01-{1 + hour // 24:02d} {hour % 24:02d}:{minute:02d}:00", user, "click", 1.0, '{"k": 0}')


def _arrive(spark, folder, rows):
    schema = "event_id long, ts string, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)  # files are taken in the order of their time


def test_stateful_novelty_over_late_rows_triggers_and_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("events.parquet", "out", "state"))

    def run():
        stream = jobs.novelty(jobs.read_conn_stream(spark, folder, 1), 3600, {"hosts": ["src_ip"]}, "2 hours")
        return {(r["bin_start"] - 1704067200) // 3600: r["new_values"] for r in jobs.run_to_table(stream, out, state).collect()}

    _arrive(spark, folder, [_click(0, 0, 1), _click(1, 2, 2)])
    _arrive(spark, folder, [_click(2, 3, 2), _click(3, 1, 2), _click(4, 1, 3)])  # 2 and 3 were in an earlier bin, still open
    first = run()
    _arrive(spark, folder, [_click(5, 9, 3), _click(6, 9, 4)])
    assert run() == first | {0: 1, 1: 2}  # users 1; then 2 and 3; bin 2 has nothing new and bin 9 is open
    _arrive(spark, folder, [_click(7, 1, 9), _click(8, 20, 9)])  # the first is long too late
    _arrive(spark, folder, [_click(9, 30, 1)])
    assert run() == {0: 1, 1: 2, 9: 1, 20: 1}


@pytest.mark.parametrize("expiry", [2, 4])
def test_values_expire_from_the_state(spark, tmp_path, expiry):
    """Whatever the triggers, a value is new again after the same gap."""
    hours = [0, 1, 4, 5, 10, 12, 13]
    want = {h: 1 for i, h in enumerate(hours) if i == 0 or h - hours[i - 1] > expiry}
    for name, cuts in (("one", [hours]), ("each", [[h] for h in hours])):
        folder = str(tmp_path / name / "events.parquet")
        for cut in cuts:
            _arrive(spark, folder, [_click(h, h, 1) for h in cut])
        _arrive(spark, folder, [_click(99, 40, 2)])
        stream = jobs.novelty(jobs.read_conn_stream(spark, folder, 1), 3600, {"hosts": ["src_ip"]}, expiry=expiry * 3600)
        got = jobs.run_to_table(stream, str(tmp_path / name / "out"), str(tmp_path / name / "state")).collect()
        assert {(r["bin_start"] - 1704067200) // 3600: r["new_values"] for r in got} == want


def test_first_sightings_pass_on_what_is_counted():
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, row):
            self.held = row

    class Handle:
        def __init__(self):
            self.timers = set()
            self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

        def getValueState(self, name, schema):
            return Value()

    sightings = jobs.FirstSightings(10, 30)
    sightings.init(Handle())
    rows = lambda *bins: iter([Row(field="hosts", value="a", bin_start=b, inside=f"in {b}") for b in bins])
    new = [tuple(r) for r in sightings.handleInputRows(("hosts", "a"), rows(40, 0, 10), None)]
    assert new == [("hosts", "in 0")]  # 40 is 30 after 10, which still knows it
    new = [r.asDict() for r in sightings.handleInputRows(("hosts", "a"), rows(70, 110), None)]
    assert new == [{"field": "hosts", "inside": "in 110"}] and sightings.handle.timers == {1000 * 150}

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from cubeline import catalog, schema
from cubeline.functions import metrics, timefn
from cubeline.operators import excess, merge, usage
from cubeline.operators.cube import UsageCube
from cubeline.plans import query, runs
from cubeline.sources import confs, logs

H = 3_600_000


def attempts(spark, rows):
    return spark.createDataFrame([("c", "j", r[0], r[1], "u", "MAP", r[2], r[3], r[4], None, None, {"SPILLED_RECORDS": 7}, False, None, None) for r in rows], schema.ATTEMPTS)


def test_hour_split(spark):
    r = random.Random(1)
    rows = [("t", str(k), "SUCCESS", a := r.randrange(1, 40 * H), a + r.choice([0, 1, H, 2 * H, r.randrange(10 * H)])) for k in range(300)]
    rows += [("t", "x", "SUCCESS", 10 * H, 11 * H), ("t", "y", "SUCCESS", 0, 5), ("t", "z", None, 5, 9)]
    split = usage.split_hours(attempts(spark, rows))
    want_ms = sum(b - a for _, _, s, a, b in rows if s and a > 0)
    n = sum(1 for _, _, s, a, b in rows if s and 0 < a < b)
    got = split.agg(F.sum("part_ms"), F.sum("started"), F.sum("finished")).first()
    assert tuple(got) == (want_ms, n, n)
    whole = usage.hourly_usage(attempts(spark, [rows[-3]])).collect()
    assert [(w.time_ms, w.started, w.finished, w.elapsed_minutes, w.spilled_records, w.cpu_minutes) for w in whole] == [(10 * H, 1, 1, 60.0, 7, None)]
    assert {x.reason: x.n for x in usage.quality_counts(attempts(spark, rows)).collect()} == {"counted": 301, "no_start": 1, "no_status": 1}


def test_buckets_follow_the_zone(spark):
    first = int(dt.datetime(2013, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 1000
    for zone in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
        z = ZoneInfo(zone)
        rows = spark.range(0, 8760, 5).select((F.col("id") * H + first).alias("ms"))
        got = rows.select("ms", *(timefn.bucket(F.col("ms"), u, zone).alias(u) for u in ("DAYS", "WEEKS", "MONTHS", "QUARTERS"))).collect()
        for x in got:
            day = dt.datetime.fromtimestamp(x.ms / 1000, z).replace(hour=0, minute=0, second=0, microsecond=0)
            starts = {"DAYS": day, "WEEKS": day - dt.timedelta(days=(day.weekday() + 1) % 7), "MONTHS": day.replace(day=1), "QUARTERS": day.replace(day=1, month=(day.month - 1) // 3 * 3 + 1)}
            for u, at in starts.items():
                assert x[u] == round(at.replace(tzinfo=z).timestamp()) * 1000, (zone, u, day)
    with pytest.raises(ValueError):
        timefn.bucket(F.col("ms"), "YEARS")


def test_excess_modes(spark):
    rows = [("a", "1", "FAILED", 1, 9), ("a", "2", "SUCCESS", 2, 9), ("a", "3", "SUCCESS", 3, 9), ("b", "4", "KILLED", 5, 9), ("b", "5", "FAILED", 4, 9)]
    for mode, want in (("intent", {"1", "4"}), ("observed", {"2", "3", "4"})):
        assert {r.attempt_id for r in excess.mark_excess(attempts(spark, rows), mode).filter("excess").collect()} == want


LINES = [
    'Job JOBID="job_1_2" JOBNAME="daily \\"x\\"" USER="ann" SUBMIT_TIME="5" .',
    'Task TASKID="task_1_2_m_0" TASK_TYPE="MAP" START_TIME="6" .',
    'MapAttempt TASK_TYPE="MAP" TASKID="task_1_2_m_0" TASK_ATTEMPT_ID="a0" START_TIME="7" HOST="" .',
    'MapAttempt TASK_TYPE="MAP" TASKID="task_1_2_m_0" TASK_ATTEMPT_ID="a0" TASK_STATUS="SUCCESS" FINISH_TIME="90" COUNTERS="{(g)(G)[(CPU_MILLISECONDS)(CPU time)(1200)][(SPILLED_RECORDS)(S)(7)]}" .',
    'MapAttempt TASK_TYPE="SETUP" TASKID="task_1_2_m_9" TASK_ATTEMPT_ID="a9" START_TIME="7" .',
    'ReduceAttempt TASK_TYPE="REDUCE" TASKID="task_1_2_r_1" TASK_ATTEMPT_ID="orphan" TASK_STATUS="KILLED" START_TIME="7" FINISH_TIME="8" .',
    'Something job_1_2 USER="bob" LAUNCH_TIME="oops"',
    'MapAttempt TASK_TYPE="MAP" TASKID="task_1_2_m_0" START_TIME="7" .',
    "",
]


def test_lines(spark, tmp_path):
    folder = tmp_path / "alpha" / "daily" / "q" / "2024" / "0105"
    folder.mkdir(parents=True)
    (folder / "job_1_2.log").write_text("\n".join(LINES))
    lines = logs.classify(logs.located(logs.read_lines(spark, f"{tmp_path}/*/daily/*/2024/0105/*log")))
    job = merge.merge_jobs(logs.job_lines(lines)).first()
    assert (job.cluster, job.job_id, job.user, job.job_name, job.submit_ms, job.launch_ms) == ("alpha", "job_1_2", "bob", "daily x", 5, None)
    held, orphans = runs.attempts_from_lines(lines)
    a = held.first()
    assert held.count() == 1 and (a.status, a.start_ms, a.finish_ms, a.counters, a.user, a.day, a.excess) == ("SUCCESS", 7, 90, {"CPU_MILLISECONDS": 1200, "SPILLED_RECORDS": 7}, "bob", "20240105", False)
    assert [o.attempt_id for o in orphans.collect()] == ["orphan"]
    assert [(r.kind, r.reason) for r in logs.rejected_lines(lines).collect()] == [("attempt", "no_attempt_id")]
    assert {tuple(r) for r in runs.rejects(lines).collect()} == {("attempt", "no_attempt_id", 1), ("attempt", "no_task", 1)}
    nested = merge.nest(merge.merge_jobs(logs.job_lines(lines)), merge.merge_tasks(logs.task_lines(lines)), merge.merge_attempts(logs.attempt_lines(lines))).first()
    assert [t.task_id for t in nested.tasks] == ["task_1_2_m_0"] and [x.attempt_id for x in nested.tasks[0].attempts] == ["a0"]
    assert [(u.time_ms, u.day, u.user) for u in runs.process_logs(spark, f"{tmp_path}/*/daily/*/2024/0105/*log").collect()] == [(0, "20240105", "bob")]


def test_confs(spark):
    good = "<configuration><property><name>a</name><value> 1</value></property><property><name>e</name><value></value></property><property><name>a</name><value>2</value></property></configuration>"
    rows = spark.createDataFrame([("/c/daily/q/2024/0105/job_1_2_conf.xml", good), ("/x/job_3_4.xml", "<configuration><prop"), ("/x/none.xml", good)], "path string, value string")
    parsed = confs.parse_confs(logs.located(rows))
    assert [(r.cluster, r.job_id, r.configuration) for r in confs.accepted(parsed).collect()] == [("c", "job_1_2", {"a": "2", "e": ""})]
    assert {r.reason for r in confs.rejected(parsed).collect()} == {"malformed", "no_job_id"}


def test_cube(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 4), (None, "x", 8)], "d string, e string, v long")
    cube = UsageCube.build(df, ["d", "e"], ["v"])
    assert dict(iter(cube.collapse_on("e"))) == {("a",): {"v": 3}, ("b",): {"v": 4}}
    assert sorted(cube.slice("a").df.collect()) == [("x", 1), ("y", 2)] and not cube.has_slice("z")
    both = cube.filter_on("e", lambda c: c == "x").collapse_on("e").df.collect()
    assert sorted(both) == [("a", 1), ("b", 4)]
    with pytest.raises(ValueError):
        cube.put(df.limit(1))
    assert sorted(cube.aggregate(df.filter("d = 'b'")).slice("b").df.collect()) == [("x", 8)]


def test_requests_and_days(spark):
    with pytest.raises(ValueError):
        query.Request("c", "nope", 0, 1, users=("u",))
    with pytest.raises(ValueError):
        query.Request("c", "cpuTotal", 0, 1)
    assert query.parse_users("b,a,,b") == ("b", "a") and len(metrics.METRICS) == 23 and len(metrics.LABELS) == 17
    today = dt.date(2024, 3, 2)
    assert runs.days(today, 2, 3) == ["20240301", "20240229", "20240228"]
    assert runs.to_process(today, 3, 1, {"20240301", "20240229"}) == ["20240301", "20240228"]


@pytest.mark.parametrize("name", ["per_user_dense", "axis_quarters", "top_n_others"])
def test_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_stream(spark, tmp_path):
    from cubeline.streaming.usage_stream import stream_usage

    rows = attempts(spark, [("t", str(k), "SUCCESS", 1 + k * H, 2 * H + k * H) for k in range(6)])
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream_usage(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", 1).awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("time_ms").agg(F.sum("started").alias("s")).collect()
    want = usage.hourly_usage(rows).groupBy("time_ms").agg(F.sum("started").alias("s")).collect()
    assert sorted(got) == sorted(want)


def _tree(root, layout):
    """Two clusters' logs and configurations of three days; layout: with or without the queue."""
    for cluster in ("alpha", "beta"):
        for md in ("0103", "0104", "0105"):
            folder = root / cluster / "daily" / layout / "2024" / md if layout else root / cluster / "daily" / "2024" / md
            folder.mkdir(parents=True)
            own = [x.replace("job_1_2", f"job_1_{md}").replace("task_1_2", f"task_1_{md}") for x in LINES]
            (folder / f"job_1_{md}.log").write_text("\n".join(own))
            (folder / f"job_1_{md}_conf.xml").write_text("<configuration><property><name>mapred.job.queue.name</name><value>q</value></property></configuration>")
            (folder / "job_9_9_conf.xml").write_text("<configuration><prop")


@pytest.mark.parametrize("layout, split", [("q", False), ("", True)])
def test_batch(spark, tmp_path, layout, split):
    _tree(tmp_path / "logs", layout)
    today, out = dt.date(2024, 1, 6), f"{tmp_path}/out"

    def rows():
        return sorted(map(tuple, spark.read.parquet(f"{out}/usage").select("cluster", "day", "user", "time_ms", "started", "status").collect()))

    first = runs.run_batch(spark, f"{tmp_path}/logs", out, today, 2, split=split)
    assert first == {"days": ["20240104", "20240105"], "rejects": [("attempt", "no_attempt_id", 4), ("attempt", "no_task", 4)], "confs_rejected": 4}
    held = rows()
    assert [r[:3] for r in held] == [(c, d, "bob") for c in ("alpha", "beta") for d in (20240104, 20240105)]
    assert runs.discover(spark, f"{out}/jobs") == [(c, d) for c in ("alpha", "beta") for d in ("20240104", "20240105")]
    assert spark.read.parquet(f"{out}/confs").count() == 4
    # nothing new: nothing is done; all again: nothing changes; a day more: only it is added
    assert runs.run_batch(spark, f"{tmp_path}/logs", out, today, 2, split=split)["days"] == []
    assert runs.run_batch(spark, f"{tmp_path}/logs", out, today, 2, incremental=False, split=split)["days"] == first["days"] and rows() == held
    assert runs.run_batch(spark, f"{tmp_path}/logs", out, today, 3, 1, split=split)["days"] == ["20240103", "20240105"]
    assert len(rows()) == 6 and rows()[1:3] == held[:2]
    nested = runs.read_jobs(spark, f"{out}/jobs", ["20240103"]).collect()
    assert [(j.cluster, j.user, len(j.tasks), [a.attempt_id for a in j.tasks[0].attempts]) for j in sorted(nested)] == [(c, "bob", 1, ["a0"]) for c in ("alpha", "beta")]
    assert runs.run_batch(spark, f"{tmp_path}/nothing", out, today, 2, incremental=False)["days"] == []


def test_batch_reads_the_logs_once(spark, tmp_path):
    _tree(tmp_path / "logs", "q")
    lines = logs.classify(logs.located(logs.read_lines(spark, f"{tmp_path}/logs/*/daily/*/2024/*/*log")))
    staged = runs.stage_lines(lines, f"{tmp_path}/staged")
    plan = runs.nested_jobs(staged)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and lines._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert all("PartitionFilters: [isnotnull(kind" in scan for scan in plan.split("FileScan parquet")[1:])


def test_logs_without_a_place(spark, tmp_path):
    (tmp_path / "job_1_2.log").write_text("\n".join(LINES))
    held, orphans = runs.attempts_from_lines(logs.classify(logs.located(logs.read_lines(spark, f"{tmp_path}/*.log"))))
    assert [(a.cluster, a.day, a.attempt_id, a.user) for a in held.collect()] == [(None, None, "a0", "bob")]
    assert [o.attempt_id for o in orphans.collect()] == ["orphan"]
    assert [u.user for u in runs.process_logs(spark, f"{tmp_path}/*.log").collect()] == ["bob"]


def test_split_lines_keep_their_order(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 50) for k in range(5000)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = logs.read_lines(spark, f"{tmp_path}/a.log", split=True)
        assert got.rdd.getNumPartitions() > 3
        assert [r.line for r in got.repartition(7).orderBy("path", "line_no").collect()] == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_task_ids_match_whole(spark):
    rows = [(f"/c/daily/q/2024/0105/x{k}.log", k, f'Task TASKID="{t}" TASK_TYPE="MAP" START_TIME="1" .') for k, t in enumerate(["task_1_2_m_0", "task_1_2_m_0_x", "xtask_1_2_m_0", "task_1_2_s_0"])]
    lines = logs.classify(logs.located(spark.createDataFrame(rows, "path string, line_no long, line string")))
    assert [t.task_id for t in logs.task_lines(lines).collect()] == ["task_1_2_m_0"]
    assert [(r.kind, r.reason) for r in logs.rejected_lines(lines).collect()] == [("task", "no_job_id")] * 3


def test_table_follows_its_files(spark, tmp_path):
    import os

    def write(name, n, mtime):
        path = f"{tmp_path}/in/{name}"
        spark.range(n).selectExpr("named_struct('user', concat('u', id)) as key", "named_struct('started', id) as value").coalesce(1).write.mode("overwrite").parquet(path)
        part = next(f for f in os.listdir(path) if f.startswith("part-"))
        for f in os.listdir(path):
            if f != part:
                os.remove(f"{path}/{f}")
        os.rename(f"{path}/{part}", f"{path}/part.parquet")
        os.utime(f"{path}/part.parquet", (mtime, mtime))

    def refresh():
        return runs.refresh(spark, f"{tmp_path}/in/*/*.parquet", f"{tmp_path}/table")

    def rows():
        found = spark.read.parquet(f"{tmp_path}/table/rows").groupBy("file_name").count().collect()
        return {r.file_name.split("/")[-2]: r["count"] for r in found}

    write("a", 3, 1000)
    write("b", 4, 1000)
    assert refresh() == {"unprocessed": 2} and rows() == {"a": 3, "b": 4}
    assert refresh() == {"processed": 2}
    write("b", 5, 2000)
    write("c", 1, 2000)
    os.remove(f"{tmp_path}/in/a/part.parquet")
    assert refresh() == {"deleted": 1, "modified": 1, "unprocessed": 1} and rows() == {"b": 5, "c": 1}
    assert spark.read.parquet(f"{tmp_path}/table/rows").columns == ["user", "started", "file_name", "file_key"]


def test_confs_of_whole_files(spark, tmp_path):
    _tree(tmp_path, "q")
    (tmp_path / "alpha" / "daily" / "q" / "2024" / "0105" / "_hidden_job_5_5.xml").write_text("x")
    parsed = confs.read_confs(spark, f"{tmp_path}/*/daily/*/2024/0105/*xml")
    assert sorted((c.cluster, c.day, c.job_id) for c in confs.accepted(parsed).collect()) == [("alpha", "20240105", "job_1_0105"), ("beta", "20240105", "job_1_0105")]
    assert {r.reason for r in confs.rejected(parsed).collect()} == {"malformed"} and confs.rejected(parsed).count() == 2


def test_days_and_pages(spark):
    assert runs.is_forced("20240301", dt.date(2024, 3, 2), 2) and not runs.is_forced("20240228", dt.date(2024, 3, 2), 2)
    assert runs.log_globs("r", ["20240301"]) == ["r/*/daily/*/2024/0301/*log"]
    r = query.Request("alpha", "minutesTotal", 1_704_412_800_000, 1_706_227_200_000, users=("u",), day_margin=1)
    usage_ = spark.createDataFrame([("alpha", "u", 1_705_000_000_000, "20240111", 5.0), ("alpha", "u", 1_705_000_000_000, "20200101", 7.0)], "cluster string, user string, time_ms long, day string, elapsed_minutes double")
    plan = query._sums(usage_, r, ["u"])
    assert [x.value for x in plan.collect()] == [5.0]
    from cubeline.plans import present

    series = spark.createDataFrame([(u, t, v) for u, t, v in [("a", 1, 60.0), ("a", 2, 60.0), ("b", 1, 600.0), ("b", 2, 0.0), ("c", 1, 6.0), ("c", 2, 6.0)]], "user string, time_ms long, value double")
    drawn = present.graph_series(series, "minutesTotal", aggregate_selected=True).collect()
    assert [(x.position, x.user, x.time_ms, round(x.value, 2), x.disabled) for x in drawn] == [(0, "3 users", 1, 11.1, False), (0, "3 users", 2, 1.1, False)]
    drawn = present.graph_series(series.limit(0), "minutesTotal", series.filter("user = 'a'").select("time_ms", "value"), 4).collect()
    assert [(x.user, x.disabled) for x in drawn] == [("4 users", False)] * 2
    pages = [[x.user for x in present.last_periods(series, "minutesTotal", 1, 2, k).collect()] for k in (0, 2)]
    assert pages == [["b", "a"], ["c"]]
    assert [x.user for x in present.last_periods(series, "minutesTotal", 2, order=1).collect()] == ["a", "c", "b"]

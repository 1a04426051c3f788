"""Streams equal their batch twins; a restart resumes from the checkpoint."""

import os

from pyspark.sql import functions as F

from cohortlens.operators import distribution as Q
from cohortlens.operators import users as R
from cohortlens.plans import views
from cohortlens.sources import storage
from cohortlens.streaming import stream as W

SF = "/root/testdata/sf0.001"


def _source(spark, root):
    lg = views.log(spark, SF)
    first = F.col("timestamp") < F.lit("2024-01-04").cast("timestamp_ntz")
    lg.filter(first).write.parquet(os.path.join(root, "src", "b0"))
    return lg, first


def _stream(spark, root, schema, max_files=None):
    r = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(os.path.join(root, "src"))


def test_score_stream_restart_equals_batch(spark, tmp_dir):
    lg, first = _source(spark, tmp_dir)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    W.start_score(_stream(spark, tmp_dir, lg.schema), out, ck).awaitTermination()
    n1 = spark.read.parquet(out).count()
    lg.filter(~first).write.parquet(os.path.join(tmp_dir, "src", "b1"))
    W.start_score(_stream(spark, tmp_dir, lg.schema), out, ck).awaitTermination()
    got = spark.read.parquet(out)
    want = W.score_submissions(lg)
    assert n1 < got.count() == want.count()
    assert got.select("event_id", "bmi", "index").exceptAll(want.select("event_id", "bmi", "index")).count() == 0


def test_percentile_stream_equals_batch(spark, tmp_dir):
    lg, first = _source(spark, tmp_dir)
    lg.filter(~first).write.parquet(os.path.join(tmp_dir, "src", "b1"))
    pop = views.population(spark, SF)
    table = W.percentile_snapshot(pop, "BMI", n_buckets=6)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    scored = W.score_submissions(_stream(spark, tmp_dir, lg.schema, max_files=1))
    W.start_percentile(scored, table, out, ck).awaitTermination()
    res = spark.read.parquet(out)
    assert res.select("as_of").distinct().count() == 1          # one population snapshot
    got = {r.event_id: (r.percentile, r.below) for r in res.collect()}
    want = {r.event_id: (r.percentile, r.below) for r in
            Q.percentile_many(pop, "BMI", W.score_submissions(lg), "bmi").collect()}
    assert got == want


def test_latest_stream_equals_batch(spark, tmp_dir):
    lg, first = _source(spark, tmp_dir)
    lg.filter(~first).write.parquet(os.path.join(tmp_dir, "src", "b1"))
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    sub = _stream(spark, tmp_dir, lg.schema, max_files=1).withColumnRenamed("timestamp", "ts")
    cols = ["user_id", "event_id", "ts", "height_cm", "weight_kg"]
    W.start_latest(sub.select(*cols), out, ck).awaitTermination()
    got = {r.user_id: r.event_id for r in W.read_latest(spark, out).collect()}
    batch = R.latest(lg.withColumnRenamed("timestamp", "ts").select(*cols), "user_id", ["ts", "event_id"])
    assert got == {r.user_id: r.event_id for r in batch.collect()}


def test_category_counts_stream(spark, tmp_dir):
    lg, first = _source(spark, tmp_dir)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    scored = W.score_submissions(_stream(spark, tmp_dir, lg.schema))
    W.start_category_counts(scored, out, ck, ts="timestamp").awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() > 0
    mx = lg.filter(first).agg(F.max("timestamp")).first()[0]
    assert got.filter(F.col("window_end") > F.lit(mx)).count() == 0


def test_category_counts_independent_of_session_zone(spark, tmp_dir):
    import __spark_entry__ as E  # noqa: F401 - registers the package path

    lg, first = _source(spark, tmp_dir)
    old = spark.conf.get("spark.sql.session.timeZone")
    results = []
    try:
        for i, zone in enumerate(("UTC", "America/Los_Angeles")):
            spark.conf.set("spark.sql.session.timeZone", zone)
            out, ck = os.path.join(tmp_dir, f"out{i}"), os.path.join(tmp_dir, f"ck{i}")
            scored = W.score_submissions(_stream(spark, tmp_dir, lg.schema))
            W.start_category_counts(scored, out, ck, ts="timestamp").awaitTermination()
            results.append(sorted(tuple(r) for r in spark.read.parquet(out).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert results[0] == results[1] and results[0]
    assert all(r[0].hour == 0 for r in results[0])  # day windows start at UTC midnight


def test_late_rows_beyond_watermark_are_dropped(spark, tmp_dir):
    import datetime as dt

    src = os.path.join(tmp_dir, "src")
    schema = "ts timestamp_ntz, category string"
    spark.createDataFrame([(dt.datetime(2024, 1, 5, 12), "a"), (dt.datetime(2024, 1, 1, 12), "a")],
                          schema).coalesce(1).write.parquet(os.path.join(src, "b0"))
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    W.start_category_counts(spark.readStream.schema(schema).option("recursiveFileLookup", True)
                            .parquet(src), out, ck, ts="ts").awaitTermination()
    # a row for 2 Jan arrives after the watermark passed 5 Jan 11:00: dropped
    spark.createDataFrame([(dt.datetime(2024, 1, 2, 12), "a"), (dt.datetime(2024, 1, 7, 12), "a")],
                          schema).coalesce(1).write.parquet(os.path.join(src, "b1"))
    W.start_category_counts(spark.readStream.schema(schema).option("recursiveFileLookup", True)
                            .parquet(src), out, ck, ts="ts").awaitTermination()
    got = {r.window_start.day: r.n for r in spark.read.parquet(out).collect()}
    assert got == {1: 1, 5: 1}


def test_latest_sink_replay_is_idempotent(spark, tmp_dir):
    lg, first = _source(spark, tmp_dir)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    cols = ["user_id", "event_id", "ts", "height_cm", "weight_kg"]
    sub = _stream(spark, tmp_dir, lg.schema).withColumnRenamed("timestamp", "ts").select(*cols)
    W.start_latest(sub, out, ck).awaitTermination()
    before = {tuple(r) for r in W.read_latest(spark, out).collect()}
    # replay batch 0 by hand, as a retried micro-batch would
    W.latest_updates(lg.filter(first).withColumnRenamed("timestamp", "ts").select(*cols)) \
        .write.mode("overwrite").parquet(os.path.join(out, "batch_id=0"))
    assert {tuple(r) for r in W.read_latest(spark, out).collect()} == before
    assert spark.read.parquet(out).count() == len(before)


def test_percentile_stream_restart_keeps_its_snapshot(spark, tmp_dir):
    lg, first = _source(spark, tmp_dir)
    pop = views.population(spark, SF)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    W.start_percentile(W.score_submissions(_stream(spark, tmp_dir, lg.schema)), W.percentile_snapshot(pop, "BMI"),
                       out, ck).awaitTermination()
    lg.filter(~first).write.parquet(os.path.join(tmp_dir, "src", "b1"))
    grown = pop.union(pop.withColumn("BMI", F.col("BMI") + 3))   # ignored on restart
    W.start_percentile(W.score_submissions(_stream(spark, tmp_dir, lg.schema)), W.percentile_snapshot(grown, "BMI"),
                       out, ck).awaitTermination()
    res = spark.read.parquet(out)
    assert res.count() == lg.count() and res.select("as_of").distinct().count() == 1
    want = {r.event_id: (r.percentile, r.below) for r in
            Q.percentile_many(pop, "BMI", W.score_submissions(lg), "bmi").collect()}
    assert {r.event_id: (r.percentile, r.below) for r in res.collect()} == want


def test_half_written_snapshot_is_written_anew(spark, tmp_dir):
    lg, _ = _source(spark, tmp_dir)
    pop = views.population(spark, SF)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    W.write_snapshot(W.percentile_snapshot(pop.limit(3), "BMI"), os.path.join(ck, "population-snapshot"))
    os.remove(os.path.join(ck, "population-snapshot", "steps", "_SUCCESS"))
    W.start_percentile(W.score_submissions(_stream(spark, tmp_dir, lg.schema)), W.percentile_snapshot(pop, "BMI"),
                       out, ck).awaitTermination()
    assert spark.read.parquet(out).filter("percentile > 0 and percentile < 100").count() > 0


def _garbled(path, but):
    """Overwrite every data file of the snapshot but those of the given bucket folders."""
    kept = 0
    for folder in os.listdir(path):
        for name in os.listdir(os.path.join(path, folder)) if folder.startswith("bucket=") else ():
            if not name.endswith(".parquet"):
                continue
            if folder in but:
                kept += 1
                continue
            with open(os.path.join(path, folder, name), "wb") as f:
                f.write(b"not a parquet file")
    return kept


def test_a_probe_reads_its_own_bucket_only(spark, tmp_dir):
    pop = spark.range(5000).selectExpr("cast(id % 1000 as double) as v")
    path = os.path.join(tmp_dir, "snap")
    W.write_snapshot(W.percentile_snapshot(pop, "v"), path, bucket_rows=50)
    steps, edges = W.open_snapshot(spark, path)
    buckets = sorted(r.bucket for r in steps.select("bucket").distinct().collect())
    assert 15 <= len(buckets) <= 25 and steps.count() == 1000
    probes = spark.createDataFrame([(1, 512.0), (2, 512.5), (3, None)], "id int, p double")
    ranked = W.rank_stored(probes, "p", steps, edges)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("dynamicpruningexpression(bucket") == 1 and plan.count("ReadSchema: struct<value") == 1
    own = {f"bucket={r.bucket}" for r in steps.filter("value = 512").select("bucket").collect()}
    assert len(own) == 1
    assert _garbled(os.path.join(path, "steps"), own) == 1  # one file of one bucket is left
    got = {r.id: (r.percentile, r.below, r.above) for r in ranked.collect()}
    le, lt = 100.0 * (2565 / 5000), 100.0 * (2560 / 5000)
    assert got == {1: (le, lt, 100.0 - lt), 2: (le, le, 100.0 - le), 3: (None, None, None)}


def test_stored_ranks_equal_brute_force_at_the_edges(spark, tmp_dir):
    values = [float(v) for v in (3, 3, 5, 7, 7, 7, 9, 11)] + [float("inf"), float("nan"), -4.0]
    pop = spark.createDataFrame([(v,) for v in values], "v double")
    for rows in (1, 2, 1000):
        path = os.path.join(tmp_dir, f"snap{rows}")
        W.write_snapshot(W.percentile_snapshot(pop, "v"), path, bucket_rows=rows)
        asked = [-10.0, -4.0, 0.0, 3.0, 4.0, 7.0, 8.0, 11.0, 12.0, float("inf"), float("nan")]
        probes = spark.createDataFrame(list(enumerate(asked)), "id int, p double")
        got = {r.id: (r.percentile, r.below) for r in W.rank_stored(probes, "p", *W.open_snapshot(spark, path)).collect()}
        key = [(v != v, v) for v in values]  # NaN sorts last
        want = {i: (100.0 * (sum(k <= (p != p, p) or (k[0] and p != p) for k in key) / len(values)),
                    100.0 * (sum(k[0] < (p != p) or (not k[0] and p == p and k[1] < p) for k in key) / len(values)))
                for i, p in enumerate(asked)}
        assert got == want
    empty = os.path.join(tmp_dir, "none")
    W.write_snapshot(W.percentile_snapshot(pop.limit(0), "v"), empty)
    assert [r.percentile for r in W.rank_stored(probes, "p", *W.open_snapshot(spark, empty)).collect()] == [None] * len(asked)


def test_null_probe_gets_a_null_rank(spark):
    snapshot = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "v double")
    snapshot = W.percentile_snapshot(snapshot, "v", 2)
    probes = spark.createDataFrame([(1, None), (2, 0.5), (3, 2.0), (4, 9.0)], "id int, p double")
    got = {r.id: r.percentile for r in W.rank_against(probes, "p", snapshot, 2).collect()}
    assert got == {1: None, 2: 0.0, 3: 100.0, 4: 100.0}


def _users(spark, path, batch_id, rows):
    spark.createDataFrame(rows, "user_id int, event_id int, ts timestamp_ntz, w double").write.mode("overwrite").parquet(
        os.path.join(path, f"batch_id={batch_id}"))


def _state(spark, path):
    return {r.user_id: (r.event_id, r.w) for r in W.read_latest(spark, path).collect()}


def test_compaction_keeps_the_rows_and_bounds_the_files(spark, tmp_dir):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    path, order, want = os.path.join(tmp_dir, "log"), ("ts", "event_id"), {}
    opened = None
    for n in range(12):
        rows = [(u, 100 * n + u, day + dt.timedelta(hours=n), float(n)) for u in range(n, n + 4)]
        _users(spark, path, n, rows)
        want |= {u: (e, w) for u, e, _, w in rows}
        folded = W.changelog.compact_if(spark, path, "user_id", order, 3)
        assert folded == (n in (3, 7, 11)) and _state(spark, path) == want
        if n == 3:
            opened, held = W.read_latest(spark, path), dict(want)
        if n == 7:  # a reader that opened the log before the second compaction goes on
            assert {r.user_id: (r.event_id, r.w) for r in opened.collect()} == held
    assert len([d for d in os.listdir(path) if d.startswith("batch_id=")]) == 4  # of the last generation
    assert len(os.listdir(os.path.join(path, "base", "parts"))) == 2
    files = len(W.read_latest(spark, path).inputFiles())
    assert files <= len(os.listdir(os.path.join(path, "base", "parts", os.listdir(os.path.join(path, "base", "parts"))[0])))
    # a batch that is replayed after it was folded in changes nothing
    _users(spark, path, 11, [(u, 1100 + u, day + dt.timedelta(hours=11), 11.0) for u in range(11, 15)])
    assert _state(spark, path) == want and W.changelog.compact(spark, path, "user_id", order) == 11


def test_killed_compaction_loses_nothing(spark, tmp_dir, monkeypatch):
    import datetime as dt

    path, order = os.path.join(tmp_dir, "log"), ("ts", "event_id")
    for n in range(3):
        _users(spark, path, n, [(1, n, dt.datetime(2024, 1, 1 + n), float(n)), (10 + n, n, dt.datetime(2024, 1, 1), 0.0)])
    before = _state(spark, path)
    real = storage.publish

    def killed(df, root, name, write):
        write(df, os.path.join(root, "parts", f"{name}-dead"))  # the base is written, its commit is not
        raise KeyboardInterrupt

    monkeypatch.setattr(storage, "publish", killed)
    try:
        W.changelog.compact(spark, path, "user_id", order)
    except KeyboardInterrupt:
        pass
    assert _state(spark, path) == before
    monkeypatch.setattr(storage, "publish", real)
    half = os.path.join(path, "batch_id=3")  # and a batch that did not run to its end does not count
    _users(spark, path, 3, [(1, 99, dt.datetime(2025, 1, 1), 9.0)])
    os.remove(os.path.join(half, "_SUCCESS"))
    assert _state(spark, path) == before and W.changelog.compact(spark, path, "user_id", order) == 2
    assert _state(spark, path) == before
    _users(spark, path, 3, [(1, 99, dt.datetime(2025, 1, 1), 9.0)])
    W.changelog.compact(spark, path, "user_id", order)
    assert _state(spark, path) == before | {1: (99, 9.0)}
    assert not [p for p in os.listdir(os.path.join(path, "base", "parts")) if p.endswith("dead")]  # swept


def test_latest_stream_compacts_as_it_goes(spark, tmp_dir):
    lg, first = _source(spark, tmp_dir)
    lg.filter(~first).repartition(4).write.parquet(os.path.join(tmp_dir, "src", "b1"))
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    cols = ["user_id", "event_id", "ts", "height_cm", "weight_kg"]
    sub = _stream(spark, tmp_dir, lg.schema, max_files=1).withColumnRenamed("timestamp", "ts").select(*cols)
    W.start_latest(sub, out, ck, compact_after=1).awaitTermination()
    assert os.path.isdir(os.path.join(out, "base", "commits"))
    got = {r.user_id: r.event_id for r in W.read_latest(spark, out).collect()}
    batch = R.latest(lg.withColumnRenamed("timestamp", "ts").select(*cols), "user_id", ["ts", "event_id"])
    assert got == {r.user_id: r.event_id for r in batch.collect()}


def test_state_partitions_fixed_at_first_start(spark, tmp_dir):
    lg, first = _source(spark, tmp_dir)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    cols = ["user_id", "event_id", "ts", "height_cm", "weight_kg"]
    sub = _stream(spark, tmp_dir, lg.schema).withColumnRenamed("timestamp", "ts").select(*cols)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    W.start_latest(sub, out, ck, state_partitions=3).awaitTermination()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    state = os.path.join(ck, "state", "0")
    assert sorted(d for d in os.listdir(state) if d.isdigit()) == ["0", "1", "2"]

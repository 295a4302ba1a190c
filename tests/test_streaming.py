from gleaner.streaming import progress


def test_windows_and_repeats(spark, tmp_path):
    rows = [
        (1, 7, "crawl", 10.0, "2024-01-01 00:01:00"), (1, 7, "crawl", 10.0, "2024-01-01 00:01:00"),
        (2, 7, "crawl", 50.0, "2024-01-01 00:02:00"), (1, 7, "audit", 90.0, "2024-01-01 00:07:00"),
    ]
    spark.createDataFrame(rows, "job_id long, domain long, stage string, percent double, at string").selectExpr(
        "job_id", "domain", "stage", "percent", "cast(at as timestamp) at",
    ).coalesce(1).write.json(str(tmp_path / "in"))
    stream = progress.windowed(progress.once_each(progress.progress_source(spark, str(tmp_path / "in"))), late=None)
    done = stream.writeStream.format("memory").queryName("seen").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c"),
    ).trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert done.exception() is None
    batch = progress.windowed(
        spark.read.schema(progress.SCHEMA).json(str(tmp_path / "in")).dropDuplicates(["job_id", "stage", "percent"]), late=None,
    )
    got = {(str(r["start"]), r["stage"]): (r["events"], r["furthest"]) for r in batch.collect()}
    assert got == {("2024-01-01 00:00:00", "crawl"): (2, 50.0), ("2024-01-01 00:05:00", "audit"): (1, 90.0)}


def test_jobs_to_their_end(spark, tmp_path):
    """Done, failed and lost jobs; repeated, late and further events after the end."""
    from gleaner.streaming import jobs

    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": "1",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    batches = [
        [
            (1, "crawl", 10.0, at(1)), (1, "crawl", 10.0, at(1)), (2, "crawl", 20.0, at(1)), (3, "audit", 50.0, at(2)),
            (1, "audit", 60.0, at(3)),
        ],
        [(1, "crawl", 30.0, at(2)), (1, "done", 100.0, at(5)), (2, "error", 40.0, at(4)), (3, "audit", 40.0, at(1))],
        [(1, "crawl", 5.0, at(6)), (2, "done", 100.0, at(7)), (4, "crawl", 1.0, at(59))], [(5, "crawl", 1.0, "2024-01-01 03:00:00")],
        [(6, "crawl", 1.0, "2024-01-01 06:00:00")],
    ]
    schema = "job_id long, domain long, stage string, percent double, at string"
    for k, rows in enumerate(batches):
        spark.createDataFrame([(j, 7, s, p, t) for j, s, p, t in rows], schema).selectExpr("job_id", "domain", "stage", "percent", "cast(at as timestamp) at").coalesce(1).write.mode("append").json(str(tmp_path / f"b{k}"))
    (tmp_path / "in").mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    for k in range(len(batches)):
        for f in (tmp_path / f"b{k}").glob("part-*.json"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
        events = progress.progress_source(spark, str(tmp_path / "in"))
        done = jobs.outcomes(events).writeStream.format("json").option("path", out).option(
            "checkpointLocation", checkpoint,
        ).outputMode("append").trigger(availableNow=True).start()
        done.awaitTermination(180)
        assert done.exception() is None
    got = {r["job_id"]: (r["outcome"], r["stage"], r["percent"]) for r in spark.read.schema(jobs.OUTCOME).json(out).collect()}
    assert spark.read.schema(jobs.OUTCOME).json(out).count() == len(got)
    assert got[1] == ("done", "done", 100.0) and got[2] == ("error", "error", 40.0) and got[3] == (
        "lost", "audit", 50.0,
    ) and got[4] == ("lost", "crawl", 1.0)
    assert 6 not in got
    for k, v in before.items():
        spark.conf.set(k, v)


def test_schedules_by_ticks(spark, tmp_path):
    """Each tick runs what is due then, once; a batch that is run again changes nothing."""
    from gleaner.sources import sinks
    from gleaner.streaming import scheduler

    table, runs = str(tmp_path / "schedules"), str(tmp_path / "runs")
    rows = [
        (1, "daily", True, None, 0), (2, "weekly", True, "2024-01-03 00:00:00", 0), (3, "daily", False, None, 0),
        (4, "monthly", True, "2024-01-01 00:00:00", 0),
    ]
    first = spark.createDataFrame(rows, "id int, frequency string, enabled boolean, t string, version int").selectExpr(
        "id", "frequency", "enabled", "cast(t as timestamp) next_run_at", "version",
    )
    sinks.upsert_table(spark, table, first, "id", "version")
    ticks = str(tmp_path / "ticks")
    for k, t in enumerate(("2024-01-01 00:00:00", "2024-01-01 00:01:00", "2024-01-02 00:00:00", "2024-01-03 12:00:00")):
        spark.createDataFrame([(t,)], "t string").selectExpr("cast(t as timestamp) tick").coalesce(1).write.mode("append").json(ticks)
        stream = spark.readStream.schema("tick timestamp").option("maxFilesPerTrigger", 1).json(ticks)
        done = scheduler.on_ticks(stream, table, runs).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        done.awaitTermination(120)
        assert done.exception() is None
        if k == 2:
            scheduler.advance(spark, table, runs, t, 2)  # once more
    started = sorted((r["id"], str(r["started_at"])) for r in spark.read.parquet(runs).collect())
    assert started == [
        (1, "2024-01-01 00:00:00"), (1, "2024-01-02 00:00:00"), (1, "2024-01-03 12:00:00"), (2, "2024-01-03 12:00:00"),
        (4, "2024-01-01 00:00:00"),
    ]
    assert {r["id"]: str(r["next_run_at"]) for r in spark.read.parquet(table).collect()} == {
        1: "2024-01-04 12:00:00", 2: "2024-01-10 12:00:00", 3: "None", 4: "2024-01-31 00:00:00",
    }

from factloom.streaming import events as E

SCHEMA = "event_id long, document_id long, stage string, progress long, sequence long, arrival long"
DATA = [(1, 1, "validating", 10, 1, 1), (2, 1, "chunking", 30, 3, 2), (3, 1, "extracting", 20, 2, 3), (4, 1, "done", 100, 9, 4), (5, 1, "done", 100, 9, 5), (6, 2, "failed", 0, 4, 1)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(DATA, SCHEMA)
    batch = {r.event_id for r in E.merge_monotonic(df).collect()}
    assert batch == {1, 2, 4, 6}
    for i, part in enumerate((df.filter("arrival <= 2"), df.filter("arrival > 2"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            query = E.merge_stream(stream).writeStream.format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
    query.stop()
    assert {r.event_id for r in spark.table("merged").collect()} == batch


def test_state_recovery_and_queue(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    got = {r.document_id: (r.stage, r.progress, r.status) for r in E.current_state(df).collect()}
    assert got == {1: ("done", 100, "done"), 2: ("failed", 0, "failed")}
    assert E.recover(df.filter("arrival < 3"), df).count() == 6
    jobs = spark.createDataFrame([(1, "queued", 3, 1), (2, "queued", 0, 3), (3, "done", 0, 0), (4, "queued", 1, 2)], "job_id int, status string, attempts int, created_at int")
    assert E.next_job(jobs).first().job_id == 4


def test_events_that_arrive_at_once_come_by_id(spark):
    rows = [(i, 1, "chunking", 30, i, 5) for i in (4, 2, 5, 1, 3)] + [(9, 1, "done", 100, 9, 6), (10, 1, "done", 100, 8, 6)]
    for dealt in (rows, rows[::-1]):
        assert sorted(r.event_id for r in E.merge_monotonic(spark.createDataFrame(dealt, SCHEMA)).collect()) == [1, 2, 3, 4, 5, 9]

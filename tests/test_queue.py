from concurrent.futures import ThreadPoolExecutor

from factloom.streaming.queue import JobQueue

SCHEMA = "job_id long, created_at long, attempts int"


def held(df):
    return sorted(r.job_id for r in df.collect())


def test_leases_return_and_late_workers_settle_nothing(spark, tmp_path):
    queue = JobQueue(spark, str(tmp_path / "q"))
    queue.create(spark.createDataFrame([(1, 5, 0), (2, 3, 2), (3, 3, None), (4, 1, 3)], SCHEMA), buckets=2)
    first = queue.claim("a", now=0, lease=10, count=2)
    assert held(first) == [2, 3]
    assert held(queue.claim("b", now=5, lease=50, count=9)) == [1]
    again = queue.claim("b", now=10, lease=50, count=9)
    assert held(again) == [3]
    queue.settle(first, now=11)
    queue.settle(again, now=12)
    queue.give_up(now=12)
    got = {r.job_id: (r.status, r.worker, r.attempts) for r in queue.jobs().collect()}
    assert got == {1: ("held", "b", 1), 2: ("failed", "a", 3), 3: ("done", "b", 2), 4: ("queued", None, 3)}
    assert held(queue.claim("c", now=12, lease=1)) == []


def test_two_workers_never_hold_one_job(spark, tmp_path):
    queue = JobQueue(spark, str(tmp_path / "q"))
    queue.create(spark.createDataFrame([(i, i % 3, 0) for i in range(8)], SCHEMA), buckets=2)

    def work(name):
        own, mine = JobQueue(spark, str(tmp_path / "q")), []
        while jobs := held(own.claim(name, now=0, lease=100, count=2)):
            mine += jobs
        return mine

    with ThreadPoolExecutor(2) as pool:
        taken = [j for mine in pool.map(work, ("a", "b")) for j in mine]
    assert sorted(taken) == list(range(8))
    assert all(r.attempts == 1 for r in queue.jobs().collect())


def test_stream_feeds_the_queue_once(spark, tmp_path):
    queue = JobQueue(spark, str(tmp_path / "q"))
    queue.create(spark.createDataFrame([], SCHEMA), buckets=2)
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, 0, 0)], SCHEMA).coalesce(1).write.parquet(folder)
    for checkpoint in ("one", "two"):
        stream = queue.feed(spark.readStream.schema(SCHEMA).parquet(folder), str(tmp_path / checkpoint))
        stream.processAllAvailable()
        stream.stop()
    assert held(queue.jobs()) == [1, 2]

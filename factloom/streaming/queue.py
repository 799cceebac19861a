"""A queue of jobs with leases, which many workers claim from at once.

The queue is a versioned table. A claim reads the newest version, picks the oldest jobs that are free and commits them
as held on top of that very version; if another worker committed in between, nothing is written and the claim is made
again. So a job has one holder at a time, and a worker that dies gives its jobs back when their lease runs out.
Times are whole numbers of any unit that all workers share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.sources.versioned import VersionConflict, VersionedTable

COLUMNS = {"job_id": "long", "created_at": "long", "attempts": "int", "status": "string", "claim": "string", "worker": "string", "lease_until": "long"}


class JobQueue:
    """A queue under `path`. A job (job_id, created_at, attempts) is queued, held, done or failed.

    A job whose attempts are used up can't be claimed; null attempts count as none. Jobs of one creation time are
    taken in order of their id.
    """

    def __init__(self, spark: SparkSession, path: str, most_attempts: int = 3, tries: int = 50):
        self.held, self.most, self.tries = VersionedTable(spark, path), most_attempts, tries

    def create(self, jobs: DataFrame, buckets: int = 16) -> int:
        return self.held.create(self._queued(jobs), "job_id", buckets)

    @staticmethod
    def _queued(jobs: DataFrame) -> DataFrame:
        given = {"attempts": F.coalesce("attempts", F.lit(0)), "status": F.lit("queued"), "claim": F.lit(None), "worker": F.lit(None), "lease_until": F.lit(None)}
        return jobs.select(*[given.get(c, F.col(c)).cast(t).alias(c) for c, t in COLUMNS.items()])

    def _commit(self, change) -> int | None:
        """Commits change(rows of the newest version) on top of that version, again after each conflict."""
        for _ in range(self.tries):
            version = self.held.manifest().version
            rows = change(self.held.snapshot(version))
            try:
                return self.held.merge(rows.select(*COLUMNS), onto=version)
            except VersionConflict:
                continue
        raise VersionConflict(f"{self.held.path}: another worker was faster {self.tries} times")

    def add(self, jobs: DataFrame) -> int:
        """Queues jobs whose id is new; a batch added again adds nothing."""
        fresh = self._queued(jobs).dropDuplicates(["job_id"])
        return self._commit(lambda rows: fresh.join(rows.select("job_id"), "job_id", "left_anti"))

    def feed(self, jobs: DataFrame, checkpoint: str) -> StreamingQuery:
        """Queues the jobs of a stream, a micro-batch at a time; a batch run again after a fault adds nothing."""
        return jobs.writeStream.foreachBatch(lambda batch, _: self.add(batch)).option("checkpointLocation", checkpoint).start()

    def claim(self, worker: str, now: int, lease: int, count: int = 1) -> DataFrame:
        """Up to `count` of the oldest free jobs, held by `worker` until now + lease; their `claim` settles them."""
        token = uuid.uuid4().hex
        lapsed = (F.col("status") == "held") & (F.col("lease_until") <= now)
        free = ((F.col("status") == "queued") | lapsed) & (F.col("attempts") < self.most)
        taken = {"attempts": F.col("attempts") + 1, "status": F.lit("held"), "claim": F.lit(token), "worker": F.lit(worker), "lease_until": F.lit(now + lease).cast("long")}
        version = self._commit(lambda rows: rows.filter(free).orderBy("created_at", "job_id").limit(count).withColumns(taken))
        return self.held.snapshot(version).filter(F.col("claim") == token)

    def settle(self, claimed: DataFrame, now: int, status: str = "done") -> int:
        """Sets the status of claimed jobs (job_id, claim) that are still held under that claim and lease; others,
        which may have another holder by now, stay as they are."""
        own = claimed.select("job_id", "claim").distinct()
        return self._commit(lambda rows: rows.join(own, ["job_id", "claim"], "left_semi").filter((F.col("status") == "held") & (F.col("lease_until") > now)).withColumn("status", F.lit(status)))

    def give_up(self, now: int) -> int:
        """Fails jobs whose lease ran out on their last attempt."""
        return self._commit(lambda rows: rows.filter((F.col("status") == "held") & (F.col("lease_until") <= now) & (F.col("attempts") >= self.most)).withColumn("status", F.lit("failed")))

    def jobs(self) -> DataFrame:
        return self.held.snapshot()

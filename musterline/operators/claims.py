"""Exclusive claims on events: two workers never hold one event, and a dead worker's claims come back.

A claim is a file named after the event, created only if it is absent, which the file system decides for one
worker alone; the folder must lie on one that does so (HDFS and local disks do). A claim lasts for a lease. A worker
that finds an older one moves it aside, which again only one worker can, and then claims like any other. What is done
goes into a table of consumed events, and its claim files go.

Claims in flight are few: at most a batch for every worker. Consumed events are many and stay a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONSUMED = "event_id string, worker string, consumed_at timestamp"
ASIDE = ".expired-"


class ClaimLedger:
    """The claims and the consumed events below one shared ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, lease_seconds: float = 300.0) -> None:
        self.spark, self.folder, self.lease = spark, folder.rstrip("/"), lease_seconds
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._now = jvm.java.lang.System.currentTimeMillis
        for name in ("claims", "consumed"):
            self._fs.mkdirs(self._path(f"{self.folder}/{name}"))

    def _file(self, event_id: str):
        return self._path(f"{self.folder}/claims/{quote(event_id, safe='')}")

    def held(self) -> dict[str, bool]:
        """The claims in flight, and whether their lease has run out."""
        found, now = {}, self._now()
        for status in self._fs.listStatus(self._path(f"{self.folder}/claims")):
            name = status.getPath().getName()
            if ASIDE not in name:
                found[unquote(name)] = now - status.getModificationTime() > self.lease * 1000
        return found

    def consumed(self) -> DataFrame:
        return self.spark.read.schema(CONSUMED).parquet(f"{self.folder}/consumed")

    def _take(self, event_id: str, worker: str) -> bool:
        try:
            stream = self._fs.create(self._file(event_id), False)
        except Exception as refused:
            if "AlreadyExists" in str(refused):
                return False
            raise
        stream.write(bytearray(worker.encode()))
        stream.close()
        return True

    def _move_aside(self, event_id: str) -> None:
        """Takes an outlived claim away; of several workers that try, one does."""
        aside = self._path(f"{self.folder}/claims/{quote(event_id, safe='')}{ASIDE}{uuid.uuid4().hex}")
        if self._fs.rename(self._file(event_id), aside):
            self._fs.delete(aside, False)

    def claim(self, events: DataFrame, students: DataFrame, worker: str, batch_size: int = 100) -> DataFrame:
        """Up to ``batch_size`` of the oldest events that nobody has consumed or holds, with the university id;
        ``worker`` holds them now. Events another worker takes at the same moment are passed over."""
        mine: list[str] = []
        named = events.drop("university_id").join(students.select("student_id", "university_id"), "student_id")
        refused: set[str] = set()
        while len(mine) < batch_size:
            held = self.held()
            for event_id in [e for e, over in held.items() if over]:
                self._move_aside(event_id)
            taken = [e for e, over in held.items() if not over] + mine + sorted(refused)
            barred = self.spark.createDataFrame([(e,) for e in dict.fromkeys(taken)], "event_id string")
            barred = barred.union(self.consumed().select("event_id"))
            open_events = named.join(barred, "event_id", "left_anti").orderBy("frame_captured_at", "event_id")
            candidates = [r.event_id for r in open_events.select("event_id").limit(batch_size - len(mine)).collect()]
            if not candidates:
                break
            for event_id in candidates:
                (mine.append if self._take(event_id, worker) else refused.add)(event_id)
        # What was consumed between the look and the claim is given back.
        done = {r.event_id for r in self.consumed().filter(F.col("event_id").isin(mine)).collect()} if mine else set()
        self.release(done, worker)
        mine = [e for e in mine if e not in done]
        return named.filter(F.col("event_id").isin(mine)) if mine else named.limit(0)

    def _holds(self, event_id: str, worker: str) -> bool:
        if not self._fs.exists(self._file(event_id)):
            return False
        stream = self._fs.open(self._file(event_id))
        owner = bytes(stream.readAllBytes()).decode()
        stream.close()
        return owner == worker

    def release(self, event_ids: Iterable[str], worker: str) -> None:
        """Gives claims back; another worker's stay."""
        for event_id in event_ids:
            if self._holds(event_id, worker):
                self._fs.delete(self._file(event_id), False)

    def complete(self, event_ids: Iterable[str], worker: str) -> list[str]:
        """Marks claimed events as consumed. Those whose claim the worker has lost meanwhile are left out."""
        kept = [e for e in event_ids if self._holds(e, worker)]
        if kept:
            rows = self.spark.createDataFrame([(e, worker) for e in kept], "event_id string, worker string")
            rows = rows.withColumn("consumed_at", F.current_timestamp())
            rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/consumed")
        self.release(kept, worker)
        return kept

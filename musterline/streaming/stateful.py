"""The ordered folds as stateful streams, sharing their step functions with the batch folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from musterline.functions.scalars import event_id_for
from musterline.operators.debounce import DebounceStep
from musterline.operators.folds import Step
from musterline.operators.sampling import tick_length
from musterline.operators.tracking import FrameStep
from musterline.plans.identify import IdentifyStep
from musterline.settings import TrackingSettings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processor state lives in RocksDB, so it may exceed executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FoldProcessor(StatefulProcessor):
    """Runs a :class:`Step` with its state kept between micro-batches.

    Rows of a batch are put in order before they are folded; a frame must not be spread over two
    batches. Input columns must be plain values.
    """

    def __init__(self, step: Step, order: list[str], columns: list[str], output: StructType) -> None:
        self.step, self.order, self.columns, self.output = step, order, columns, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("state", "text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.kept.get()
        state = self.step.load(stored[0]) if stored else self.step.start()
        seat = {c: i for i, c in enumerate(self.columns)}
        order_at, reads_at = ([seat[c] for c in names] for names in (self.order, self.step.reads))
        # Missing numbers are nulls; in the order they come last.
        batch = [tuple(None if v != v else v for v in row) for row in rows]
        if len(batch) > 1:
            batch.sort(key=lambda row: [(row[i] is None, row[i] if row[i] is not None else 0) for i in order_at])
        made = Row(*self.output.names)
        for row in batch:
            for kept, extra in self.step.push(state, (row, tuple(row[i] for i in reads_at))):
                yield made(*kept, *extra)
        for kept, extra in self.step.close(state):
            yield made(*kept, *extra)
        self.kept.update((self.step.dump(state),))

    def close(self) -> None:
        pass


def stream_fold(rows: DataFrame, keys: list[str], order: list[str], step: Step) -> DataFrame:
    """The streaming counterpart of :func:`musterline.operators.folds.fold`."""
    output = StructType(rows.schema.fields + StructType.fromDDL(step.adds).fields)
    processor = FoldProcessor(step, order, rows.columns, output)
    return rows.groupBy(*keys).transformWithState(processor, output, "append", "none")


def stream_debounce(sightings: DataFrame, window_seconds: float) -> DataFrame:
    """Actions and event ids for a stream of sightings; each row keeps its own time order within
    a micro-batch, and batches are taken in order of arrival."""
    timed = sightings.withColumn("at", F.unix_micros("captured_at")).drop("captured_at")
    if "identity_changed" not in sightings.columns:
        timed = timed.withColumn("identity_changed", F.lit(False))
    keys = ["camera_id", "student_id"]
    folded = stream_fold(timed, keys, ["at", "sighting_id"], DebounceStep(window_seconds))
    event_id = event_id_for(*[F.col(c) for c in ("camera_id", "student_id", "emitted_at", "emitted_by")])
    return (
        folded.withColumn("event_id", event_id)
        .withColumn("captured_at", F.timestamp_micros("at"))
        .withColumn("emitted_at", F.timestamp_micros("emitted_at"))
        .drop("at", "emitted_by")
    )


def stream_tracks(detections: DataFrame, settings: TrackingSettings = TrackingSettings()) -> DataFrame:
    """Tracks of a stream of detections, named by the frame and face they started with."""
    boxes = detections.select("camera_id", "sequence", "det_idx", "box.*")
    return stream_fold(boxes, ["camera_id"], ["sequence", "det_idx"], FrameStep(settings))


def stream_decisions(judged: DataFrame, settings: TrackingSettings = TrackingSettings()) -> DataFrame:
    """The per-camera decisions of a stream of judged faces.

    ``judged`` has the flat columns that the batch fold reads: camera_id, sequence, det_idx, at
    (microseconds), x1, y1, x2, y2, passed, outcome, student_id, similarity. Gate and match need
    no history and run on the stream before this.
    """
    return stream_fold(judged, ["camera_id"], ["sequence", "det_idx"], IdentifyStep(settings))


class LatenessProcessor(StatefulProcessor):
    """Tells which rows of a key are older than ``allowed`` before the newest of the batches before. The state is
    that newest time; rows are passed on chunk by chunk and never held."""

    def __init__(self, at: str, allowed_us: int, output: StructType) -> None:
        self.at, self.allowed, self.output = at, allowed_us, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.newest.get()[0] if self.newest.exists() else None
        newest = before
        for chunk in rows:
            times = chunk[self.at].astype("datetime64[us, UTC]" if chunk[self.at].dt.tz else "datetime64[us]")
            micros = times.astype("int64").where(times.notna())
            late = micros < before - self.allowed if before is not None else micros.isna() & False
            if micros.notna().any():
                newest = int(micros.max()) if newest is None else max(newest, int(micros.max()))
            yield chunk.assign(late=late.fillna(False).astype(bool))[self.output.names]
        if newest is not None:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


def stream_lateness(rows: DataFrame, key: str, at: str, allowed_seconds: float) -> DataFrame:
    """``rows`` with the flag ``late``, in one pass: late rows are kept, for a sink of their own, where a watermark
    would drop them. A row without a time is never late."""
    output = StructType([*rows.schema.fields]).add("late", "boolean")
    processor = LatenessProcessor(at, round(allowed_seconds * 1_000_000), output)
    return rows.groupBy(key).transformWithStateInPandas(processor, output, "append", "none")


def stream_latest_per_tick(frames: DataFrame, fps: float, lateness: str = "10 seconds") -> DataFrame:
    """The newest frame per camera and tick. A tick is final once the watermark has passed it;
    frames that come later than ``lateness`` are dropped by the watermark; ``late_frames`` counts them."""
    newest = F.max_by(
        F.struct("sequence", "captured_at", "height", "width"), F.struct("captured_at", "sequence")
    )
    ticks = (
        frames.withWatermark("captured_at", lateness)
        .groupBy("camera_id", F.window("captured_at", tick_length(fps)).alias("tick"))
        .agg(newest.alias("_newest"), (F.count(F.lit(1)) - 1).alias("dropped"))
    )
    return ticks.select("camera_id", F.col("tick.start").alias("tick_start"), "_newest.*", "dropped")


def stream_frames_seen(frames: DataFrame) -> DataFrame:
    """How many frames of each camera have come, late ones too: one number of state per camera."""
    return frames.groupBy("camera_id").agg(F.count(F.lit(1)).alias("frames_seen"))


def late_frames(ticks: DataFrame, seen: DataFrame) -> DataFrame:
    """Frames per camera that came too late for any tick; both inputs as written in update mode, the
    last version of each row."""
    taken = ticks.groupBy("camera_id").agg(F.sum(F.col("dropped") + 1).alias("_taken"))
    late = F.col("frames_seen") - F.coalesce("_taken", F.lit(0))
    return seen.join(taken, "camera_id", "left").select("camera_id", "frames_seen", late.alias("late"))

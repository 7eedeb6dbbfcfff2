"""Sampling, tracking, de-duplication and identification, in batch and as replayed streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from musterline.catalog.registry import cameras, detections, query, rounded, with_faces
from musterline.catalog.scalar_queries import uuid_text
from musterline.catalog.walks import ALL_SHOTS, DECISIONS, INSIDE, LIVE_SHOTS, TRACKS
from musterline.cluster import scratch_path
from musterline.operators import profile as profiles
from musterline.operators import sampling, tracking
from musterline.operators.debounce import current_events, debounce
from musterline.operators.gate import roi_filter
from musterline.operators.ordering import previous_value
from musterline.plans.identify import decide_faces, identify, judge_faces
from musterline.settings import MatchingSettings, PipelineSettings, QualitySettings, SamplingSettings, TrackingSettings
from musterline.sources.events import unresolved_lines
from musterline.streaming import jobs, stateful

HOUR_FPS = 1 / 3600
MOVING = SamplingSettings(motion_gate_enabled=True)
DEBOUNCE_SECONDS = 86_400
CUT_ROWS = 200


@query(
    "P03_frame_stride",
    "SELECT camera_id, sequence FROM frames WHERE sequence % 3 = 0",
    ("frames",),
)
def frame_stride(g):
    return sampling.sample_frames(g.view("frames"), F.lit(9.0), 3.0).select("camera_id", "sequence")


@query(
    "P04_motion_gate",
    """, seen AS (SELECT *, lag(height) OVER w AS h, lag(width) OVER w AS v FROM frames
                  WINDOW w AS (PARTITION BY camera_id ORDER BY sequence))
       SELECT camera_id, sequence FROM seen WHERE h IS NULL OR h <> height OR v <> width OR changed_fraction >= 0.002""",
    ("frames",),
)
def motion_gate(g):
    return sampling.motion_gate(g.view("frames"), MOVING, frames_per_range=500).select("camera_id", "sequence")


_TICKS = """, ticks AS (SELECT camera_id, epoch_us(captured_at) // 3600000000 AS tick, max(sequence) AS sequence, count(*) - 1 AS dropped
                   FROM frames GROUP BY 1, 2)
       SELECT camera_id, make_timestamp(tick * 3600000000) AS tick_start, sequence, dropped FROM ticks"""


@query("P05_latest_per_tick", _TICKS, ("frames",))
def latest_per_tick(g):
    ticks = sampling.latest_per_tick(g.view("frames"), HOUR_FPS)
    return ticks.select("camera_id", "tick_start", "sequence", "dropped")


@query(
    "P06_frame_cap",
    """SELECT camera_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY sequence) AS place FROM frames)
       WHERE place <= 50""",
    ("frames",),
)
def frame_cap(g):
    return sampling.cap_frames(g.view("frames"), 50).select("camera_id", "sequence")


@query(
    "A15_stage_latency",
    """SELECT stage, count(*) AS samples, round(avg(ms), 6) AS mean_ms, max(ms) AS max_ms,
              round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms
       FROM stage_samples GROUP BY 1""",
    ("stage_samples",),
)
def stage_latency(g):
    summary = profiles.latency_summary(g.view("stage_samples"))
    return rounded(summary, "mean_ms", "p50_ms", "p95_ms")


def _clips(g):
    spans = g.view("frames").groupBy("camera_id").agg((F.max("sequence") + 1).alias("_frames"))
    return spans.select(
        "camera_id", F.lit(4.0).alias("native_fps"), (F.col("_frames") / 4.0).alias("duration_seconds")
    )


def _profile(g):
    return profiles.profile(g.view("frames"), detections(g), _clips(g))


_PROFILE = """, clips AS (SELECT camera_id, max(sequence) + 1 AS frames, (max(sequence) + 1) / 4.0e0 AS duration, count(*) AS n FROM frames GROUP BY 1),
  strided AS (SELECT f.*, c.duration, row_number() OVER (PARTITION BY f.camera_id ORDER BY sequence) AS place
    FROM frames f JOIN clips c ON f.camera_id = c.camera_id
    WHERE sequence % greatest(1, cast(round_even(4.0e0 / least(3.0e0, 20 / c.duration), 0) AS BIGINT)) = 0),
  seen AS (SELECT * FROM strided WHERE place <= 20),
  faces AS (SELECT s.camera_id, s.sequence, s.sequence / 4.0e0 AS offset_s, d.det_idx, d.y2 - d.y1 AS h, d.detector_score, d.blur_variance,
      d.has_landmarks, sqrt(pow(right_x - left_x, 2) + pow(right_y - left_y, 2)) AS eyes,
      abs(sqrt(pow(nose_x - left_x, 2) + pow(nose_y - left_y, 2)) - sqrt(pow(nose_x - right_x, 2) + pow(nose_y - right_y, 2))) AS uneven,
      abs(degrees(atan2(right_y - left_y, right_x - left_x))) AS roll
    FROM seen s LEFT JOIN detections d ON s.camera_id = d.camera_id AND s.sequence = d.sequence),
  judged AS (SELECT *, CASE WHEN has_landmarks THEN uneven / eyes END AS yaw,
      det_idx IS NOT NULL AND detector_score >= 0.6 AND h >= 100 AND blur_variance >= 45
        AND (NOT has_landmarks OR (uneven / eyes <= 0.45 AND roll <= 35)) AS passed FROM faces),
  profiled AS (SELECT camera_id, count(DISTINCT sequence) AS frames_sampled, count(DISTINCT sequence) FILTER (WHERE det_idx IS NOT NULL) AS frames_with_faces,
      count(det_idx) AS faces_total, count(*) FILTER (WHERE passed) AS faces_passed,
      min(offset_s) AS first_sample_at, max(offset_s) AS last_sample_at, median(h) AS h, median(blur_variance) AS blur, median(yaw) AS yaw,
      max(h) AS h_max, min(detector_score) AS score_min FROM judged GROUP BY 1)
"""


@query(
    "A17_F20_W08_clip_profile",
    _PROFILE
    + """SELECT c.camera_id, coalesce(frames_sampled, 0) AS frames_sampled, coalesce(frames_with_faces, 0) AS frames_with_faces,
           coalesce(faces_total, 0) AS faces_total, coalesce(faces_passed, 0) AS faces_passed, coalesce(faces_total - faces_passed, 0) AS faces_gated,
           printf('%.2fs - %.2fs (%.0f%% of the clip)', first_sample_at, last_sample_at,
             (last_sample_at - first_sample_at) / c.duration * 100) AS examined_span,
           first_sample_at, last_sample_at, round((last_sample_at - first_sample_at) / c.duration, 6) AS coverage,
           coalesce(s.sequence + 1, c.n) AS frames_decoded, round(h, 3) AS face_height_px_p50, round(h_max, 3) AS face_height_px_max,
           round(blur, 3) AS blur_variance_p50, round(yaw, 3) AS yaw_ratio_p50, round(score_min, 3) AS detector_score_min
         FROM clips c LEFT JOIN profiled p ON p.camera_id = c.camera_id LEFT JOIN strided s ON s.camera_id = c.camera_id AND s.place = 21""",
    ("frames", "detections"),
)
def clip_profile(g):
    summary = profiles.summarize(_profile(g))
    return rounded(summary, "coverage").select(
        "camera_id", "frames_sampled", "frames_with_faces", "faces_total", "faces_passed", "faces_gated",
        "first_sample_at", "last_sample_at", "coverage", "frames_decoded", "face_height_px_p50",
        "face_height_px_max", "blur_variance_p50", "yaw_ratio_p50", "detector_score_min", "examined_span",
    )


@query(
    "A19_clip_advice",
    _PROFILE
    + """, rules AS (SELECT c.camera_id, faces_total IS NOT NULL AND faces_total > 0 AS seen_faces, unnest([
           CASE WHEN frames_sampled IS NULL THEN 'no_frames' WHEN faces_total = 0 THEN 'no_faces' END,
           CASE WHEN seen_faces AND faces_passed = 0 THEN 'all_gated' END, CASE WHEN seen_faces AND h < 100 THEN 'faces_too_small' END,
           CASE WHEN seen_faces AND h >= 100 AND h < 130 THEN 'faces_barely_large_enough' END,
           CASE WHEN seen_faces AND blur < 45 THEN 'blurred' END, CASE WHEN seen_faces AND yaw > 0.45 THEN 'in_profile' END,
           CASE WHEN seen_faces AND last_sample_at - first_sample_at < c.duration * 0.9 THEN 'partly_examined' END,
           CASE WHEN seen_faces AND frames_with_faces < frames_sampled * 0.5 THEN 'faces_rare' END]) AS rule
         FROM clips c LEFT JOIN profiled p ON p.camera_id = c.camera_id)
         SELECT camera_id, rule FROM rules WHERE rule IS NOT NULL
         UNION ALL SELECT camera_id, 'usable' FROM rules GROUP BY camera_id HAVING count(rule) = 0""",
    ("frames", "detections"),
)
def clip_advice(g):
    return profiles.advice(_profile(g)).select("camera_id", "rule")


@query(
    "J03_consecutive_overlaps",
    """, pairs AS (SELECT a.camera_id, a.sequence, a.det_idx, b.det_idx AS next_det_idx,
           greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS shared,
           (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS sizes
         FROM detections a JOIN detections b ON a.camera_id = b.camera_id AND b.sequence = a.sequence + 1)
       SELECT camera_id, sequence, det_idx, next_det_idx, round(shared / (sizes - shared), 6) AS overlap FROM pairs
       WHERE shared / (sizes - shared) >= 0.3""",
    ("detections",),
)
def consecutive_overlaps(g):
    return rounded(tracking.consecutive_overlaps(detections(g)), "overlap")


_TRACKED = TRACKS + "SELECT camera_id, sequence, det_idx, track_id FROM tracked"


@query("G01_track_assignment_large_keys_cut", INSIDE + LIVE_SHOTS + _TRACKED, ("detections", "cameras"))
def track_assignment_cut(g):
    inside = roi_filter(detections(g), cameras(g))
    return tracking.assign_tracks(inside, max_rows=CUT_ROWS).select("camera_id", "sequence", "det_idx", "track_id")


@query("G01_track_assignment", INSIDE + LIVE_SHOTS + _TRACKED, ("detections", "cameras"))
def track_assignment(g):
    inside = roi_filter(detections(g), cameras(g))
    return tracking.assign_tracks(inside).select("camera_id", "sequence", "det_idx", "track_id")


@query(
    "G02_track_assignment_every_frame_ages",
    INSIDE + ALL_SHOTS + _TRACKED,
    ("detections", "cameras", "frames"),
)
def track_assignment_every_frame(g):
    inside = roi_filter(detections(g), cameras(g))
    tracked = tracking.assign_tracks(inside, frames=g.view("frames"))
    return tracked.select("camera_id", "sequence", "det_idx", "track_id")


@query(
    "W09_track_spans",
    """SELECT camera_id, user_id AS track_id, min(captured_at) AS first_seen_at, max(captured_at) AS last_seen_at,
              count(*) AS observations, round((epoch_us(max(captured_at)) - epoch_us(min(captured_at))) / 1e6, 6) AS duration_seconds
       FROM detections GROUP BY 1, 2""",
    ("detections",),
)
def track_spans(g):
    tracked = detections(g).withColumn("track_id", F.col("user_id"))
    return rounded(tracking.track_spans(tracked), "duration_seconds")


@query(
    "W07_identity_changes",
    """, named AS (SELECT camera_id, student_id, sighting_id, cast(student_id AS BIGINT) % 40 AS track,
            CASE WHEN sighting_id % 3 <> 0 THEN student_id END AS student FROM sightings),
         seen AS (SELECT *, last_value(student IGNORE NULLS) OVER (PARTITION BY camera_id, track ORDER BY sighting_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM named)
       SELECT sighting_id, previous, coalesce(previous <> student, false) AS identity_changed FROM seen""",
    ("sightings",),
)
def identity_changes(g):
    track = F.col("student_id").cast("bigint") % 40
    student = F.when(F.col("sighting_id") % 3 != 0, F.col("student_id"))
    named = g.view("sightings").withColumn("track", track).withColumn("student", student)
    seen = previous_value(
        named, ["camera_id", "track"], ["sighting_id"], F.col("student"), 1000, "previous"
    )
    changed = F.coalesce(F.col("previous") != F.col("student"), F.lit(False))
    return seen.select("sighting_id", "previous", changed.alias("identity_changed"))


_CHAIN = f""", ordered AS (
    SELECT *, epoch_us(captured_at) AS us, row_number() OVER (PARTITION BY camera_id, student_id ORDER BY captured_at, sighting_id) AS place
    FROM sightings),
  chain AS (
    SELECT camera_id, student_id, place, sighting_id, us, confidence, us AS emitted, confidence AS best, 'emit' AS action
    FROM ordered WHERE place = 1
    UNION ALL
    SELECT o.camera_id, o.student_id, o.place, o.sighting_id, o.us, o.confidence,
      CASE WHEN o.us - c.emitted >= {DEBOUNCE_SECONDS}000000 THEN o.us ELSE c.emitted END,
      CASE WHEN o.us - c.emitted >= {DEBOUNCE_SECONDS}000000 THEN o.confidence ELSE greatest(c.best, o.confidence) END,
      CASE WHEN o.us - c.emitted >= {DEBOUNCE_SECONDS}000000 THEN 'emit' WHEN o.confidence > c.best THEN 'replace' ELSE 'suppress' END
    FROM chain c JOIN ordered o ON o.camera_id = c.camera_id AND o.student_id = c.student_id AND o.place = c.place + 1)
"""
_ACTIONS = _CHAIN + "SELECT sighting_id, camera_id, student_id, action, make_timestamp(emitted) AS emitted_at FROM chain"
_ACTION_COLUMNS = ["sighting_id", "camera_id", "student_id", "action", "emitted_at"]


@query("G04_debounce_actions", _ACTIONS, ("sightings",))
def debounce_actions(g):
    return debounce(g.view("sightings"), DEBOUNCE_SECONDS).select(*_ACTION_COLUMNS)


@query("G04_debounce_actions_large_keys_cut", _ACTIONS, ("sightings",))
def debounce_actions_cut(g):
    return debounce(g.view("sightings"), DEBOUNCE_SECONDS, max_rows=6).select(*_ACTION_COLUMNS)


_EVENTS = _CHAIN + """, kept AS (SELECT * FROM chain WHERE action <> 'suppress'),
  last AS (SELECT *, row_number() OVER w AS place_back, count(*) OVER (PARTITION BY camera_id, student_id, emitted) - 1 AS upgrades FROM kept
           WINDOW w AS (PARTITION BY camera_id, student_id, emitted ORDER BY us DESC, sighting_id DESC))
  SELECT camera_id, student_id, make_timestamp(emitted) AS emitted_at, make_timestamp(us) AS captured_at, confidence, sighting_id, upgrades
  FROM last WHERE place_back = 1"""


@query("G05_current_events", _EVENTS, ("sightings",))
def events_with_upgrades(g):
    return current_events(debounce(g.view("sightings"), DEBOUNCE_SECONDS)).drop("event_id")


def _stream(g, table: str):
    """A given table, one file or a folder of them, as a file stream; the files of a micro-batch bound
    what one key can hold."""
    path = f"{g.folder}/{table}.parquet"
    schema = g.spark.read.parquet(path).schema
    # As a pattern the path may name either; a plain one has to be a folder.
    return g.spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path.replace(".parquet", ".parque[t]"))


def _sighting_stream(g):
    return _stream(g, "events").select(
        F.col("event_id").alias("sighting_id"),
        F.col("event_type").alias("camera_id"),
        F.col("user_id").cast("string").alias("student_id"),
        F.col("ts").cast("timestamp").alias("captured_at"),
        F.col("value").alias("confidence"),
    )


@query("G04_G08_debounce_stream", _ACTIONS, ("sightings",))
def debounce_stream(g):
    stateful.use_rocksdb(g.spark)
    acted = stateful.stream_debounce(_sighting_stream(g), DEBOUNCE_SECONDS)
    return jobs.replayed(g.spark, acted, "debounce").select(*_ACTION_COLUMNS)


@query("G05_event_stream_with_upgrades", _EVENTS, ("sightings",))
def event_stream(g):
    stateful.use_rocksdb(g.spark)
    acted = stateful.stream_debounce(_sighting_stream(g), DEBOUNCE_SECONDS)
    return current_events(jobs.replayed(g.spark, acted, "events")).drop("event_id")


@query(
    "P05_G10_latest_per_tick_stream",
    """SELECT event_type AS camera_id, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS tick_start,
              max_by(event_id, ts) AS sequence, count(*) - 1 AS dropped FROM events GROUP BY 1, 2""",
)
def latest_per_tick_stream(g):
    frames = _stream(g, "events").select(
        F.col("event_type").alias("camera_id"),
        F.col("event_id").alias("sequence"),
        F.col("ts").cast("timestamp").alias("captured_at"),
        F.lit(480).alias("height"),
        F.lit(640).alias("width"),
    )
    ticks = stateful.stream_latest_per_tick(frames, HOUR_FPS)
    written = jobs.replayed(g.spark, ticks, "ticks", "update", ["camera_id", "tick_start"])
    return written.select("camera_id", "tick_start", "sequence", "dropped")


@query(
    "G10_late_frames_stream",
    """WITH parts AS (SELECT event_type AS camera_id, epoch_us(ts) AS us, event_id % 3 AS part FROM events),
         fresh AS (SELECT part + 1 AS part, max(max(us)) OVER (ORDER BY part) // 1000 * 1000 - 86400000000 AS mark FROM parts GROUP BY part)
       SELECT camera_id, count(*) AS frames_seen,
              count(*) FILTER (WHERE (us // 3600000000 + 1) * 3600000000 <= coalesce(mark, 0)) AS late
       FROM parts LEFT JOIN fresh USING (part) GROUP BY 1""",
)
def late_frames_stream(g):
    """All events as frames that arrive in three parts, each of which reaches over the whole time."""
    events = g.table("events").select(
        F.col("event_type").alias("camera_id"),
        F.col("event_id").alias("sequence"),
        F.col("ts").cast("timestamp").alias("captured_at"),
        F.lit(480).alias("height"),
        F.lit(640).alias("width"),
    )
    arrived = scratch_path(g.spark, "arrived")
    sinks = {name: (scratch_path(g.spark, name), scratch_path(g.spark, f"{name}-progress")) for name in ("late-ticks", "seen")}
    for part in range(3):
        events.filter(F.col("sequence") % 3 == part).write.mode("append").parquet(arrived)
        frames = g.spark.readStream.schema(events.schema).parquet(arrived)
        streams = (stateful.stream_latest_per_tick(frames, HOUR_FPS, "1 day"), stateful.stream_frames_seen(frames))
        for stream, (sink, progress) in zip(streams, sinks.values()):
            jobs.run_available(stream, sink, progress, "update")
    ticks, seen = (
        jobs.written(g.spark, stream, sink, keys)
        for stream, (sink, _), keys in zip(streams, sinks.values(), (["camera_id", "tick_start"], ["camera_id"]))
    )
    return stateful.late_frames(ticks, seen)


def _settings(window: float = 3 * 3600.0) -> PipelineSettings:
    return PipelineSettings(
        quality=QualitySettings(min_detector_score=0.45, min_face_height_px=70, max_yaw_ratio=1.0),
        matching=MatchingSettings(similarity_threshold=0.30, min_margin=0.02),
        tracking=TrackingSettings(reconfirm_interval_seconds=1200.0, emit_debounce_seconds=window),
    )


def _gallery(g):
    return g.view("gallery")


def _judged(g):
    faces = with_faces(detections(g), g.table("embeddings"))
    return judge_faces(faces, _gallery(g), cameras(g), _settings())


_FACE_VIEWS = ("detections", "cameras", "gallery")


@query(
    "P09_G03_G06_G07_decisions",
    DECISIONS + "SELECT camera_id, sequence, det_idx, track_id, decision, identity_changed FROM decided",
    _FACE_VIEWS,
)
def decisions(g):
    decided = decide_faces(_judged(g), _settings())
    return decided.select("camera_id", "sequence", "det_idx", "track_id", "decision", "identity_changed")


@query(
    "P09_G03_G06_G07_decisions_large_keys_cut",
    DECISIONS + "SELECT camera_id, sequence, det_idx, track_id, decision, identity_changed FROM decided",
    _FACE_VIEWS,
)
def decisions_cut(g):
    decided = decide_faces(_judged(g), _settings(), max_rows=CUT_ROWS)
    return decided.select("camera_id", "sequence", "det_idx", "track_id", "decision", "identity_changed")


def _identified(g, **options):
    faces = with_faces(detections(g), g.table("embeddings"))
    return identify(faces, _gallery(g), cameras(g), _settings(), **options)


def _counted(decision: str, name: str) -> str:
    return f"count(d.det_idx) FILTER (WHERE {decision}) AS {name}"


@query(
    "G07_A16_counters",
    DECISIONS
    + ", sampled AS (SELECT camera_id, count(*) AS frames_sampled FROM frames GROUP BY 1) "
    + "SELECT s.camera_id, frames_sampled, count(d.det_idx) AS faces_detected, "
    + ", ".join(
        _counted(*pair)
        for pair in (
            ("decision = 'gated'", "faces_gated"),
            ("decision NOT IN ('skipped', 'gated')", "faces_embedded"),
            ("decision = 'skipped'", "recognitions_skipped"),
            ("decision = 'emit'", "events_published"),
            ("decision = 'suppress'", "events_debounced"),
            ("decision = 'replace'", "events_updated"),
            ("decision = 'gated'", "unresolved_quality"),
            ("decision = 'unmatched'", "unresolved_match"),
        )
    )
    + " FROM sampled s LEFT JOIN decided d ON s.camera_id = d.camera_id GROUP BY 1, 2",
    (*_FACE_VIEWS, "frames"),
)
def camera_counters(g):
    return _identified(g, frames=g.view("frames")).counters


_EVENT_ID = uuid_text("concat_ws('|', camera_id, student, cast(event.us AS STRING), cast(event.d AS STRING))")


@query(
    "G07_G08_identification_events",
    DECISIONS
    + f"""SELECT {_EVENT_ID} AS event_id, student AS student_id, concat('U', student) AS university_id, camera_id,
            round(score, 6) AS confidence, captured_at AS frame_captured_at, model_version, track_id, decision AS action
          FROM decided WHERE decision IN ('emit', 'replace')""",
    _FACE_VIEWS,
)
def identified_events(g):
    return rounded(_identified(g).events.drop("matched_at"), "confidence")


@query(
    "P11_S08_unresolved_detections",
    DECISIONS
    + """SELECT camera_id, strftime(captured_at, '%Y-%m-%dT%H:%M:%SZ') AS frame_captured_at, track_id,
           CASE decision WHEN 'gated' THEN 'quality' ELSE 'match' END AS stage,
           CASE WHEN decision = 'gated' THEN rules WHEN student IS NULL THEN 'no' WHEN score < 0.30 THEN 'similarity' ELSE 'margin' END AS rules,
           CASE WHEN decision <> 'gated' THEN round(score, 4) END AS best_similarity, false AS has_embedding
         FROM decided WHERE decision IN ('gated', 'unmatched')""",
    _FACE_VIEWS,
)
def unresolved_detections(g):
    """As written: JSON lines with rounded numbers and without vectors."""
    text = F.col("value")
    said = {
        name: F.get_json_object(text, f"$.{name}")
        for name in ("camera_id", "frame_captured_at", "track_id", "stage", "reason", "best_similarity")
    }
    keys = F.transform(F.split(said["reason"], "; "), lambda r: F.split(r, " ")[0])
    return unresolved_lines(_identified(g).unresolved).select(
        said["camera_id"].alias("camera_id"),
        said["frame_captured_at"].alias("frame_captured_at"),
        said["track_id"].cast("bigint").alias("track_id"),
        said["stage"].alias("stage"),
        F.concat_ws(",", keys).alias("rules"),
        said["best_similarity"].cast("double").alias("best_similarity"),
        text.contains('"embedding"').alias("has_embedding"),
    )


@query(
    "G10_late_rows_stream",
    """WITH parts AS (SELECT event_type AS camera_id, event_id AS sequence, epoch_us(ts) AS us, event_id % 3 AS part FROM events),
         newest AS (SELECT camera_id, part, max(us) AS us FROM parts GROUP BY 1, 2)
       SELECT camera_id, sequence, part FROM parts p
       WHERE us < (SELECT max(n.us) FROM newest n WHERE n.camera_id = p.camera_id AND n.part < p.part) - 86400000000""",
)
def late_rows_stream(g):
    """The late rows themselves: all events arrive in three parts, each of which reaches over the whole time."""
    stateful.use_rocksdb(g.spark)
    events = g.table("events").select(
        F.col("event_type").alias("camera_id"), F.col("event_id").alias("sequence"), F.col("ts").cast("timestamp").alias("captured_at")
    )
    arrived, sink, progress = (scratch_path(g.spark, name) for name in ("arriving", "told", "told-progress"))
    for part in range(3):
        events.filter(F.col("sequence") % 3 == part).write.mode("append").parquet(arrived)
        frames = g.spark.readStream.schema(events.schema).parquet(arrived)
        told = stateful.stream_lateness(frames, "camera_id", "captured_at", 86_400)
        jobs.run_available(told, sink, progress)
    late = jobs.written(g.spark, told, sink).filter("late")
    return late.select("camera_id", "sequence", (F.col("sequence") % 3).alias("part"))

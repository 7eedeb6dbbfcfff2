"""Folds against plain Python, whole and cut into pieces."""

import random

import numpy as np
import pyarrow as pa
import pytest

from helpers import T0, at, overlap, plain_decisions, plain_tracks
from musterline.operators import folds, tracking
from musterline.operators.debounce import DebounceStep, current_events, debounce
from musterline.operators.tracking import assign_tracks, associate, claims, track_spans
from musterline.plans.identify import IdentifyStep, decide_faces
from musterline.settings import PipelineSettings, TrackingSettings

SIGHTINGS = "sighting_id bigint, camera_id string, student_id string, captured_at timestamp, confidence double, identity_changed boolean"


def actions(spark, sightings, window=30.0, max_rows=1_000_000):
    rows = [(i, "cam", s[2] if len(s) > 2 else "A", at(s[0]), s[1], len(s) > 3 and s[3]) for i, s in enumerate(sightings)]
    df = debounce(spark.createDataFrame(rows, SIGHTINGS), window, max_rows)
    return [r for r in sorted(df.collect(), key=lambda r: r.sighting_id)]


@pytest.mark.parametrize(
    "sightings, window, expected",
    [
        ([(0, 0.6), (29, 0.6), (30, 0.6)], 30, ["emit", "suppress", "emit"]),
        ([(0, 0.6), (1, 0.6, "B")], 30, ["emit", "emit"]),
        ([(0, 0.6), (5, 0.7, "A", True)], 30, ["emit", "emit"]),
        ([(0, 0.6), (5, 0.63), (5, 0.59), (29, 0.63)], 30, ["emit", "replace", "suppress", "suppress"]),
        ([(0, 0.6), (1, 0.6)], 0, ["emit", "emit"]),
    ],
)
def test_debounce_rules(spark, sightings, window, expected):
    assert [r.action for r in actions(spark, sightings, float(window))] == expected


def test_replacement_keeps_the_event_id(spark):
    first, second, third = actions(spark, [(0, 0.6), (5, 0.7), (40, 0.5)])
    assert first.event_id == second.event_id != third.event_id
    assert second.emitted_at == first.emitted_at


def test_current_events_show_the_latest_upgrade(spark):
    rows = [(i, "cam", "A", at(t), c, False) for i, (t, c) in enumerate([(0, 0.5), (5, 0.7), (6, 0.6)])]
    df = debounce(spark.createDataFrame(rows, SIGHTINGS), 30.0)
    (event,) = current_events(df).collect()
    assert (event.confidence, event.sighting_id, event.upgrades) == (0.7, 1, 1)


@pytest.mark.parametrize("max_rows", [5, 40])
def test_cut_keys_debounce_like_whole_ones(spark, max_rows):
    rng = random.Random(11)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([0, 1, 2, 9, 31])
        rows.append((t, rng.random(), "A" if rng.random() < 0.8 else "B", rng.random() < 0.02))
    whole, cut = actions(spark, rows), actions(spark, rows, max_rows=max_rows)
    assert [(r.action, r.event_id) for r in whole] == [(r.action, r.event_id) for r in cut]


@pytest.mark.parametrize("window", [0.0, 30.0])
def test_columns_and_rows_debounce_alike(window):
    """The step by columns, in batches of any size and with missing confidences, against the step by rows."""
    rng = random.Random(5)
    step, rows = DebounceStep(window), []
    for piece in range(30):
        t = rng.randrange(10**9)
        for _ in range(rng.randint(1, 25)):
            t += rng.choice([0, 1, 7, 29, 30, 31]) * 1_000_000
            rows.append((piece, t, rng.choice([None, rng.random(), 0.5]), len(rows), rng.choice([None, False, rng.random() < 0.2])))
    for size in (1, 2, 7, 1000):
        for only_ends in (False, True):
            names = step.reads if only_ends is False else []
            out = ["_piece", "_began", "_order", "_state", "_slots", "_leaned"] if only_ends else [*names, "action", "emitted_at", "emitted_by"]
            run = folds._by_columns(step, ["_piece"], names, only_ends, out)
            schema = pa.schema(
                [("_piece", pa.int64()), ("at", pa.int64()), ("confidence", pa.float64()), ("sighting_id", pa.int64()),
                 ("identity_changed", pa.bool_()), ("_state", pa.string()), ("_slots", pa.string())]
            )
            whole = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(*r, None, None) for r in rows]), schema)], schema=schema)
            got = pa.Table.from_batches(list(run(iter(whole.to_batches(max_chunksize=size))))).to_pylist()
            if only_ends:
                assert [g["_piece"] for g in got] == list(range(30)) and {g["_began"] for g in got} == {"[]"}
            expected, ends, state = [], [], None
            for i, (piece, *reads) in enumerate(rows):
                if not i or rows[i - 1][0] != piece:
                    state = step.start()
                reads = [reads[0], float("nan") if reads[1] is None else reads[1], *reads[2:]]
                ((_, told),) = step.push(state, (None, reads))
                expected.append(told)
                if i + 1 == len(rows) or rows[i + 1][0] != piece:
                    ends.append([state[0], None if state[1] != state[1] else state[1], state[2]])
            if only_ends:
                assert [step.load(g["_state"]) for g in got] == ends
            else:
                assert [(g["action"], g["emitted_at"], g["emitted_by"]) for g in got] == expected


def clip(seed, frames=120, people=4, cameras=("north", "south")):
    """Boxes that drift, vanish and cross, some of them standing still throughout."""
    rng = random.Random(seed)
    rows = []
    for camera in cameras:
        spots = [[rng.uniform(0, 300), rng.uniform(0, 200)] for _ in range(people)]
        for f in range(frames):
            det = 0
            for p, spot in enumerate(spots):
                if p:
                    spot[0] += rng.uniform(-25, 25)
                    spot[1] += rng.uniform(-15, 15)
                if p and rng.random() < 0.3:
                    continue
                x, y = round(spot[0]), round(spot[1])
                rows.append((camera, f, det, (float(x), float(y), x + 80.0, y + 100.0), p))
                det += 1
    return rows


DETECTED = "camera_id string, sequence bigint, det_idx bigint, captured_at timestamp, box struct<x1:double,y1:double,x2:double,y2:double>"


def frames_of(rows, camera, all_frames=None):
    found = {}
    for c, f, d, box, _ in rows:
        if c == camera:
            found.setdefault(f, []).append((d, box))
    return [(f, found.get(f, [])) for f in (all_frames if all_frames is not None else sorted(found))]


@pytest.mark.parametrize("max_rows", [1_000_000, 60])
@pytest.mark.parametrize("every_frame", [False, True])
def test_tracks_agree_with_plain_python(spark, max_rows, every_frame):
    rows = [r for r in clip(1) if not 30 <= r[1] < 45]
    df = spark.createDataFrame([(c, f, d, at(f / 3), b) for c, f, d, b, _ in rows], DETECTED)
    frames = spark.createDataFrame(
        [(c, f, at(f / 3)) for c in ("north", "south") for f in range(120)],
        "camera_id string, sequence bigint, captured_at timestamp",
    )
    tracked = assign_tracks(df, TrackingSettings(), frames if every_frame else None, max_rows)
    got = {(r.camera_id, r.sequence, r.det_idx): r.track_id for r in tracked.collect()}
    assert len(got) == len(rows)
    for camera in ("north", "south"):
        expected = plain_tracks(frames_of(rows, camera, range(120) if every_frame else None))
        assert {k[1:]: v for k, v in got.items() if k[0] == camera} == expected


def counted_passes(monkeypatch):
    passes, plain = [], folds._run

    def counting(*args):
        passes.append(args[-1])
        return plain(*args)

    monkeypatch.setattr(folds, "_run", counting)
    return passes


@pytest.mark.parametrize("twins", [False, True])
def test_tracks_that_never_end_settle_in_few_passes(spark, monkeypatch, twins):
    """Posters in view throughout, of which the first seen is not the first listed, and a passer-by."""
    passes = counted_passes(monkeypatch)
    left, right = (0.0, 0.0, 80.0, 100.0), (300.0, 0.0, 380.0, 100.0)
    rows = []
    for f in range(240):
        boxes = [right] if f < 3 else [left, left if twins else (0.0, 300.0, 80.0, 400.0), right]
        if f % 50 == 7:
            boxes.append((600.0, 0.0, 700.0, 90.0))
        rows += [("cam", f, d, b, None) for d, b in enumerate(boxes)]
    df = spark.createDataFrame([(c, f, d, at(f / 3), b) for c, f, d, b, _ in rows], DETECTED)
    tracked = assign_tracks(df, TrackingSettings(), None, len(rows) // 24)
    got = {(r.sequence, r.det_idx): r.track_id for r in tracked.collect()}
    assert got == plain_tracks(frames_of(rows, "cam"))
    assert len(passes) <= 4


def test_equal_claims_follow_the_order_of_creation(spark):
    """One box that overlaps two older tracks equally goes to the younger, also behind a cut."""
    older, younger, between = (20.0, 0.0, 60.0, 40.0), (0.0, 0.0, 40.0, 40.0), (10.0, 0.0, 50.0, 40.0)
    boxes = {0: [older], 1: [younger, (500.0, 0.0, 540.0, 40.0)], 12: [between], 30: [between]}
    rows = [("cam", f, d, b, None) for f in range(40) for d, b in enumerate(boxes.get(f, [(900.0, 9.0, 940.0, 40.0)]))]
    settings = TrackingSettings(max_age_frames=50)
    df = spark.createDataFrame([(c, f, d, at(f / 3), b) for c, f, d, b, _ in rows], DETECTED)
    outcomes = [
        sorted((r.sequence, r.det_idx, r.track_id) for r in assign_tracks(df, settings, None, n).collect())
        for n in (1_000_000, 5)
    ]
    assert outcomes[0] == outcomes[1]


def two_frames(spark, *frames, settings=TrackingSettings(), total=None):
    rows = [("cam", f, d, at(f), b) for f, boxes in enumerate(frames) for d, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, DETECTED)
    every = None
    if total:
        every = spark.createDataFrame(
            [("cam", f, at(f)) for f in range(total)], "camera_id string, sequence bigint, captured_at timestamp"
        )
    out = assign_tracks(df, settings, every).collect()
    return [r.track_id for r in sorted(out, key=lambda r: (r.sequence, r.det_idx))]


def test_tracker_rules(spark):
    near = [(100.0, 100.0, 200.0, 220.0)], [(110.0, 105.0, 210.0, 225.0)]
    assert two_frames(spark, *near) == [1, 1]
    far = [(0.0, 0.0, 100.0, 120.0)], [(600.0, 400.0, 700.0, 520.0)]
    assert two_frames(spark, *far) == [1, 2]
    assert two_frames(spark, [far[0][0], far[1][0]]) == [1, 2]


def test_eviction_needs_frames_that_count(spark):
    box = (0.0, 0.0, 100.0, 120.0)
    gap = ([box], [], [], [], [], [box])
    young = TrackingSettings(max_age_frames=2)
    assert two_frames(spark, *gap, settings=young) == [1, 1]
    assert two_frames(spark, *gap, settings=young, total=6) == [1, 2]


def judged_rows(seed):
    rng = random.Random(seed)
    rows = []
    for camera, f, d, box, person in clip(seed, frames=200):
        passed = rng.random() < 0.8
        who = None if rng.random() < 0.15 else f"s{person if rng.random() < 0.95 else person + 1}"
        rows.append((camera, f, d, at(f / 3), box, passed, who, round(rng.random(), 3)))
    return rows


@pytest.mark.parametrize("max_rows", [1_000_000, 90])
def test_decisions_agree_with_plain_python(spark, max_rows):
    rows = judged_rows(7)
    settings = PipelineSettings(tracking=TrackingSettings(reconfirm_interval_seconds=1.0, emit_debounce_seconds=12.0))
    schema = (
        DETECTED + ", quality struct<passed:boolean>, outcome string, best_student string, best_similarity double"
    )
    df = spark.createDataFrame(
        [
            (c, f, d, t, b, (passed,), None if not passed else "matched" if who else "unresolved", who if passed else None, s if passed else None)
            for c, f, d, t, b, passed, who, s in rows
        ],
        schema,
    )
    out = decide_faces(df, settings, max_rows).collect()
    got = {(r.camera_id, r.sequence, r.det_idx): (r.track_id, r.decision) for r in out}
    assert len(got) == len(rows)
    seen = set()
    for camera in ("north", "south"):
        mine = [r for r in rows if r[0] == camera]
        tracks = plain_tracks(frames_of([(c, f, d, b, None) for c, f, d, _, b, *_ in mine], camera))
        plain = [
            {"sequence": f, "det_idx": d, "at": round((t - T0).total_seconds() * 1e6), "passed": p, "who": w, "score": s}
            for _, f, d, t, _, p, w, s in mine
        ]
        expected = plain_decisions(plain, tracks, 1_000_000, 12_000_000)
        assert {k[1:]: v[1] for k, v in got.items() if k[0] == camera} == expected
        assert {k[1:]: v[0] for k, v in got.items() if k[0] == camera} == tracks
        seen |= set(expected.values())
    assert seen == {"skipped", "gated", "unmatched", "emit", "replace", "suppress", "repeat"}


def test_state_forgets_events_that_ran_out():
    step = IdentifyStep(TrackingSettings(emit_debounce_seconds=1.0, reconfirm_interval_seconds=0.0))
    state = step.start()
    for f in range(50):
        reads = (f, 0, 0.0, 0.0, 10.0, 10.0, f * 2_000_000, True, "matched", f"s{f}", 0.9)
        step.push(state, (reads, reads))
    step.close(state)
    assert len(state["events"]) == 1


def test_track_spans(spark):
    rows = [("cam", 1, at(0.0)), ("cam", 1, at(2.5)), ("cam", 2, at(1.0))]
    spans = track_spans(spark.createDataFrame(rows, "camera_id string, track_id bigint, captured_at timestamp"))
    assert {(r.track_id, r.observations, r.duration_seconds) for r in spans.collect()} == {(1, 2, 2.5), (2, 1, 0.0)}


def running_total():
    """A step whose state never forgets; its class is made here, so that workers get it by value."""

    class RunningTotal(folds.Step):
        reads, adds = ["amount"], "total bigint"

        def start(self):
            return [0]

        def push(self, state, row):
            state[0] += row[1][0]
            return [(row[0], (state[0],))]

        def dump(self, state):
            return str(state[0])

        def load(self, text):
            return [int(text)]

    return RunningTotal()


def test_a_state_that_never_settles_takes_few_passes(spark, monkeypatch):
    """The long key has a state that depends on all before it; the short one is not cut."""
    passes = counted_passes(monkeypatch)
    rows = [("long", i, i % 7 + 1) for i in range(300)] + [("short", i, 1) for i in range(5)]
    out = folds.fold(spark.createDataFrame(rows, "k string, at bigint, amount bigint"), ["k"], ["at"], running_total(), 10)
    got = {(r.k, r.at): r.total for r in out.collect()}
    for key in ("long", "short"):
        total = 0
        for k, i, amount in rows:
            if k == key:
                total += amount
                assert got[key, i] == total
    assert len(got) == len(rows) and len(passes) <= 3


def test_crowded_frames_cut_one_by_one_track_like_whole_ones(spark, monkeypatch):
    """Frames with more faces than a piece may have, where every track depends on those before."""
    passes, rng = counted_passes(monkeypatch), random.Random(3)
    rows = []
    for f in range(40):
        for d in range(60):
            x, y = float(rng.randrange(0, 90)), float(rng.randrange(0, 60))
            rows.append(("cam", f, d, (x, y, x + 80 + rng.randrange(40), y + 60 + rng.randrange(90)), None))
    df = spark.createDataFrame([(c, f, d, at(f / 3), b) for c, f, d, b, _ in rows], DETECTED)
    tracked = assign_tracks(df, TrackingSettings(), None, 20)
    got = {(r.sequence, r.det_idx): r.track_id for r in tracked.collect()}
    assert got == plain_tracks(frames_of(rows, "cam"))
    assert len(passes) <= 4


def test_overlaps_of_many_boxes_are_all_found():
    """Pairs found by windows are those of comparing all, for boxes of any size, also without extent."""
    rng = np.random.default_rng(8)
    for least in (0.05, 0.3, 0.9):
        corners, sides = rng.uniform(0, 300, (400, 2)), rng.choice([0.0, 5.0, 40.0, 60.0, 500.0], (400, 2))
        boxes = np.hstack([corners, corners + sides])
        faces, held = boxes[:150], boxes[150:] + rng.choice([0.0, 1.0], (250, 1))
        score, d, t = claims(faces, held, least)
        every = {(i, j): overlap(a, b) for i, a in enumerate(faces) for j, b in enumerate(held)}
        assert {(i, j): s for i, j, s in zip(d.tolist(), t.tolist(), score.tolist())} == pytest.approx({k: v for k, v in every.items() if v >= least})
        assert len(d) == len(set(zip(d.tolist(), t.tolist())))


def test_a_frame_of_very_many_faces_is_associated_without_all_pairs(monkeypatch):
    """Of 4 million pairs of faces and tracks only those close by are compared."""
    compared, plain = [], tracking.overlaps
    monkeypatch.setattr(tracking, "overlaps", lambda a, b: compared.append(len(a)) or plain(a, b))
    boxes = [(100.0 * i, 100.0 * j, 100.0 * i + 80, 100.0 * j + 80) for i in range(50) for j in range(40)]
    tracks = [{"box": (a + 1, b, c + 1, d), "age": 0, "born": (0, n)} for n, (a, b, c, d) in enumerate(reversed(boxes))]
    assigned, _ = associate(tracks, boxes, TrackingSettings())
    assert [t["born"][1] for t in assigned] == list(range(1999, -1, -1)) and sum(compared) < 20_000

"""Small tables for tests, and plain-Python versions of the folds to compare with."""

from datetime import datetime, timedelta, timezone

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def overlap(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def plain_tracks(frames, min_iou=0.3, max_age=8):
    """frames: [(sequence, [(det_idx, box), ...])] of one camera -> {(sequence, det_idx): id}"""
    alive, result, fresh = {}, {}, 1
    for sequence, faces in frames:
        for t in alive.values():
            t["age"] += 1
        options = []
        for i, (_, box) in enumerate(faces):
            for tid, t in alive.items():
                score = overlap(box, t["box"])
                if score >= min_iou:
                    options.append((score, i, tid))
        options.sort(reverse=True)
        face_of, used = {}, set()
        for _, i, tid in options:
            if i not in face_of and tid not in used:
                face_of[i] = tid
                used.add(tid)
        for i, (det, box) in enumerate(faces):
            if i in face_of:
                tid = face_of[i]
            else:
                tid, fresh = fresh, fresh + 1
                alive[tid] = {}
            alive[tid].update(box=box, age=0)
            result[(sequence, det)] = tid
        for tid in [tid for tid, t in alive.items() if t["age"] > max_age]:
            del alive[tid]
    return result


def plain_decisions(rows, tracks, reconfirm, window, once=True):
    """rows: ordered dicts of one camera -> {(sequence, det_idx): decision}"""
    state, events, result = {}, {}, {}
    for r in rows:
        key = (r["sequence"], r["det_idx"])
        t = state.setdefault(tracks[key], {"tried": None, "who": None, "told": False})
        now = r["at"]
        if t["tried"] is not None and now - t["tried"] < reconfirm:
            result[key] = "skipped"
            continue
        if not r["passed"]:
            result[key] = "gated"
            continue
        t["tried"] = now
        if r["who"] is None:
            result[key] = "unmatched"
            continue
        changed = t["who"] is not None and t["who"] != r["who"]
        t["who"] = r["who"]
        last = events.get(r["who"])
        if not changed and window > 0 and last and now - last[0] < window:
            if r["score"] > last[1]:
                last[1] = r["score"]
                result[key] = "replace"
            else:
                result[key] = "suppress"
            continue
        if t["told"] and once and not changed:
            result[key] = "repeat"
            continue
        events[r["who"]] = [now, r["score"]]
        t["told"] = True
        result[key] = "emit"
    return result

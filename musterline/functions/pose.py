"""Head pose from five landmarks, in the order left eye, right eye, nose, mouth corners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_INTEROCULAR = 1e-6


def _distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.pow(p["x"] - q["x"], F.lit(2.0)) + F.pow(p["y"] - q["y"], F.lit(2.0)))


def has_pose(landmarks: Column) -> Column:
    return landmarks.isNotNull() & (F.size(landmarks) >= 5)


def yaw_ratio(landmarks: Column) -> Column:
    """How unevenly the nose sits between the eyes, in eye distances; 1 when eyes coincide."""
    left, right, nose = (F.get(landmarks, F.lit(i)) for i in range(3))
    eyes = _distance(left, right)
    unevenness = F.abs(_distance(nose, left) - _distance(nose, right))
    return F.when(eyes < MIN_INTEROCULAR, F.lit(1.0)).otherwise(unevenness / eyes)


def roll_degrees(landmarks: Column) -> Column:
    left, right = F.get(landmarks, F.lit(0)), F.get(landmarks, F.lit(1))
    return F.degrees(F.atan2(right["y"] - left["y"], right["x"] - left["x"]))

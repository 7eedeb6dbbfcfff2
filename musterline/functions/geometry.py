"""Boxes as ``struct<x1,y1,x2,y2>``; everything here is a plain Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    edges = {"x1": x1, "y1": y1, "x2": x2, "y2": y2}
    return F.struct(*[value.cast("double").alias(name) for name, value in edges.items()])


def box_width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"])


def box_height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def box_area(b: Column) -> Column:
    return box_width(b) * box_height(b)


def center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / F.lit(2.0)


def center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / F.lit(2.0)


def intersection_area(a: Column, b: Column) -> Column:
    across = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    down = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down)


def iou(a: Column, b: Column) -> Column:
    shared = intersection_area(a, b)
    union = box_area(a) + box_area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def clip_box(b: Column, width: Column, height: Column) -> Column:
    def inside(value: Column, size: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(value, size.cast("double") - 1))

    return box(
        inside(b["x1"], width), inside(b["y1"], height),
        inside(b["x2"], width), inside(b["y2"], height),
    )


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"])


def roi_box(roi: Column, frame_height: Column, frame_width: Column) -> Column:
    """A region given as fractions of the frame, in pixels."""
    return box(
        roi[0] * frame_width, roi[1] * frame_height, roi[2] * frame_width, roi[3] * frame_height
    )


def in_roi(b: Column, roi: Column, frame_height: Column, frame_width: Column) -> Column:
    """Overlaps the region at all, or has its center in it; no region keeps everything."""
    region = roi_box(roi, frame_height, frame_width)
    touches = (iou(b, region) > 0) | contains_point(region, center_x(b), center_y(b))
    return F.when(roi.isNull(), F.lit(True)).otherwise(touches)


def padded_crop(b: Column, frame_height: Column, frame_width: Column, margin: float) -> Column:
    """The crop rectangle with a margin on each side, cut at the frame, in whole pixels."""
    pad_x, pad_y = box_width(b) * margin, box_height(b) * margin
    return F.struct(
        F.greatest(F.lit(0.0), b["x1"] - pad_x).cast("int").alias("x1"),
        F.greatest(F.lit(0.0), b["y1"] - pad_y).cast("int").alias("y1"),
        F.least(frame_width.cast("double"), b["x2"] + pad_x).cast("int").alias("x2"),
        F.least(frame_height.cast("double"), b["y2"] + pad_y).cast("int").alias("y2"),
    )

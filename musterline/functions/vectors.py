"""Vectors as ``array<float>``; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_TOLERANCE = 1e-3


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Similarity of vectors of any length, i.e. one minus the cosine distance."""
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def l2_normalize(v: Column) -> Column:
    """The unit vector; a zero vector fails the job."""
    norm = l2_norm(v)
    scaled = F.transform(v, lambda x: (x / norm).cast("float"))
    return F.when(norm == 0, F.raise_error(F.lit("refusing to store a zero vector"))).otherwise(scaled)


def require_unit(v: Column) -> Column:
    """The vector itself when it is L2-normalized; anything else fails the job."""
    norm = l2_norm(v)
    complaint = F.raise_error(F.format_string("embedding must be L2-normalized, norm is %.4f", norm))
    return F.when(F.abs(norm - 1) <= UNIT_TOLERANCE, v).otherwise(complaint)


def margin(best: Column, runner_up: Column) -> Column:
    """Lead over the runner-up; the best itself without one; null without a best."""
    return best - F.coalesce(runner_up, F.lit(0.0))

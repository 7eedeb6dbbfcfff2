"""Identifiers, clip arithmetic, percentages and small text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must agree with ids and clips made elsewhere.
STUDENT_NAMESPACE = "6f2a1d5e-9c3b-4f7a-8e21-0b5c7d9a4e13"
DEFAULT_NATIVE_FPS = 25.0
CLIP_EPOCH = "2026-01-01 00:00:00"
CRITICAL_BELOW, SERIOUS_BELOW, ALERT_BELOW = 50, 60, 75


def name_uuid(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name, wholly inside the JVM."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant + 8)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def student_id_for(university_id: Column) -> Column:
    return name_uuid(STUDENT_NAMESPACE, university_id)


def event_id_for(camera_id: Column, student_id: Column, micros: Column, det_idx: Column) -> Column:
    """Repeatable event id: a replay of the same input gives the same ids."""
    text = F.concat_ws("|", camera_id, student_id, micros.cast("string"), det_idx.cast("string"))
    return name_uuid(STUDENT_NAMESPACE, text)


def stride(native_fps: Column, target_fps: Column | float) -> Column:
    """Every how-many-th frame to keep; halves round to even."""
    target = F.lit(target_fps) if isinstance(target_fps, (int, float)) else target_fps
    native = F.coalesce(F.nullif(native_fps.cast("double"), F.lit(0.0)), F.lit(DEFAULT_NATIVE_FPS))
    return F.greatest(F.lit(1), F.bround(native / target, 0).cast("bigint"))


def offset_seconds(sequence: Column, native_fps: Column) -> Column:
    fps = F.nullif(native_fps.cast("double"), F.lit(0.0))
    return F.coalesce(sequence / fps, sequence.cast("double"))


def spread_fps(target_fps: float, max_frames: int, duration_seconds: Column) -> Column:
    """The rate that spreads a frame budget over the clip, never above the target."""
    rate = F.lit(float(max_frames)) / F.nullif(duration_seconds.cast("double"), F.lit(0.0))
    return F.least(F.lit(float(target_fps)), F.coalesce(rate, F.lit(float(target_fps))))


def presentation_time(position_ms: Column, sequence: Column, native_fps: Column) -> Column:
    """Clip start plus the decoder position, or plus sequence over frame rate without one."""
    fps = F.coalesce(F.nullif(native_fps.cast("double"), F.lit(0.0)), F.lit(DEFAULT_NATIVE_FPS))
    by_position = F.when(position_ms > 0, position_ms.cast("double") * 1000)
    micros = F.coalesce(by_position, sequence / fps * 1_000_000)
    start = F.unix_micros(F.to_timestamp(F.lit(CLIP_EPOCH)))
    return F.timestamp_micros(start + F.bround(micros, 0).cast("bigint"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds, keeping the microseconds."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def percentage(part: Column, whole: Column) -> Column:
    """Two-decimal percentage; null, not an error, for an empty whole."""
    whole_or_null = F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    share = F.lit(100).cast("decimal(5,1)") * part.cast("decimal(20,0)") / whole_or_null
    return F.round(share, 2).cast("decimal(5,2)")


# The names of the three bands of alerts, and those of the legacy table.
BANDS = ("critical", "below60", "below75")
LEGACY_BANDS = ("Critical", "Below60", "Below75")


def alert_band(pct: Column, legacy: bool = False) -> Column:
    lowest, middle, highest = LEGACY_BANDS if legacy else BANDS
    return (
        F.when(pct < CRITICAL_BELOW, F.lit(lowest))
        .when(pct < SERIOUS_BELOW, F.lit(middle))
        .when(pct < ALERT_BELOW, F.lit(highest))
    )


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def boolean_sum(condition: Column) -> Column:
    """How many are true; null, not 0, where no condition is known."""
    return F.sum(F.when(condition.isNotNull(), condition.cast("int")))


def changed(old: Column, new: Column) -> Column:
    """Null-safe inequality."""
    return ~old.eqNullSafe(new)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with a Z; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(
        whole, F.when(fraction == 0, F.lit("")).otherwise(F.format_string(".%06d", fraction)), F.lit("Z")
    )


def whole_text(value: Column) -> Column:
    """No decimals, halves to even."""
    return F.format_string("%.0f", F.bround(value, 0))


def reason_key(reason: Column) -> Column:
    return F.split(reason, " ")[0]


def quality_score(height: Column, blur_variance: Column) -> Column:
    return height * F.coalesce(blur_variance, F.lit(1.0))


def span_text(first: Column, last: Column, duration: Column) -> Column:
    """Which part of the clip was examined, e.g. ``0.00s - 6.33s (17% of the clip)``."""
    span = F.format_string("%.2fs - %.2fs", first, last)
    share = F.concat(F.lit(" ("), whole_text((last - first) / duration * 100), F.lit("% of the clip)"))
    with_share = F.when(duration > 0, F.concat(span, share)).otherwise(span)
    return F.when(first.isNotNull() & last.isNotNull(), with_share)

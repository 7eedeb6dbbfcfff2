"""Thresholds as frozen values that are handed to the builders; nothing is global."""

from __future__ import annotations

from dataclasses import dataclass, field


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class SamplingSettings:
    target_fps: float = 3.0
    motion_gate_enabled: bool = False
    motion_gate_min_fraction: float = 0.002

    def __post_init__(self) -> None:
        _require(0 < self.target_fps <= 30, "target_fps must be in (0, 30]")
        _require(0 <= self.motion_gate_min_fraction <= 1, "motion fraction must be in [0, 1]")


@dataclass(frozen=True)
class QualitySettings:
    min_detector_score: float = 0.60
    min_face_height_px: int = 100
    min_blur_variance: float = 45.0
    max_yaw_ratio: float = 0.45
    max_roll_degrees: float = 35.0

    def __post_init__(self) -> None:
        _require(0 <= self.min_detector_score <= 1, "min_detector_score must be in [0, 1]")
        _require(self.min_face_height_px >= 16, "min_face_height_px must be at least 16")
        _require(self.min_blur_variance >= 0, "min_blur_variance must not be negative")
        _require(self.max_yaw_ratio >= 0, "max_yaw_ratio must not be negative")
        _require(self.max_roll_degrees >= 0, "max_roll_degrees must not be negative")


@dataclass(frozen=True)
class MatchingSettings:
    similarity_threshold: float = 0.55
    min_margin: float = 0.05
    aggregation: str = "max"
    exclude_inactive_students: bool = True
    candidate_limit: int = 10

    def __post_init__(self) -> None:
        _require(-1 <= self.similarity_threshold <= 1, "similarity_threshold must be in [-1, 1]")
        _require(self.min_margin >= 0, "min_margin must not be negative")
        _require(self.aggregation in ("max", "mean"), "aggregation is 'max' or 'mean'")
        _require(self.candidate_limit >= 1, "candidate_limit must be positive")


@dataclass(frozen=True)
class TrackingSettings:
    min_iou: float = 0.3
    max_age_frames: int = 8
    reconfirm_interval_seconds: float = 2.0
    emit_event_once_per_track: bool = True
    emit_debounce_seconds: float = 30.0

    def __post_init__(self) -> None:
        _require(0 <= self.min_iou <= 1, "min_iou must be in [0, 1]")
        _require(self.max_age_frames >= 1, "max_age_frames must be at least 1")
        _require(self.reconfirm_interval_seconds >= 0, "reconfirm interval must not be negative")
        _require(self.emit_debounce_seconds >= 0, "debounce window must not be negative")


@dataclass(frozen=True)
class PrivacySettings:
    persist_unresolved_embeddings: bool = False


@dataclass(frozen=True)
class EnrollmentSettings:
    max_per_student: int = 3
    enforce_quality: bool = True


@dataclass(frozen=True)
class PipelineSettings:
    sampling: SamplingSettings = field(default_factory=SamplingSettings)
    quality: QualitySettings = field(default_factory=QualitySettings)
    matching: MatchingSettings = field(default_factory=MatchingSettings)
    tracking: TrackingSettings = field(default_factory=TrackingSettings)
    privacy: PrivacySettings = field(default_factory=PrivacySettings)

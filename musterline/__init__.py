"""Presence analytics as Spark jobs: matching, tracking, de-duplication and reports."""

from musterline.settings import (
    EnrollmentSettings,
    MatchingSettings,
    PipelineSettings,
    PrivacySettings,
    QualitySettings,
    SamplingSettings,
    TrackingSettings,
)

__all__ = [
    "EnrollmentSettings",
    "MatchingSettings",
    "PipelineSettings",
    "PrivacySettings",
    "QualitySettings",
    "SamplingSettings",
    "TrackingSettings",
]

"""Explicit schemas: sources are read with these, never inferred."""

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
LANDMARKS = "array<struct<x:double,y:double>>"

FRAMES = (
    "camera_id string, sequence bigint, captured_at timestamp, height int, width int, "
    "changed_fraction double"
)
DETECTIONS = (
    "camera_id string, sequence bigint, captured_at timestamp, frame_height int, frame_width int, "
    f"det_idx bigint, box {BOX}, detector_score double, landmarks {LANDMARKS}, "
    "blur_variance double, embedding array<float>, model_version string"
)
REFERENCE_DETECTIONS = (
    f"path string, readable boolean, face_count int, box {BOX}, detector_score double, "
    f"landmarks {LANDMARKS}, blur_variance double, embedding array<float>, model_version string"
)
FACE_EMBEDDINGS = (
    "embedding_id string, student_id string, university_id string, embedding array<float>, "
    "model_version string, source string, created_at timestamp"
)
STUDENTS = (
    "student_id string, university_id string, full_name string, section_id int, "
    "enrollment_status string, face_registered boolean"
)
CAMERAS = (
    "camera_id string, location_label string, source_ref string, classroom_id int, "
    "roi array<double>, enabled boolean"
)
IDENTIFICATION_EVENTS = (
    "event_id string, student_id string, university_id string, camera_id string, "
    "confidence double, frame_captured_at timestamp, matched_at timestamp, "
    "model_version string, track_id bigint"
)
UNRESOLVED_DETECTIONS = (
    "detection_id string, camera_id string, frame_captured_at timestamp, track_id bigint, "
    "stage string, reason string, detector_score double, box array<double>, "
    "best_similarity double, margin double, quality_metrics map<string,double>, "
    "model_version string, embedding array<float>"
)
ROSTER = "university_id string, full_name string"
STAGE_SAMPLES = "stage string, ms double"

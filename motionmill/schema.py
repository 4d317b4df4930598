"""Calendar of stimuli, event windows and channel names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Frames per second, stimuli and their lengths in seconds, channel names, scales.
FPS = 30
STIMULI = {1: 30.6, 2: 66.8, 4: 69.0, 6: 30.6}
FACE_CHANNELS = [
    "yaw", "roll", "pitch", "x", "y", "depth", "eyebrow_raise", "eyebrow_push", "eye_opening", "mouth_width",
    "mouth_opening", "lips_protrusion", "smile",
]
ASYMMETRY_CHANNELS = ["inner_eyebrow", "outer_eyebrow", "eyes", "smile"]
SMOOTH_SCALE, MOTION_SCALE = 10, 5
CLUSTERS, BINS = 10, 5


def log_scales(n: int, low: float = 1.0, high: float = 1000.0) -> list[float]:
    """n scales evenly spread in logarithm."""
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)]


def n_frames(length: float, fps: float = FPS) -> int:
    return int((length + 1 / fps) * fps) + 1


def stimuli(spark: SparkSession, lengths: dict[int, float] = STIMULI, fps: float = FPS) -> DataFrame:
    rows = [(k, float(s), n_frames(s, fps)) for k, s in lengths.items()]
    return spark.createDataFrame(rows, "stimulus int, length_s double, n_frames int")


def event_windows(spark: SparkSession, rows: list[tuple[int, str, int, int]]) -> DataFrame:
    """Half-open frame windows; a short list, so it may be broadcast."""
    return spark.createDataFrame(rows, "stimulus int, event string, begin int, end int")

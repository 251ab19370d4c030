"""The long frame schema and the assays' default parameters."""

from __future__ import annotations

from dataclasses import dataclass

#: One row per track (file), body part (point) and frame. Wide tables have <point>_x and <point>_y instead.
FRAMES = "file string, point string, frame int, x double, y double, likelihood double"


@dataclass(frozen=True)
class OftConfig:
    """Open field. Lengths in cm, times in s."""

    fps: float = 30.0
    arena_cm: float = 49.0
    centre_scale: float = 0.5
    periphery_scale: float = 0.8
    corner_scale: float = 0.4
    likelihood: float = 0.90
    jump_cm: float = 15.0
    move_cm_s: float = 5.0
    integration: int = 5
    immobility_s: float = 1.0
    bin_s: float = 60.0
    epoch_s: float = 300.0
    wall_cm: tuple[float, ...] = (5.0, 10.0)
    grid: int = 10
    slow_cm_s: float = 2.0
    fast_cm_s: float = 10.0
    sustained_s: tuple[float, ...] = (1.0, 3.0)
    burst_cm_s: float = 20.0
    burst_s: float = 0.2


@dataclass(frozen=True)
class SocIntConfig:
    """Two animals. Distances in the units of the track."""

    fps: float = 30.0
    contact: float = 30.0
    side: float = 80.0
    close: float = 80.0
    medium: float = 160.0
    facing_deg: float = 60.0
    parallel_deg: float = 45.0
    anti_deg: float = 135.0
    move: float = 5.0
    lag_s: float = 1.0
    follow: float = 120.0
    avoid_start: float = 80.0
    avoid_delta: float = 40.0
    approach_start: float = 20.0
    approach_delta: float = 5.0
    retreat_start: float = 10.0
    retreat_delta: float = 5.0
    max_gap: int = 30
    jump: float = 100.0
    missing: float = 0.20
    min_event_frames: int = 3
    proximity: tuple[float, ...] = (0.0, 5.0, 10.0, 20.0, 40.0)

    @property
    def lag(self) -> int:
        return max(1, round(self.lag_s * self.fps))


@dataclass(frozen=True)
class MotifConfig:
    window_s: float = 5.0
    step_s: float = 5.0
    valid: float = 0.70
    variance: float = 0.85
    components: tuple[int, int] = (2, 10)
    clusters: tuple[int, int] = (2, 8)
    starts: int = 100
    kmeans_steps: int = 100
    seed: int = 123
    high: float = 0.67
    low: float = 0.33

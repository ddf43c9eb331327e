"""Parameters of the labeling engine; the defaults are those of the published pipeline at 200 Hz."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Breathing:
    min_peak_dist_sec: float = 0.8
    min_peak_prom: float = 0.2
    min_num_peaks: int = 3
    smooth_sec: float = 0.25
    trough_method: str = "min"
    trough_prct: float = 5.0


@dataclass(frozen=True)
class Oxygen:
    floor: float = 90.0
    drop: float = 3.0
    min_dur_sec: float = 10.0


@dataclass(frozen=True)
class Shallow:
    win_sec: int = 60
    ratio_low: float = 0.20
    ratio_high: float = 0.35
    min_dur_sec: float = 30.0


@dataclass(frozen=True)
class Irregular:
    win_sec: int = 60
    cov: float = 0.3
    rmssd: float = 0.5
    min_dur_sec: float = 30.0
    pause_sec: float = 10.0


@dataclass(frozen=True)
class Rate:
    """Slow and rapid breathing."""

    rr_bpm: float
    win_sec: int = 60
    min_dur_sec: float = 30.0
    classify_depth: bool = True
    shallow_low: float = 0.20
    shallow_high: float = 0.35
    mark_desat: bool = True
    desat_delay_sec: float = 20.0


@dataclass(frozen=True)
class Apnea:
    win_sec: int = 30
    ratio: float = 0.10
    min_dur_sec: float = 10.0
    mark_desat: bool = True
    desat_lag_sec: float = 45.0
    desat_pad_sec: float = 0.0


@dataclass(frozen=True)
class Sigh:
    prev_win_sec: int = 60
    ratio: float = 1.5
    min_prev_breaths: int = 3
    use_either_belt: bool = True
    freq_win_sec: float = 1800.0
    freq_count: int = 7
    merge_tol_sec: float = 0.5
    freq_step_sec: int = 60


@dataclass(frozen=True)
class Config:
    fs: int = 200
    baseline_sec: int = 60
    grid_step_sec: int = 1
    merge_gap_sec: float = 0.0
    resp: Breathing = field(default_factory=Breathing)
    spo2: Oxygen = field(default_factory=Oxygen)
    shallow: Shallow = field(default_factory=Shallow)
    irregular: Irregular = field(default_factory=Irregular)
    slow: Rate = field(default_factory=lambda: Rate(rr_bpm=10.0))
    rapid: Rate = field(default_factory=lambda: Rate(rr_bpm=20.0))
    apnea: Apnea = field(default_factory=Apnea)
    sigh: Sigh = field(default_factory=Sigh)

    def __post_init__(self) -> None:
        if self.fs <= 0 or self.grid_step_sec <= 0:
            raise ValueError("fs and grid_step_sec must be positive")
        if self.resp.trough_method not in ("min", "prctile"):
            raise ValueError(f"unknown trough_method {self.resp.trough_method!r}")

    @property
    def smooth_rows(self) -> int:
        """Rows of the centred moving mean; 0 turns it off."""
        return max(1, half_up(self.resp.smooth_sec * self.fs)) if self.resp.smooth_sec > 0 else 0

    @property
    def peak_dist_rows(self) -> int:
        return max(1, half_up(self.resp.min_peak_dist_sec * self.fs))

    @property
    def grid_rows(self) -> int:
        """Samples from one grid point to the next."""
        return self.grid_step_sec * self.fs

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def half_up(x: float) -> int:
    """Rounds halves away from zero."""
    return int(x + 0.5) if x >= 0 else -int(-x + 0.5)


#: For the driver's ``events`` table, read as recordings of one sample a second (see sources.adapter).
EVENTS_PROFILE = Config(
    fs=1,
    resp=Breathing(min_peak_dist_sec=2, min_peak_prom=2000.0, smooth_sec=3),
    spo2=Oxygen(floor=88.0, drop=3.0, min_dur_sec=3),
    shallow=Shallow(win_sec=30, min_dur_sec=10),
    irregular=Irregular(win_sec=30, cov=0.45, rmssd=4.0, min_dur_sec=10, pause_sec=25),
    slow=Rate(rr_bpm=10.0, win_sec=30, min_dur_sec=10),
    rapid=Rate(rr_bpm=12.0, win_sec=30, min_dur_sec=10),
    apnea=Apnea(win_sec=30, ratio=0.9, min_dur_sec=5),
    sigh=Sigh(prev_win_sec=30),
)

"""Parameters of the operators; defaults suit bicycle tracks in metres and seconds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SplitParams:
    max_gap_s: int = 120
    max_speed_mps: float = 12.0
    max_step_m: float = 1000.0


@dataclass(frozen=True)
class TrackFilterParams:
    min_points: int = 3
    min_duration_s: int = 60
    max_duration_s: int = 3600
    min_range_m: float = 150.0
    slow_speed_mps: float = 0.5
    max_slow_share: float = 0.6
    max_mean_speed_mps: float = 7.0


@dataclass(frozen=True)
class TripParams:
    min_duration_s: int = 60
    max_duration_s: int = 3600
    band_edges_m: tuple[float, float] = (1000.0, 3000.0)


@dataclass(frozen=True)
class MatchParams:
    candidates: int = 5
    radius_m: float = 60.0
    sigma_m: float = 25.0
    beta_m: float = 40.0
    contraflow_penalty: float = 0.75
    no_path_cost: float = 20.0
    backtrack_m: float = 10.0
    cutoff_m: float = 400.0
    min_match_rate: float = 0.8
    min_length_m: float = 100.0
    max_inferred_share: float = 0.3


@dataclass(frozen=True)
class DebounceParams:
    min_length_m: float = 100.0
    min_match_points: int = 2


@dataclass(frozen=True)
class NullParams:
    min_observed: int = 5
    fdr: float = 0.05


@dataclass(frozen=True)
class CommunityParams:
    markov_time: float = 1.0
    trials: int = 20
    seed: int = 42


@dataclass(frozen=True)
class SequenceParams:
    min_length: int = 2
    max_length: int = 10
    support_ratio: float = 0.0002
    support_floor: int = 10

"""Thresholds of the survey's operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Ratios between a found and a true period, and between a period and the orbit.
ALIAS_RATIOS = (1 / 3, 1 / 2, 2 / 3, 1.0, 3 / 2, 2.0, 3.0)
ALIAS_NAMES = ("one_third_period_alias", "half_period_alias", "two_thirds_period_alias", "exact", "three_halves_period_alias", "double_period_alias", "triple_period_alias")
ORBIT_RATIOS = ((1, 4), (1, 3), (1, 2), (2, 3), (3, 4), (1, 1), (3, 2), (2, 1))
ORBIT_DAYS = 13.70
JULIAN_OFFSET = 2_457_000.0
JULIAN_FLOOR = 2_000_000.0

# Status slugs with stage and precedence; a later stage outranks, then precedence.
STATUSES = (
    ("searched", 0, 0), ("no_transit_detected", 0, 0), ("screened_rejected", 0, 0), ("single_event_lead", 0, 1),
    ("automated_survivor", 0, 1), ("search_error", 0, 0), ("known_eb_rediscovery", 1, 2), ("known_eb_host_residual_review", 1, 1),
    ("known_variable_star_review", 1, 0), ("crowding_contamination_review", 1, 0), ("catalog_coverage_gap", 1, 0), ("context_incomplete", 1, 0),
    ("unresolved_transit_like_signal", 1, 2), ("pixel_offset_contamination", 2, 0), ("single_sector_unconfirmed", 2, 0), ("science_vetted_lead", 2, 0),
    ("packet_ready_for_review", 2, 1), ("common_mode_systematic", 3, 0), ("localized_coincidence", 3, 0), ("search_artifact_rejected", 3, 1),
    ("rediscovery", 4, 0), ("known_tce_rediscovery", 4, 0), ("false_positive", 4, 0), ("vetted_candidate", 4, 1), ("confirmed_planet", 4, 2),
)


@dataclass(frozen=True)
class Search:
    snr_min: float = 7.1
    min_transits: int = 2
    sigma_max: float = 3.0
    duty_max: float = 0.15
    depth_max_ppm: float = 50_000.0
    alias_tolerance: float = 0.01
    alias_margin: float = 1.1
    near_tie: float = 1e-3
    separation: float = 0.02
    harmonic_tolerance: float = 0.03
    duration_span: tuple[float, float] = (0.3, 1.5)
    duration_points: int = 8
    duration_hours: tuple[float, float] = (0.5, 12.0)
    min_period: float = 0.5
    overscan: float = 0.08


@dataclass(frozen=True)
class Vetoes:
    density_flag: tuple[float, float] = (0.4, 1.5)
    density_kill: tuple[float, float] = (0.25, 2.5)
    radius_max_rjup: float = 2.0
    per_event: int = 3
    exclusion: float = 1.5
    median_factor: float = 1.2533141373155003  # sqrt(pi / 2)


@dataclass(frozen=True)
class Population:
    enrichment: float = 10.0
    shared: int = 10
    fraction: float = 0.005
    spread_deg: float = 1.0
    bin_minutes: float = 30.0
    sigma: float = 3.0
    dip_fraction: float = 0.10
    dip_stars: int = 20
    alpha: float = 0.05
    own_events: float = 0.5


SEARCH, VETOES, POPULATION = Search(), Vetoes(), Population()

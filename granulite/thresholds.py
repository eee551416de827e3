"""Keyword thresholds with their defaults, one frozen profile per check."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # exposure
    white_thr: float = 250.0
    frac_white_thr: float = 0.20
    over_p95: float = 250.0
    under_p95_thr: float = 30.0
    under_dr_thr: float = 30.0
    # uniformity: blur size used before the spread is measured, 0 for none
    uniform_std_thr: float = 10.0
    stats_blur: int = 5
    # pattern test
    pattern_scale: float = 0.10
    pattern_pre_blur: int = 11
    p10_zoom_thr: float = 60.0
    dabs_sus_thr: float = 10.0
    span_thr: float = 25.0
    hp_thr: float = 2.5
    sobel_p90_thr: float = 10.0
    edge_act_empty_thr: float = 0.002
    edge_act_tex_thr: float = 0.010
    v_corr_abs_thr: float = 0.55
    v_mono_thr: float = 0.60
    hp_sigma: float = 12.0
    hp_clip: tuple = (0.05, 0.95)
    act_k: float = 6.0
    vignette_blur: int = 31
    vignette_bins: int = 24
    # position
    otsu_blur: int = 5
    margin_px: int = 2
    min_area_ratio: float = 0.001
    box_pad: int = 20
    ring_width: int = 5
    min_edge_strength: float | None = None
    check_round: bool = True
    round_margin: int = 15
    round_step: int = 12
    round_angle: float = 55.0
    round_max_sharp: int = 20
    round_min_used: int = 20
    round_downsample: int = 4


AUTOMATIC = Thresholds(stats_blur=0)
CHECK_ONLY = Thresholds(otsu_blur=0, check_round=False)
MANUAL = Thresholds(stats_blur=0, min_edge_strength=10.0)

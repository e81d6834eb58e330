"""Settings of the operators. Defaults are fixed values of the sensor set-up that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Slack of every geometric comparison, in metres.
TOLERANCE = 1e-6
#: Columns that name a frame; every per-frame operator groups by them.
FRAME = ["source_id", "frame_index"]
ZONES = {0: "UNKNOWN", 1: "CORE", 2: "MARGIN", 3: "OUTSIDE_REFERENCE"}
RAIL_METHODS = ("development_candidate", "baseline")
EXTENSIONS = ("tangent", "observed", "arc_limited", "arc_clamped")
FILTERS = ("baseline_v3", "legacy", "baseline_v3_assist_score")
DETAILS = ("summary", "full")


@dataclass(frozen=True)
class Rails:
    forward_min: float = 2.0
    forward_max: float = 80.0
    station_length: float = 2.0
    lateral_min: float = -4.0
    lateral_max: float = 4.0
    cell_width: float = 0.04
    min_cell_points: int = 2
    floor_quantile: float = 0.2
    cell_floor_quantile: float = 0.1
    floor_band_below: float = 0.35
    floor_band_above: float = 0.7
    head_quantile: float = 0.9
    head_band: float = 0.025
    flank_min: float = 0.12
    flank_max: float = 0.32
    min_flank_cells: int = 2
    min_prominence: float = 0.065
    max_prominence: float = 0.4
    peak_separation: float = 0.22
    pair_min: float = 1.4
    pair_max: float = 1.8
    max_cross_height: float = 0.25
    min_stations: int = 6
    min_span: float = 10.0
    max_gap: float = 6.0
    min_coverage: float = 0.65
    max_slope: float = 0.12
    lateral_tolerance: float = 0.1
    height_tolerance: float = 0.1
    max_rms: float = 0.055
    ambiguity_ratio: float = 0.85
    #: None: stations of any number of pairs are searched.
    max_pairs_per_station: int | None = 8
    max_seed_pairs: int = 10_000

    def reason(self) -> str | None:
        """Why a search with these settings can't run; None if it can."""
        ok = (
            self.forward_max > self.forward_min and self.lateral_max > self.lateral_min and min(self.station_length, self.cell_width, self.min_span, self.max_gap, self.pair_min) > 0
            and self.min_stations >= 3 and min(self.min_cell_points, self.min_flank_cells) >= 1 and self.pair_max >= self.pair_min
            and min(self.lateral_tolerance, self.height_tolerance) > 0 and 0 < self.min_coverage <= 1 and 0 < self.ambiguity_ratio <= 1
        )
        return None if ok else "INVALID_SEARCH_PARAMETERS"


@dataclass(frozen=True)
class Bounds:
    left: float
    right: float
    bottom: float
    top: float

    def within(self, other: Bounds) -> bool:
        return other.left <= self.left < self.right <= other.right and other.bottom <= self.bottom < self.top <= other.top


CORE = Bounds(-1.4, 1.4, 0.0, 3.7)
EXPANDED = Bounds(-1.9, 1.9, -0.5, 4.2)


def with_margins(extent: Bounds, left: float = 0.5, right: float = 0.5, bottom: float = 0.5, top: float = 0.5) -> Bounds:
    """Profile bounds: an extent and a margin on each side."""
    return Bounds(extent.left - left, extent.right + right, extent.bottom - bottom, extent.top + top)


@dataclass(frozen=True)
class Objects:
    forward_min: float = 0.0
    forward_max: float = 200.0
    search_half_width: float = 1.9
    floor_half_width: float = 1.8
    floor_forward_max: float = 60.0
    floor_bin: float = 10.0
    floor_quantile: float = 0.1
    floor_min_points: int = 200
    floor_min_bins: int = 4
    max_grade: float = 0.1
    max_residual: float = 0.4
    min_height: float = 0.35
    max_height: float = 2.8
    voxel: float = 0.2
    min_points: int = 5
    max_horizontal_extent: float = 3.0
    max_voxels: int = 50_000


@dataclass(frozen=True)
class Config:
    """The options of a whole run."""

    rails: Rails = field(default_factory=Rails)
    rail_method: str = "development_candidate"
    core: Bounds = CORE
    expanded: Bounds = EXPANDED
    extension: str = "tangent"
    arc_horizon: float = 0.0
    arc_min_radius: float = 60.0
    arc_max_turn_deg: float = 8.0
    arc_window: int = 5
    noise_filter: str = "baseline_v3"
    radius: float = 0.25
    model_frames: int = 2
    early_frames: int = 3
    dedupe: bool = True
    detail: str = "summary"

    def reason(self) -> str | None:
        """The first reason why this can't run; None if it can."""
        checks = [
            (self.core.within(self.expanded), "INVALID_ENVELOPE"),
            (self.noise_filter in FILTERS, "INVALID_NOISE_FILTER_MODE"),
            (self.detail in DETAILS, "INVALID_DIAGNOSTICS_DETAIL"),
            (self.rail_method in RAIL_METHODS, "INVALID_RAIL_SELECTION_METHOD"),
            (self.extension in EXTENSIONS, "INVALID_FORWARD_EXTENSION_METHOD"),
            (self.arc_horizon >= 0, "INVALID_ARC_EXTENSION_HORIZON"),
            (self.arc_min_radius > 0 and self.arc_max_turn_deg > 0, "INVALID_ARC_CLAMP_PARAMETERS"),
            (self.arc_window >= 3, "INVALID_ARC_FIT_WINDOW"),
        ]
        return next((reason for ok, reason in checks if not ok), self.rails.reason())

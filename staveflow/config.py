"""Detection settings: ratios of the staff-line spacing unless said otherwise."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Defaults and the two presets.


@dataclass(frozen=True)
class DetectionConfig:
    staff_same_system_spacing_ratio: float = 2.5
    barline_max_extension_ratio: float = 2.5
    barline_roi_margin_ratio: float = 0.25
    barline_top_margin_ratio: float = 0.7
    barline_bottom_margin_ratio: float = 0.7
    barline_max_allowed_extension_ratio: float = 1.2
    hough_min_line_length_ratio: float = 0.5
    hough_max_line_gap_ratio: float = 0.3
    hough_max_barline_length_ratio: float = 2.0
    staff_system_grouping_ratio: float = 2.5
    system_group_clustering_ratio: float = 8.0
    barline_consensus_tolerance: float = 0.5
    min_consensus_ratio: float = 0.8

    def __post_init__(self) -> None:
        if self.barline_max_allowed_extension_ratio < 0.5:
            raise ValueError("barline_max_allowed_extension_ratio is under 0.5")
        if self.staff_same_system_spacing_ratio < 1.0:
            raise ValueError("staff_same_system_spacing_ratio is under 1.0")

    def with_margins(self, factor: float) -> DetectionConfig:
        """All four margins of barlines times a factor: top, bottom, extension and that around staff lines."""
        names = ("barline_top_margin_ratio", "barline_bottom_margin_ratio", "barline_max_allowed_extension_ratio", "barline_roi_margin_ratio")
        return replace(self, **{n: getattr(self, n) * factor for n in names})

    def description(self) -> str:
        """The settings as text, in the groups of GROUPS."""
        lines = []
        for title, prefixes in GROUPS.items():
            lines += [title, *(f"  {f.name}: {getattr(self, f.name):g}" for f in fields(self) if f.name.startswith(prefixes))]
        return "\n".join(lines)


#: Headings of the description, and how the names of their settings begin.
GROUPS = {
    "staff lines": ("staff_same",),
    "barlines": ("barline_top", "barline_bottom", "barline_max", "barline_roi"),
    "line search": ("hough",),
    "staff systems": ("staff_system",),
    "agreement of systems": ("system_group", "barline_consensus", "min_consensus"),
}

DEFAULT = DetectionConfig()
STRICT = DetectionConfig(barline_top_margin_ratio=0.5, barline_bottom_margin_ratio=0.5, barline_max_allowed_extension_ratio=1.0, barline_roi_margin_ratio=0.2, hough_min_line_length_ratio=0.6)
RELAXED = DetectionConfig(barline_top_margin_ratio=1.0, barline_bottom_margin_ratio=1.0, barline_max_allowed_extension_ratio=1.5, barline_roi_margin_ratio=0.3, hough_min_line_length_ratio=0.3)

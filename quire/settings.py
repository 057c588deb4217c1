"""Thresholds of the layout rules as settings; defaults are fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    """Shares of page width, line height or other sizes that decide how words become blocks and blocks paragraphs."""

    column_gap: float = 0.04
    column_words: int = 3
    column_span: float = 0.25
    noise_side: float = 0.1
    noise_aspect: float = 1.4
    noise_length: int = 3
    grouping_gap: float = 3.2
    continuation_gap: float = 1.8
    line_gap: float = 1.35
    left_align: float = 1.6
    right_align: float = 2.4
    overlap: float = 0.3
    horizontal_gap: float = 4.5
    range_relation: float = 4.0
    min_width: float = 10.0
    wrap_forward: float = 6.5
    wrap_backward: float = 5.0


@dataclass(frozen=True)
class Recognition:
    """When a page is recognised anew, which words count, and how they become lines, columns and blocks."""

    render_scale: float = 2.0
    native_words: int = 8
    sparse_coverage: float = 0.025
    sparse_blocks: int = 3
    confidence: float = 35.0
    merge_gap: float = 0.95
    merge_indent: float = 1.2
    merge_width: float = 0.55
    column_centre: float = 0.12
    column_left: float = 0.08
    column_overlap: float = 0.35


LAYOUT, RECOGNITION = Layout(), Recognition()

"""Arithmetic of a viewer: zoom steps, what is on screen, totals of a run of steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zoom presets in percent, the step of a wheel and the bounds of zooming.
PRESETS = (10, 25, 50, 75, 100, 125, 150, 200, 300, 400)
WHEEL_STEP, LEAST_ZOOM, MOST_ZOOM = 12, 10, 400
#: A page of which less is visible is jumped to.
JUMP_BELOW = 0.3


def _presets() -> Column:
    return F.array(*[F.lit(z) for z in PRESETS])


def zoom_in(zoom: Column) -> Column:
    """the next preset, null where there is none."""
    return F.array_min(F.filter(_presets(), lambda z: z > zoom))


def zoom_out(zoom: Column) -> Column:
    """the preset before, null where there is none."""
    return F.array_max(F.filter(_presets(), lambda z: z < zoom))


def presets_with(zoom: Column) -> Column:
    """the presets and the zoom itself, in order."""
    return F.array_sort(F.array_union(_presets(), F.array(zoom)))


def wheel(zoom: Column, notches: int) -> Column:
    """So many notches of a wheel, clamped."""
    return F.least(F.greatest(zoom + notches * WHEEL_STEP, F.lit(LEAST_ZOOM)), F.lit(MOST_ZOOM))


def visible_pages(mean_height: Column, scale: float, gap: float, window: float) -> Column:
    """How many pages of a mean height a window shows, begun ones too."""
    return F.ceil(window / (mean_height * scale + gap)).cast("long")


def in_render_window(page: Column, current: Column, visible: Column) -> Column:
    """Within two pages of the current one, or as many as are visible and one more."""
    return F.abs(page - current) <= F.greatest(F.lit(2), visible + 1)


def visible_ratio(top: Column, height: Column, window_top: Column, window_bottom: Column) -> Column:
    """The part of a page's slot that is in the window."""
    return F.greatest(F.least(top + height, window_bottom) - F.greatest(top, window_top), F.lit(0.0)) / height


def top_visible(page: Column) -> Column:
    """F07, as an aggregate: the first of the visible pages."""
    return F.min(page)


def run_totals(before: Column, after: Column, step: Column) -> tuple[Column, Column]:
    """D15, as aggregates: what the first step found and what the last one left."""
    return F.min_by(before, step), F.max_by(after, step)

"""Rectangles, affine matrices and pixel boxes as column expressions.

A rectangle is a struct (x, y, width, height) with its origin at the top left; a box a
struct (x0, y0, x1, y1); a matrix a struct (a, b, c, d, e, f) of the affine map
x' = a x + c y + e, y' = b x + d y + f.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rectangles overlap when they share more than so many points in both directions.
LEAST_OVERLAP = 1.0
#: The page size where a page has no box at all, and the least side of a drawn region.
DEFAULT_BOX, LEAST_REGION = (0.0, 0.0, 612.0, 792.0), 2.0


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def matrix(*v) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).alias(n) for n, x in zip("abcdef", v)])


def right(r: Column) -> Column:
    return r["x"] + r["width"]


def bottom(r: Column) -> Column:
    return r["y"] + r["height"]


def overlaps(a: Column, b: Column, least: float = LEAST_OVERLAP) -> Column:
    """The rectangles share more than ``least`` points in both directions."""
    across = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    down = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return (across > least) & (down > least)


def union_rect(a: Column, b: Column) -> Column:
    """The least rectangle around two."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return rect(x, y, F.greatest(right(a), right(b)) - x, F.greatest(bottom(a), bottom(b)) - y)


def shares_line(a: Column, b: Column) -> Column:
    """Vertical overlap of more than half the lower one's height."""
    return F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"]) > 0.5 * F.least(a["height"], b["height"])


def contains_point(r: Column, x: Column, y: Column) -> Column:
    """Borders count as inside."""
    return (x >= r["x"]) & (x <= right(r)) & (y >= r["y"]) & (y <= bottom(r))


def clip_region(r: Column, page: Column, zoom: Column) -> Column:
    """A rectangle on the screen as a region of its page, null when nearly nothing is left."""
    scale = zoom / 100.0
    left, top = F.greatest(r["x"], page["x"]), F.greatest(r["y"], page["y"])
    width = (F.least(right(r), right(page)) - left) / scale
    height = (F.least(bottom(r), bottom(page)) - top) / scale
    region = rect((left - page["x"]) / scale, (top - page["y"]) / scale, width, height)
    return F.when((scale > 0) & (width >= LEAST_REGION) & (height >= LEAST_REGION), region)


def drag_region(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The rectangle between two corners, null when a side is too short."""
    width, height = F.abs(x2 - x1), F.abs(y2 - y1)
    return F.when((width >= LEAST_REGION) & (height >= LEAST_REGION), rect(F.least(x1, x2), F.least(y1, y2), width, height))


def compose(m: Column, n: Column) -> Column:
    """First m, then n."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def invert(m: Column) -> Column:
    """Null entries for a matrix without an inverse."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    over = lambda x: F.try_divide(x, det)
    a, b, c, d = over(m["d"]), over(-m["b"]), over(-m["c"]), over(m["a"])
    return matrix(a, b, c, d, -(m["e"] * a + m["f"] * c), -(m["e"] * b + m["f"] * d))


def apply_x(m: Column, x: Column, y: Column) -> Column:
    """H36, first coordinate."""
    return m["a"] * x + m["c"] * y + m["e"]


def apply_y(m: Column, x: Column, y: Column) -> Column:
    """H36, second coordinate."""
    return m["b"] * x + m["d"] * y + m["f"]


def display_fit(page_w: Column, page_h: Column, ink: Column, scale: Column, padding: float) -> Column:
    """Ink box centred across the page and set below the upper margin."""
    dx = (page_w - scale * (ink["x1"] - ink["x0"])) / 2.0 - scale * ink["x0"]
    return matrix(scale, 0, 0, scale, dx, (page_h - padding) - scale * ink["y1"])


def user_to_display(rotate: Column, b: Column) -> Column:
    """From page space to the page as shown, by its rotation."""
    turn = F.pmod(rotate, F.lit(360))
    return (
        F.when(turn == 90, matrix(0, -1, 1, 0, -b["y0"], b["x1"]))
        .when(turn == 180, matrix(-1, 0, 0, -1, b["x1"], b["y1"]))
        .when(turn == 270, matrix(0, 1, -1, 0, b["y1"], -b["x0"]))
        .otherwise(matrix(1, 0, 0, 1, -b["x0"], -b["y0"]))
    )


def user_fit(display: Column, rotate: Column, b: Column) -> Column:
    """The display matrix carried over to page space."""
    r = user_to_display(rotate, b)
    return compose(compose(r, display), invert(r))


def effective_box(crop: Column, media: Column) -> Column:
    """Crop box, else media box, else the default page."""
    return F.coalesce(crop, media, box(*[F.lit(v) for v in DEFAULT_BOX]))


def map_rect(r: Column, m: Column) -> Column:
    """A box moved by a matrix, its corners put in order again."""
    ax, ay = apply_x(m, r["x0"], r["y0"]), apply_y(m, r["x0"], r["y0"])
    bx, by = apply_x(m, r["x1"], r["y1"]), apply_y(m, r["x1"], r["y1"])
    return box(F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by))


def pixels_to_points(left: Column, top: Column, r: Column, b: Column, bw: Column, bh: Column, pw: Column, ph: Column) -> Column:
    """A pixel box as a rectangle with its origin at the bottom left."""
    sx, sy = pw / bw, ph / bh
    return rect(left * sx, ph - b * sy, (r - left) * sx, (b - top) * sy)


def points_to_pixels(r: Column, pad: float, bw: Column, bh: Column, pw: Column, ph: Column) -> Column:
    """The pixels a padded region touches, null when there are none."""
    sx, sy = bw / pw, bh / ph
    x0 = F.greatest(F.floor((r["x"] - pad) * sx), F.lit(0))
    y0 = F.greatest(F.floor((r["y"] - pad) * sy), F.lit(0))
    x1 = F.least(F.ceil((right(r) + pad) * sx), bw.cast("long"))
    y1 = F.least(F.ceil((bottom(r) + pad) * sy), bh.cast("long"))
    return F.when((pw > 0) & (ph > 0) & (x1 > x0) & (y1 > y0), box(x0, y0, x1, y1))


def flip_y(r: Column, page_h: Column) -> Column:
    """Bottom-left to top-left origin and back."""
    return rect(r["x"], page_h - (r["y"] + r["height"]), r["width"], r["height"])


def corner_rect(x0: Column, y0: Column, x1: Column, y1: Column, page_h: Column) -> Column:
    """Any two corners in page space as a top-left rectangle."""
    return rect(F.least(x0, x1), page_h - F.greatest(y0, y1), F.abs(x1 - x0), F.abs(y1 - y0))


def ink_scale(page_w: Column, page_h: Column, ink: Column, padding: float) -> Column:
    """The scale that fills one page; null where the ink box is empty. D01 is its least."""
    bw, bh = ink["x1"] - ink["x0"], ink["y1"] - ink["y0"]
    wide = F.greatest(page_w - 2.0 * padding, F.lit(1.0)) / bw
    high = F.greatest(page_h - 2.0 * padding, F.lit(1.0)) / bh
    return F.when((bw > 0) & (bh > 0), F.least(wide, high))


def is_simple(ox: Column, oy: Column, rotate: Column) -> Column:
    """Origin at zero and not rotated."""
    return (F.abs(ox) < 0.5) & (F.abs(oy) < 0.5) & (F.pmod(rotate, F.lit(360)) == 0)


def highlight_box(r: Column, scale: Column, pad: float = 3.0, least_w: float = 6.0, least_h: float = 14.0) -> Column:
    """Padded, of a least size, centred on what it marks."""
    width = F.greatest(r["width"] * scale + pad * 2, F.lit(least_w))
    height = F.greatest(r["height"] * scale + pad * 2, F.lit(least_h))
    cx, cy = (r["x"] + r["width"] / 2) * scale, (r["y"] + r["height"] / 2) * scale
    return F.struct((cx - width / 2).alias("left"), (cy - height / 2).alias("top"), width.alias("width"), height.alias("height"))


def scroll_target(slot: Column, r: Column, zoom: Column, top: Column, client: Column) -> Column:
    """Where to scroll to centre a rectangle; null when it is in view."""
    scale = zoom / 100.0
    a = slot + r["y"] * scale
    b = a + r["height"] * scale
    return F.when((a >= top) & (b <= top + client), F.lit(None)).otherwise(F.greatest((a + b) / 2 - client / 2, F.lit(0.0)))


def fit_zoom(mode: Column, w: Column, h: Column, cw: Column, ch: Column, padding: float) -> Column:
    """Zoom in percent that fits a page to the window; null in numeric mode."""
    clamp = lambda z: F.greatest(F.least(F.floor(z + 0.5), F.lit(400)), F.lit(10))
    across, down = (cw - padding) / w * 100, (ch - padding) / h * 100
    return F.when(mode == "fit-width", clamp(across)).when(mode == "fit-width-90", clamp(across * 0.9)).when(mode != "numeric", clamp(down))

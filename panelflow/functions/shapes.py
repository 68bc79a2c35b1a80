"""Boxes and polygons in their forms: corners, centres, labels, windows, rotation, orientation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .steps import Steps


def clipped(x: str, y: str, w: str, h: str, width: int, height: int) -> Steps:
    """A box rounded to whole numbers (halves to the even one), within the page, one pixel at least."""
    whole = lambda e: f"CAST(round_even({e}, 0) AS BIGINT)"
    return [
        {"clip_x": f"greatest(0, least({whole(x)}, {max(0, width - 1)}))", "clip_y": f"greatest(0, least({whole(y)}, {max(0, height - 1)}))"},
        {"clip_w": f"greatest(clip_x + 1, least({whole(f'({x}) + ({w})')}, {width})) - clip_x", "clip_h": f"greatest(clip_y + 1, least({whole(f'({y}) + ({h})')}, {height})) - clip_y"},
    ]


def window(width: int, height: int, ratio: int = 8, sign: int = 1) -> Steps:
    """A box grown by a share of its sides for a closer look, within the page; ``sign`` -1 shrinks it."""
    return [
        {"grow": f"{sign} * CAST(round_even((greatest(h, w) * 0.25E0 + least(h, w) * 0.75E0) / {ratio}, 0) AS BIGINT)"},
        {"win_x1": "greatest(0, x - grow)", "win_y1": "greatest(0, y - grow)", "win_x2": f"least({width - 1}, x + w + grow)", "win_y2": f"least({height - 1}, y + h + grow)"},
    ]


def block_region(x1: str, y1: str, x2: str, y2: str, width: int, height: int) -> Steps:
    """A detected block as a box of the page; blocks of one pixel or less are not ``usable``."""
    return [
        {"bx1": f"greatest(0, least({x1}, {width - 1}))", "by1": f"greatest(0, least({y1}, {height - 1}))", "bx2": f"greatest(0, least({x2}, {width}))", "by2": f"greatest(0, least({y2}, {height}))"},
        {"bw": "bx2 - bx1", "bh": "by2 - by1"},
        {"usable": "bw > 1 AND bh > 1"},
    ]


def relative(width: int, height: int) -> Steps:
    """Centre and sides as shares of the page."""
    return [{"rel_cx": f"(x + w / 2.0E0) / {width}", "rel_cy": f"(y + h / 2.0E0) / {height}", "rel_w": f"w * 1.0E0 / {width}", "rel_h": f"h * 1.0E0 / {height}"}]


def absolute(width: int, height: int) -> Steps:
    """The corners again, cut to whole numbers."""
    return [
        {"abs_x1": f"CAST(floor(round(rel_cx * {width} - rel_w * {width} / 2.0E0, 6)) AS BIGINT)", "abs_y1": f"CAST(floor(round(rel_cy * {height} - rel_h * {height} / 2.0E0, 6)) AS BIGINT)"},
        {"abs_x2": f"CAST(floor(round(rel_cx * {width} + rel_w * {width} / 2.0E0, 6)) AS BIGINT)", "abs_y2": f"CAST(floor(round(rel_cy * {height} + rel_h * {height} / 2.0E0, 6)) AS BIGINT)"},
    ]


def corners() -> Column:
    """A box as eight numbers: x and y of its corners, clockwise from the upper left."""
    return F.expr("array(x, y, x + w, y, x + w, y + h, x, y + h)")


def rotated(polygon: str, cx: str, cy: str, degrees: str) -> Column:
    """A polygon of ``x, y, x, y, ..`` turned about a centre, cut to whole numbers."""
    s, c = f"sin(radians({degrees}))", f"cos(radians({degrees}))"
    px = lambda i: f"(cast({polygon}[{i}] as double) - {cx})"
    py = lambda i: f"(cast({polygon}[{i}] as double) - {cy})"
    turned = f"if(i % 2 = 0, {py('i + 1')} * {s} + {px('i')} * {c} + {cx}, {py('i')} * {c} - {px('i - 1')} * {s} + {cy})"
    turned = turned.replace(f"{polygon}[i + 1]", f"get({polygon}, i + 1)").replace(f"{polygon}[i - 1]", f"get({polygon}, i - 1)")
    return F.expr(f"transform(sequence(0, size({polygon}) - 1), i -> cast(trunc_zero(round({turned}, 6)) as bigint))".replace("trunc_zero(", "("))


#: Orientation of a block from the sums of its lines' middle axes ``vx, vy`` (down) and ``hx, hy`` (across) over ``lines`` lines.
ORIENTATION: Steps = [
    {"norm_v": "sqrt(vx * vx + vy * vy * 1.0E0)", "norm_h": "sqrt(hx * hx + hy * hy * 1.0E0)"},
    {"upright": "CASE WHEN language = 'ja' THEN norm_v > norm_h ELSE norm_v > 2 * norm_h END"},
    {"font": "CAST(round_even(CASE WHEN upright THEN norm_h ELSE norm_v END / lines, 0) AS BIGINT)", "turn": "CASE WHEN upright THEN atan2(vy * 1.0E0, vx * 1.0E0) ELSE atan2(hy * 1.0E0, hx * 1.0E0) END / pi() * 180"},
    {"angle0": "CAST(CASE WHEN turn < 0 THEN ceil(turn) ELSE floor(turn) END AS BIGINT) - CASE WHEN upright THEN 90 ELSE 0 END"},
    {"angle": "CASE WHEN abs(angle0) < 3 THEN 0 ELSE angle0 END"},
]
#: Distance of a line's centre ``px, py`` from the line through the origin ``ox, oy`` along ``dx, dy``.
LINE_DISTANCE = "abs((px - ox) * dy - (py - oy) * dx) / greatest(0.000001E0, sqrt(dx * dx + dy * dy * 1.0E0))"

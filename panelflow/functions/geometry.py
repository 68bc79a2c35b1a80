"""Box arithmetic as SQL expressions over ``<p>x, <p>y, <p>w, <p>h`` columns; the text is portable."""

from __future__ import annotations


def overlap(a: str, b: str, at: str, size: str) -> str:
    return f"greatest(0, least({a}{at} + {a}{size}, {b}{at} + {b}{size}) - greatest({a}{at}, {b}{at}))"


def intersection(a: str = "a.", b: str = "b.") -> str:
    return f"({overlap(a, b, 'x', 'w')} * {overlap(a, b, 'y', 'h')})"


def area(a: str = "a.") -> str:
    return f"(greatest(0, {a}w) * greatest(0, {a}h))"


def iou(a: str = "a.", b: str = "b.") -> str:
    union = f"({area(a)} + {area(b)} - {intersection(a, b)})"
    return f"(CASE WHEN {union} <= 0 THEN 0.0 ELSE {intersection(a, b)} * 1.0E0 / {union} END)"


def iom(a: str = "a.", b: str = "b.") -> str:
    """Intersection over the smaller area."""
    return f"({intersection(a, b)} * 1.0E0 / greatest(1, least({area(a)}, {area(b)})))"


def containment(inner: str, outer: str) -> str:
    return f"({intersection(inner, outer)} * 1.0E0 / greatest(1, {area(inner)}))"


def max_containment(a: str = "a.", b: str = "b.") -> str:
    return f"greatest({containment(a, b)}, {containment(b, a)})"


def area_ratio(a: str = "a.", b: str = "b.") -> str:
    return f"(least({area(a)}, {area(b)}) * 1.0E0 / greatest(1, greatest({area(a)}, {area(b)})))"


def center_distance(a: str = "a.", b: str = "b.") -> str:
    dx = f"(({a}x + {a}w / 2.0E0) - ({b}x + {b}w / 2.0E0))"
    dy = f"(({a}y + {a}h / 2.0E0) - ({b}y + {b}h / 2.0E0))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def max_side(a: str = "a.", b: str = "b.") -> str:
    return f"greatest(1, greatest(greatest({a}w, {a}h), greatest({b}w, {b}h)))"


def near(a: str = "a.", b: str = "b.", pad: int = 8) -> str:
    """Touching, or within ``pad`` of the first box."""
    return f"({a}x - {pad} <= {b}x + {b}w AND {b}x <= {a}x + {a}w + {pad} AND {a}y - {pad} <= {b}y + {b}h AND {b}y <= {a}y + {a}h + {pad})"


def axis_overlap(a: str = "a.", b: str = "b.") -> str:
    y = f"({overlap(a, b, 'y', 'h')} * 1.0E0 / greatest(1, least({a}h, {b}h)))"
    x = f"({overlap(a, b, 'x', 'w')} * 1.0E0 / greatest(1, least({a}w, {b}w)))"
    return f"(CASE WHEN {a}vertical AND {b}vertical THEN {y} WHEN NOT {a}vertical AND NOT {b}vertical THEN {x} ELSE 0.0 END)"


def gap_ratio(a: str = "a.", b: str = "b.") -> str:
    dx = f"greatest(0, greatest({a}x, {b}x) - least({a}x + {a}w, {b}x + {b}w))"
    dy = f"greatest(0, greatest({a}y, {b}y) - least({a}y + {a}h, {b}y + {b}h))"
    return f"(greatest({dx}, {dy}) * 1.0E0 / greatest(1, least(greatest({a}w, {a}h), greatest({b}w, {b}h))))"


def should_group(a: str = "a.", b: str = "b.") -> str:
    """Whether two regions belong to one text group (without the mask term, which needs pixels)."""
    r, dist = area_ratio(a, b), f"({center_distance(a, b)} / {max_side(a, b)})"
    cross = f"(CASE WHEN {a}vertical THEN {overlap(a, b, 'x', 'w')} * 1.0E0 / greatest(1, least({a}w, {b}w)) ELSE {overlap(a, b, 'y', 'h')} * 1.0E0 / greatest(1, least({a}h, {b}h)) END)"
    return (
        f"(CASE WHEN {iom(a, b)} >= 0.15 THEN CASE WHEN {r} < 0.08 THEN false "
        f"WHEN {max_containment(a, b)} >= 0.82 AND {r} < 0.22 AND {dist} > 0.35 THEN false "
        f"WHEN {a}vertical <> {b}vertical AND {r} < 0.55 THEN false ELSE true END "
        f"ELSE {a}vertical = {b}vertical AND {near(a, b)} AND {dist} <= 1.2 AND {cross} >= 0.20 END)"
    )


def render_conflict(a: str = "a.", b: str = "b.") -> str:
    """Whether two groups would be drawn over one another (box terms)."""
    c, r = max_containment(a, b), area_ratio(a, b)
    return f"(({iom(a, b)} >= 0.78 AND {r} >= 0.50) OR ({c} >= 0.88 AND {r} >= 0.55) OR ({a}vertical = {b}vertical AND {c} >= 0.92 AND {r} >= 0.08))"


def signed_overlap(a: str = "a.", b: str = "b.") -> str:
    """Overlap area where touching boxes give 0 and boxes apart give -1."""
    dx = f"(least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x))"
    dy = f"(least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y))"
    return f"(CASE WHEN {dx} < 0 OR {dy} < 0 THEN -1 ELSE {dx} * {dy} END)"


def reading_pad(ratio: str, least: str, p: str = "") -> str:
    """Margin of a box for recognition; halves go to the even number."""
    side = f"greatest({p}w, {p}h)"
    return f"greatest({least}, CAST(round_even({side} * {ratio}, 0) AS BIGINT))"

"""How the original text was set, and every way to set its translation in the same place.

Fonts are not here: a glyph is a square of the font size (``GLYPH``) and a line as high as the font
size times ``LINE``. All costs and clamps are chains of expressions that other SQL engines read too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import Steps, apply

# Limits of fonts, steps and padding.
MIN_FONT, MAX_FONT, GROWTH, SHRINK, KEEP = 10, 180, 1.15, 0.85, 0.92
GLYPH, LINE, CHAR_SPACING, LINE_SPACING, PADDING = 1.0, 1.2, 1.03, 1.02, 2
CHAR_STEP, COLUMN_STEP, LEAST_PER_COLUMN = (0.88, 1.32), (0.92, 2.35), 2
LAYOUT_PADDING, LAYOUT_PADDING_RATIO = 2, 0.18


def font_hint() -> Column:
    """Aggregate of a group's regions: median of the plausible hints of the first detector's regions, else of all."""
    plausible = "font_hint BETWEEN 4 AND 300"
    return F.expr(f"coalesce(median(font_hint) FILTER (WHERE source = 'ctd' AND {plausible}), median(font_hint) FILTER (WHERE {plausible}))")


def parts_hint() -> Column:
    """The same of a group's regions as an array ``parts``; most groups are one region, which needs no sorting."""
    ranked = "array_sort(transform(filter(parts, m -> m.font_hint BETWEEN 4 AND 300{0}), m -> m.font_hint))"
    middle = "transform(array({0}), s -> if(size(s) = 0, null, (s[int((size(s) - 1) / 2)] + s[int(size(s) / 2)]) / 2.0D))[0]"
    of_first, of_all = (middle.format(ranked.format(some)) for some in (" AND m.source = 'ctd'", ""))
    return F.expr(f"CASE WHEN size(parts) = 1 THEN if(get(parts, 0).font_hint BETWEEN 4 AND 300, get(parts, 0).font_hint, null) ELSE coalesce({of_first}, {of_all}) END")


def char_size(regions: DataFrame, short_side: int) -> DataFrame:
    """``page_id, char_size``: median of plausible hints, else a share of the page's short side."""
    hints = regions.groupBy("page_id").agg(F.expr("median(font_hint) FILTER (WHERE font_hint BETWEEN 4 AND 256)").alias("m"))
    return hints.select("page_id", F.expr(f"cast(if(m is null, greatest(8, bround({short_side} * 0.018D)), greatest(6, bround(m))) as bigint)").alias("char_size"))


#: Size of the original text from the detector's ``hint`` and the ``mask_hint`` (either may be null).
PREFERRED: Steps = [
    {"blend": "CASE WHEN hint IS NULL THEN mask_hint WHEN mask_hint IS NULL THEN hint WHEN hint / greatest(1.0E0, mask_hint) BETWEEN 0.62E0 AND 1.55E0 THEN hint * 0.72E0 + mask_hint * 0.28E0 ELSE mask_hint END"},
    {"plain": "greatest(8.0E0, least(CASE WHEN vertical THEN w ELSE h END, (CASE WHEN vertical THEN h ELSE w END) / 3.0E0))"},
    {"p": "CASE WHEN blend IS NULL OR blend <= 0 THEN plain ELSE greatest(4.0E0, least(300.0E0, blend)) END"},
]


def axis_centres(groups: DataFrame) -> DataFrame:
    """Groups with ``centres``: places of columns (or lines) of a group, close ones taken together.

    ``groups`` have ``p, x, y, vertical`` and their regions as an array ``parts`` of ``source, x, y, w, h``;
    regions too wide for one column are left out.
    """
    used = "filter(parts, m -> (m.source <=> 'ctd' OR NOT exists(parts, e -> e.source <=> 'ctd')) AND CASE WHEN vertical THEN m.w ELSE m.h END <= p * 1.85D)"
    place = "CASE WHEN vertical THEN {0}.x + {0}.w / 2.0D - x ELSE {0}.y + {0}.h / 2.0D - y END"
    placed = f"array_sort(transform({used}, m -> {place.format('m')}))"
    fold = f"""transform(aggregate({placed}, cast(array() as array<struct<s:double,n:bigint>>), (acc, v) ->
      if(size(acc) > 0 and v - element_at(acc, -1).s / element_at(acc, -1).n <= p * 0.55D,
         concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s + v, 'n', element_at(acc, -1).n + 1L))),
         concat(acc, array(named_struct('s', v, 'n', 1L))))), c -> c.s / c.n)"""
    # most groups are one region, which needs no fold
    one = f"if(CASE WHEN vertical THEN get(parts, 0).w ELSE get(parts, 0).h END <= p * 1.85D, array({place.format('get(parts, 0)')}), cast(array() as array<double>))"
    return groups.withColumn("centres", F.expr(f"CASE WHEN size(parts) = 1 THEN {one} ELSE {fold} END")).drop("parts")


def run_centres(projection: DataFrame, by: list[str], at: str, weight: str) -> DataFrame:
    """Weighted centre of each run of neighbouring places with ink."""
    w = Window.partitionBy(*by).orderBy(at)
    island = projection.where(F.col(weight) > 0).withColumn("_island", F.col(at) - F.row_number().over(w))
    return island.groupBy(*by, "_island").agg(F.min(at).alias("first"), (F.sum(F.col(at) * F.col(weight)) / F.sum(weight)).alias("centre")).drop("_island")


#: Steps of the original: of columns or lines (``step1``), and of characters within (``step2``), from the
#: number of centres, their median gap (null for one) and the length of the source.
GEOMETRY: Steps = [
    {"columns0": "greatest(1, centres)", "extent": "CASE WHEN vertical THEN h ELSE w END"},
    {"step1": "greatest(p * 0.8E0, coalesce(gap, p * 1.08E0))", "items": "greatest(1, ceil(greatest(1, n0) / (columns0 * 1.0E0)))"},
    {"step2": "greatest(p * 0.82E0, least(p * 1.62E0, CASE WHEN items > 1 THEN (extent - p) / (items - 1) ELSE p * 1.08E0 END))"},
]
#: Box of the layout: group and text box together where they are of like size, else the text box ``tx, ty, tw, th``, with padding.
LAYOUT_BOX: Steps = [
    {"joint": "w * h * 1.0E0 / greatest(1, tw * th) <= 2.35 AND w <= tw + p * 2.6E0 AND h <= th + p * 2.6E0", "pad": f"greatest({LAYOUT_PADDING}, CAST(round_even(p * {LAYOUT_PADDING_RATIO}E0, 0) AS BIGINT))"},
    {"x1": "CASE WHEN joint THEN least(tx, x) ELSE tx END - pad", "y1": "CASE WHEN joint THEN least(ty, y) ELSE ty END - pad", "x2": "CASE WHEN joint THEN greatest(tx + tw, x + w) ELSE tx + tw END + pad", "y2": "CASE WHEN joint THEN greatest(ty + th, y + h) ELSE ty + th END + pad"},
    {"lx": "greatest(0, least(x1, page_w - 1))", "ly": "greatest(0, least(y1, page_h - 1))"},
    {"lw": "greatest(lx + 1, least(x2, page_w)) - lx", "lh": "greatest(ly + 1, least(y2, page_h)) - ly"},
]
#: Allowed sizes, room, and the columns to expect, for a translation of ``n`` characters.
BOUNDS: Steps = [
    {"high": f"CAST(least({MAX_FONT}, greatest({MIN_FONT}, ceil(p * {GROWTH}E0))) AS BIGINT)", "room_w": f"greatest(1.0E0, lw - {2 * PADDING}.0E0)", "room_h": f"greatest(1.0E0, lh - {2 * PADDING}.0E0)"},
    {"low": f"least(high, CAST(greatest({MIN_FONT}, floor(p * {SHRINK}E0)) AS BIGINT))", "goal_w": "greatest(p, tw * 1.0E0)", "goal_h": "greatest(p, th * 1.0E0)"},
    {"expected": "greatest(1, CAST(round_even(columns0 * sqrt(greatest(0.15E0, n * 1.0E0 / greatest(1, n0))), 0) AS BIGINT))"},
]


def log_ratio(a: str, b: str) -> str:
    return f"abs(ln(greatest({a}, 0.000001E0) / greatest({b}, 0.000001E0)))"


def clamp(v: str, low: str, high: str) -> str:
    return f"(CASE WHEN {high} < {low} THEN {low} ELSE greatest({low}, least({v}, {high})) END)"


#: A vertical plan of a ``size``: what its glyphs and steps may be, before a number of columns is chosen.
VERTICAL_SIZE: Steps = [
    {"glyph": f"greatest(1.0E0, size * {GLYPH}E0)", "base": f"greatest(greatest(1.0E0, size * {GLYPH}E0), size * {LINE}E0 * {CHAR_SPACING}E0)"},
    {"char_low": f"base * {CHAR_STEP[0]}E0", "char_high": f"base * {CHAR_STEP[1]}E0", "col_low": f"greatest(glyph, size * {COLUMN_STEP[0]}E0)", "col_high": f"size * {COLUMN_STEP[1]}E0", "was_char": "step2 * size / greatest(p, 1.0E0)", "was_col": "step1 * size / greatest(p, 1.0E0)"},
    {"most": "least(n, CAST(greatest(1, floor((room_w - glyph) / greatest(1.0E0, col_low)) + 1) AS BIGINT))"},
]
#: The same with ``columns``: steps stretched or shrunk to the original's extent, whether it fits, and its cost.
VERTICAL_PLAN: Steps = [
    {"rows": "CAST(ceil(n / (columns * 1.0E0)) AS BIGINT)"},
    {"char_fit": "CASE WHEN rows > 1 THEN (room_h - glyph) / (rows - 1) ELSE 0.0E0 END", "char_fill": "CASE WHEN rows > 1 THEN (goal_h - glyph) / (rows - 1) ELSE 0.0E0 END", "col_fit": "CASE WHEN columns > 1 THEN (room_w - glyph) / (columns - 1) ELSE 0.0E0 END", "col_fill": "CASE WHEN columns > 1 THEN (goal_w - glyph) / (columns - 1) ELSE 0.0E0 END"},
    {
        "char_step": f"CASE WHEN rows <= 1 THEN base ELSE {clamp('CASE WHEN char_fill > was_char THEN least(char_fill, char_high) ELSE greatest(char_fill, char_low) END', 'char_low', 'least(char_high, char_fit)')} END",
        "col_step": f"CASE WHEN columns <= 1 THEN 0.0E0 ELSE {clamp('CASE WHEN columns < columns0 AND col_fill > was_col THEN least(col_fill, was_col * 1.22E0) WHEN columns > columns0 THEN least(was_col, col_fill) ELSE was_col END', 'col_low', 'least(col_high, col_fit)')} END",
    },
    {"bw": "glyph + (columns - 1) * col_step", "bh": "CASE WHEN rows <= 1 THEN glyph ELSE glyph + (rows - 1) * char_step END"},
    {"fits": "(rows <= 1 OR char_fit + 0.000001E0 >= char_low) AND (columns <= 1 OR col_fit + 0.000001E0 >= col_low) AND bw <= room_w + 0.000001E0 AND bh <= room_h + 0.000001E0"},
    {
        "cost": f"4.4E0 * {log_ratio('size * 1.0E0', 'p')} + 1.15E0 * {log_ratio('bw', 'goal_w')} + 1.45E0 * {log_ratio('bh', 'goal_h')} + 0.32E0 * abs(columns - expected) + 0.18E0 * {log_ratio('char_step', 'greatest(1.0E0, was_char)')}"
        f" + CASE WHEN columns > 1 THEN 0.14E0 * {log_ratio('col_step', 'greatest(1.0E0, was_col)')} ELSE 0.0E0 END + CASE WHEN columns > 1 AND n / (columns * 1.0E0) < {LEAST_PER_COLUMN} * 0.65E0 THEN ({LEAST_PER_COLUMN} - n / (columns * 1.0E0)) * 0.7E0 ELSE 0.0E0 END"
    },
]
#: Both, of a plan whose size and columns are known.
UPRIGHT: Steps = [*VERTICAL_SIZE, *VERTICAL_PLAN]
#: A horizontal plan of a ``size``: lines wrapped at the room's width, tracking and line steps, and its cost.
HORIZONTAL_PLAN: Steps = [
    {"advance": f"size * {GLYPH}E0", "line": f"size * {LINE}E0"},
    {"per_line": "greatest(1, least(n, CAST(floor(floor(room_w) / advance) AS BIGINT)))"},
    {"rows": "CAST(ceil(n / (per_line * 1.0E0)) AS BIGINT)"},
    {"tracking": f"CASE WHEN per_line > 1 THEN least(size * {CHAR_STEP[1] - 1:.2f}E0, greatest(0.0E0, (goal_w - per_line * advance) / (per_line - 1))) ELSE 0.0E0 END"},
    {"bw": "per_line * advance + (per_line - 1) * tracking", "line_fit": "CASE WHEN rows > 1 THEN (room_h - line) / (rows - 1) ELSE 0.0E0 END", "line_fill": "CASE WHEN rows > 1 THEN (goal_h - line) / (rows - 1) ELSE 0.0E0 END"},
    {"line_step": f"CASE WHEN rows <= 1 THEN 0.0E0 ELSE {clamp(f'greatest(greatest(1.0E0, line * {LINE_SPACING}E0), line_fill)', 'line * 0.88E0', 'least(line * 1.38E0, line_fit)')} END"},
    {"bh": "CASE WHEN rows <= 1 THEN line ELSE line + (rows - 1) * line_step END"},
    {"fits": "(rows <= 1 OR line_fit >= line * 0.82E0) AND bw <= room_w + 0.000001E0 AND bh <= room_h + 0.000001E0"},
    {"cost": f"4.8E0 * {log_ratio('size * 1.0E0', 'p')} + 1.55E0 * {log_ratio('bw', 'goal_w')} + 1.75E0 * {log_ratio('bh', 'goal_h')} + CASE WHEN tracking > 0 THEN 0.08E0 * {log_ratio('greatest(1.0E0, tracking + size)', 'greatest(1.0E0, size * 1.0E0)')} ELSE 0.0E0 END"},
]
#: Where a chosen plan's block stands: at the original's centre, within the layout box.
CENTRE: Steps = [
    {"cx": clamp("tx + tw / 2.0E0 - lx", f"{PADDING} + bw / 2.0E0", f"lw - {PADDING} - bw / 2.0E0"), "cy": clamp("ty + th / 2.0E0 - ly", f"{PADDING} + bh / 2.0E0", f"lh - {PADDING} - bh / 2.0E0")},
    {"left0": "CAST(floor(lx + cx - bw / 2.0E0) AS BIGINT)", "top0": "CAST(floor(ly + cy - bh / 2.0E0) AS BIGINT)"},
    {"wide0": "greatest(1, CAST(ceil(lx + cx - bw / 2.0E0 + bw) AS BIGINT) - left0)", "high0": "greatest(1, CAST(ceil(ly + cy - bh / 2.0E0 + bh) AS BIGINT) - top0)"},
]
#: Order of plans: near the original size if any are, then cheapest, nearest in size, larger.
CHOICE = f"CASE WHEN size + 0.000001E0 >= greatest({MIN_FONT}.0E0, p * {KEEP}E0) THEN 0 ELSE 1 END, round(cost, 9), round({log_ratio('size * 1.0E0', 'p')}, 9), size DESC"


def vertical(groups: DataFrame) -> DataFrame:
    """Every size and number of columns of the upright groups, with ``fits`` and ``cost``."""
    sized = apply(groups, BOUNDS).withColumn("size", F.explode(F.sequence("low", "high")))
    grid = apply(sized, VERTICAL_SIZE).withColumn("columns", F.explode(F.expr("sequence(1L, most)")))
    return apply(grid, VERTICAL_PLAN)


def horizontal(groups: DataFrame) -> DataFrame:
    """Every size of the level groups, with ``fits`` and ``cost``."""
    sized = apply(groups, BOUNDS).withColumn("size", F.explode(F.sequence("low", "high")))
    return apply(sized, HORIZONTAL_PLAN).withColumn("columns", F.col("rows"))


#: ``CHOICE`` and the columns as one whole number, which an aggregation holds without sorting the plans, and the part of it
#: in which the size and the columns are found again. Costs are below 10^8, sizes below 10^3, columns below 10^4.
_RANK = f"CAST(CASE WHEN size + 0.000001E0 >= greatest({MIN_FONT}.0E0, p * {KEEP}E0) THEN 0 ELSE 100000000000000000 END + CAST(round(round(cost, 9) * 1000000000) AS BIGINT) AS DECIMAL(18, 0)) * 1000000000000000000BD"
_PLACE = f"CAST(round(round({log_ratio('size * 1.0E0', 'p')}, 9) * 1000000000) AS BIGINT) * 10000000 + (999 - size) * 10000 + columns"
#: What plans need of a group.
NEEDED = ("n", "n0", "p", "columns0", "step1", "step2", "lw", "lh", "tw", "th")


def best(groups: DataFrame, plans: DataFrame, steps: Steps) -> DataFrame:
    """Groups with the ``size`` and ``columns`` of the best plan that fits, null without one, and what ``steps`` say of it."""
    by = groups.columns
    least = F.min(F.expr(f"CASE WHEN fits AND n > 0 THEN {_RANK} + CAST({_PLACE} AS DECIMAL(18, 0)) END"))
    chosen = plans.groupBy(*by).agg(least.alias("_least")).withColumn("_least", F.expr("CAST(_least % 10000000BD AS BIGINT)"))
    return apply(apply(chosen, BOUNDS).withColumns({"size": F.expr("999 - _least div 10000"), "columns": F.expr("_least % 10000")}), steps).drop("_least")


def planned(groups: DataFrame, plans: DataFrame, key: list[str], steps: Steps) -> DataFrame:
    """One row a group: its plan with ``fits``, or the reason why there is none."""
    out = best(groups, plans, steps).withColumn("cost", F.round("cost", 6))
    reason = F.when(F.col("n") <= 0, F.lit("empty_translation")).when(F.col("size").isNull(), F.concat(F.lit("translation_requires_font_below_"), F.col("low").cast("string"), F.lit("px"))).otherwise(F.lit(""))
    some = F.col("size").isNotNull()
    shown = {c: F.when(some, F.col(c)) for c in ("columns", "bw", "bh", "cost")}
    return out.withColumns({**shown, "fits": some, "reason": reason, "size": F.coalesce("size", F.when(F.col("n") > 0, F.col("low")).otherwise(F.lit(MIN_FONT)))}).select(*key, "size", "columns", "bw", "bh", "cost", "fits", "reason")


#: A patch without an original: its whole box is the target, one column, and its size a share of its shorter side.
PATCH: Steps = [
    {"p": f"greatest({MIN_FONT}.0E0, coalesce(hint, least(w, h) * 0.42E0))", "lx": "0", "ly": "0", "lw": "w", "lh": "h"},
    {"tx": f"{PADDING}", "ty": f"{PADDING}", "tw": f"greatest(1, w - {2 * PADDING})", "th": f"greatest(1, h - {2 * PADDING})", "columns0": "1", "n0": "greatest(1, n)", "step1": "coalesce(hint, least(w, h) * 0.42E0)", "step2": "coalesce(hint, least(w, h) * 0.42E0) * 1.08E0"},
]

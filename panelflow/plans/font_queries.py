"""Queries over the original's geometry and the plans of a translation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.steps import apply, nested
from ..operators import fonts, pages
from .page_queries import ALL, REGIONS, regions
from .registry import query

HINTED = "h AS (SELECT r.page_id, p.component, r.rn, r.x, r.y, r.w, r.h, r.source, least(r.w, r.h) / 3.0::DOUBLE AS font_hint FROM regions r JOIN parts p USING (page_id, rn))"
HINT = "hint AS (SELECT page_id, component, coalesce(median(font_hint) FILTER (source = 'ctd'), median(font_hint))::DOUBLE AS hint FROM h WHERE font_hint BETWEEN 4 AND 300 GROUP BY ALL)"
SIZED = "sized AS (SELECT *, CASE component % 3 WHEN 0 THEN NULL WHEN 1 THEN hint * 1.2 ELSE hint * 3 END::DOUBLE AS mask_hint FROM groups LEFT JOIN hint USING (page_id, component))"
PREFERRED = f"pref AS (SELECT * FROM {nested('sized', fonts.PREFERRED)})"
BASE = f"{ALL}, {HINTED}, {HINT}, {SIZED}, {PREFERRED}"
CENTRES = """used AS (SELECT h.*, g.p, g.vertical AS upright, g.x AS gx, g.y AS gy, max(CASE WHEN h.source = 'ctd' THEN 1 ELSE 0 END) OVER (PARTITION BY h.page_id, h.component) AS firsts FROM h JOIN pref g USING (page_id, component)),
placed AS (SELECT page_id, component, p, CASE WHEN upright THEN x + w / 2.0::DOUBLE - gx ELSE y + h / 2.0::DOUBLE - gy END AS v FROM used WHERE (firsts = 0 OR source = 'ctd') AND CASE WHEN upright THEN w ELSE h END <= p * 1.85::DOUBLE),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, component ORDER BY v) AS k FROM placed),
walk AS (SELECT page_id, component, k, 0::BIGINT AS c, v AS s, 1::BIGINT AS m FROM ranked WHERE k = 1 UNION ALL SELECT r.page_id, r.component, r.k, CASE WHEN r.v - w.s / w.m <= r.p * 0.55::DOUBLE THEN w.c ELSE w.c + 1 END,
  CASE WHEN r.v - w.s / w.m <= r.p * 0.55::DOUBLE THEN w.s + r.v ELSE r.v END, CASE WHEN r.v - w.s / w.m <= r.p * 0.55::DOUBLE THEN w.m + 1 ELSE 1 END FROM walk w JOIN ranked r ON r.page_id = w.page_id AND r.component = w.component AND r.k = w.k + 1),
centre AS (SELECT page_id, component, c, arg_max(s / m, k) AS centre FROM walk GROUP BY ALL),
gaps AS (SELECT page_id, component, count(*) AS centres, median(g)::DOUBLE AS gap FROM (SELECT page_id, component, centre - lag(centre) OVER (PARTITION BY page_id, component ORDER BY c) AS g FROM centre) GROUP BY ALL),
full_groups AS (SELECT g.* EXCLUDE (members), coalesce(c.centres, 0) AS centres, c.gap, 3 + g.component % 9 AS n0, (g.component * 5) % 23 AS n, g.x + 3 AS tx, g.y + 3 AS ty, greatest(1, g.w - 8) AS tw, greatest(1, g.h - 8) AS th, 900 AS page_w, 900 AS page_h FROM pref g LEFT JOIN gaps c USING (page_id, component))"""
GEOMETRY = f"geometry AS (SELECT * FROM {nested('full_groups', fonts.GEOMETRY)}), layout AS (SELECT * FROM {nested('geometry', fonts.LAYOUT_BOX)})"
KEY = ["page_id", "component"]


def preferred(spark, sf):
    r = regions(spark, sf).withColumn("font_hint", F.expr("least(w, h) / 3.0D"))
    groups = pages.grouped(r, parts=F.collect_list(F.struct("source", "x", "y", "w", "h", "font_hint"))).withColumn("hint", fonts.parts_hint())
    return apply(groups.withColumn("mask_hint", F.expr("CASE component % 3 WHEN 0 THEN NULL WHEN 1 THEN hint * 1.2D ELSE hint * 3 END")), fonts.PREFERRED)


def laid(spark, sf):
    found = fonts.axis_centres(preferred(spark, sf)).withColumn("steps", F.expr("if(size(centres) < 2, cast(array() as array<double>), array_sort(transform(slice(centres, 2, size(centres)), (c, i) -> c - centres[i])))"))
    gap = F.expr("if(size(steps) = 0, null, (steps[int((size(steps) - 1) / 2)] + steps[int(size(steps) / 2)]) / 2.0D)")
    full = found.withColumns({"gap": gap, "centres": F.size("centres").cast("long")}).drop("members", "steps")
    full = full.withColumns({"n0": F.expr("3 + component % 9"), "n": F.expr("(component * 5) % 23"), "tx": F.expr("x + 3"), "ty": F.expr("y + 3"), "tw": F.expr("greatest(1L, w - 8)"), "th": F.expr("greatest(1L, h - 8)"), "page_w": F.lit(900), "page_h": F.lit(900)})
    return apply(apply(full, fonts.GEOMETRY), fonts.LAYOUT_BOX)


@query("char_size", f"WITH {REGIONS} SELECT page_id, CASE WHEN m IS NULL THEN greatest(8, round_even(900 * 0.018, 0)) ELSE greatest(6, round_even(m, 0)) END::BIGINT AS char_size FROM (SELECT page_id, median(least(w, h) / 3.0::DOUBLE) FILTER (least(w, h) / 3.0::DOUBLE BETWEEN 4 AND 256) AS m FROM regions GROUP BY page_id)")
def char_size(spark, sf):
    return fonts.char_size(regions(spark, sf).withColumn("font_hint", F.expr("least(w, h) / 3.0D")), 900)


@query("preferred_size", f"{BASE} SELECT page_id, component, round(p, 6) AS p FROM pref")
def preferred_size(spark, sf):
    return preferred(spark, sf).select(*KEY, F.round("p", 6).alias("p"))


@query("axis_centres", f"{BASE}, {CENTRES} SELECT page_id, component, c AS at, round(centre, 6) AS centre FROM centre")
def axis_centres(spark, sf):
    # outer, as the optimizer would otherwise ask below whether there are centres, with all that makes them spelled out again
    at = fonts.axis_centres(preferred(spark, sf)).select(*KEY, F.posexplode_outer("centres").alias("at", "centre")).where("at IS NOT NULL")
    return at.select(*KEY, F.col("at").cast("long"), F.round("centre", 6).alias("centre"))


@query("run_centres", f"WITH {REGIONS}, i AS (SELECT *, rn - row_number() OVER (PARTITION BY page_id ORDER BY rn) AS g FROM regions WHERE w > 100) SELECT page_id, min(rn) AS first, round(sum(rn * w) / sum(w)::DOUBLE, 6) AS centre FROM i GROUP BY page_id, g")
def run_centres(spark, sf):
    ink = regions(spark, sf).withColumn("ink", F.expr("if(w > 100, w, 0)"))
    return fonts.run_centres(ink, ["page_id"], "rn", "ink").withColumn("centre", F.round("centre", 6))


@query("original_geometry", f"{BASE}, {CENTRES}, {GEOMETRY} SELECT page_id, component, columns0, round(step1, 6) AS step1, round(step2, 6) AS step2 FROM geometry")
def original_geometry(spark, sf):
    return laid(spark, sf).select(*KEY, "columns0", F.round("step1", 6).alias("step1"), F.round("step2", 6).alias("step2"))


@query("layout_box", f"{BASE}, {CENTRES}, {GEOMETRY} SELECT page_id, component, lx, ly, lw, lh FROM layout")
def layout_box(spark, sf):
    return laid(spark, sf).select(*KEY, "lx", "ly", "lw", "lh")


def _planned(source: str, plans: str, key: str = "page_id, component") -> str:
    return f"""{plans}, pick AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {fonts.CHOICE}, columns) AS r FROM plans WHERE fits AND n > 0), low AS (SELECT * FROM {nested(source, fonts.BOUNDS)})
SELECT {', '.join('l.' + k.strip() for k in key.split(','))}, CASE WHEN l.n <= 0 THEN 10 ELSE coalesce(b.size, l.low) END::BIGINT AS size, b.columns, round(b.bw, 6) AS bw, round(b.bh, 6) AS bh, round(b.cost, 6) AS cost, b.size IS NOT NULL AS fits,
CASE WHEN l.n <= 0 THEN 'empty_translation' WHEN b.size IS NULL THEN 'translation_requires_font_below_' || l.low || 'px' ELSE '' END AS reason FROM low l LEFT JOIN pick b ON {' AND '.join(f'l.{k.strip()} = b.{k.strip()}' for k in key.split(','))} AND b.r = 1"""


def vertical_sql(source: str) -> str:
    sized = f"(SELECT *, unnest(range(low, high + 1)) AS size FROM {nested(source, fonts.BOUNDS)})"
    grid = f"(SELECT *, unnest(range(1, most + 1)) AS columns FROM {nested(sized, fonts.VERTICAL_SIZE)})"
    return f"plans AS (SELECT * FROM {nested(grid, fonts.VERTICAL_PLAN)})"


def horizontal_sql(source: str) -> str:
    sized = f"(SELECT *, unnest(range(low, high + 1)) AS size FROM {nested(source, fonts.BOUNDS)})"
    return f"plans AS (SELECT *, rows AS columns FROM {nested(sized, fonts.HORIZONTAL_PLAN)})"


def _shown(df, key=KEY):
    return df.select(*key, F.col("size").cast("long").alias("size"), F.col("columns").cast("long").alias("columns"), F.round("bw", 6).alias("bw"), F.round("bh", 6).alias("bh"), "cost", "fits", "reason")


UPRIGHT = f"{BASE}, {CENTRES}, {GEOMETRY}, upright AS (SELECT * FROM layout WHERE vertical), level AS (SELECT * FROM layout WHERE NOT vertical)"


@query("plan_vertical", f"{UPRIGHT}, {_planned('upright', vertical_sql('upright'))}")
def plan_vertical(spark, sf):
    groups = laid(spark, sf).where("vertical").select(*KEY, *fonts.NEEDED)
    return _shown(fonts.planned(groups, fonts.vertical(groups), KEY, fonts.UPRIGHT))


@query("plan_horizontal", f"{UPRIGHT}, {_planned('level', horizontal_sql('level'))}")
def plan_horizontal(spark, sf):
    groups = laid(spark, sf).where("NOT vertical").select(*KEY, *fonts.NEEDED)
    return _shown(fonts.planned(groups, fonts.horizontal(groups), KEY, fonts.HORIZONTAL_PLAN))


PATCHES = f"WITH {REGIONS}, patch AS (SELECT * FROM {nested('(SELECT page_id, rn, w, h, vertical, CASE WHEN rn % 2 = 0 THEN NULL ELSE least(w, h) / 2.0::DOUBLE END AS hint, 1 + rn % 7 AS n FROM regions)', fonts.PATCH)})"


@query("plan_patch", f"{PATCHES}, {_planned('patch', vertical_sql('patch'), 'page_id, rn')}")
def plan_patch(spark, sf):
    r = regions(spark, sf).select("page_id", "rn", "w", "h", "vertical", F.expr("if(rn % 2 = 0, null, least(w, h) / 2.0D)").alias("hint"), F.expr("1 + rn % 7").alias("n"))
    groups = apply(r, fonts.PATCH).select("page_id", "rn", *fonts.NEEDED)
    return _shown(fonts.planned(groups, fonts.vertical(groups), ["page_id", "rn"], fonts.UPRIGHT), ["page_id", "rn"])


@query("plan_block", f"{UPRIGHT}, {vertical_sql('upright')}, pick AS (SELECT *, row_number() OVER (PARTITION BY page_id, component ORDER BY {fonts.CHOICE}, columns) AS r FROM plans WHERE fits AND n > 0) SELECT page_id, component, left0, top0, wide0, high0 FROM {nested('(SELECT * FROM pick WHERE r = 1)', fonts.CENTRE)}")
def plan_block(spark, sf):
    groups = laid(spark, sf).where("vertical").select(*KEY, *fonts.NEEDED, "lx", "ly", "tx", "ty")
    best = fonts.best(groups, fonts.vertical(groups), fonts.UPRIGHT).where("size IS NOT NULL")
    return apply(best, fonts.CENTRE).select(*KEY, "left0", "top0", "wide0", "high0")

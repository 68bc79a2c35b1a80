"""Queries over the boxes of a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import pages
from .registry import query

REGIONS = """regions AS (SELECT *, h > w AS vertical FROM (SELECT l_orderkey AS page_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn,
  (l_partkey * 37) % 900 AS x, (l_suppkey * 53) % 900 AS y, 20 + 4 * trunc(l_quantity)::BIGINT AS w, 20 + 5 * (l_partkey % 50) AS h,
  (trunc(l_extendedprice)::BIGINT % 1000) / 1000.0::DOUBLE AS confidence, (['ctd', 'multiscale', 'mask_fallback'])[(l_linenumber % 3 + 1)::INT] AS source FROM lineitem))"""
EDGES = "edges AS (SELECT a.page_id, a.rn AS i, b.rn AS j FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.rn < b.rn AND {predicate})"
CLOSURE = """sym AS (SELECT page_id, i, j FROM edges UNION ALL SELECT page_id, j, i FROM edges),
reach(page_id, rn, other) AS (SELECT page_id, rn, rn FROM regions UNION SELECT r.page_id, r.rn, s.j FROM reach r JOIN sym s ON s.page_id = r.page_id AND s.i = r.other),
parts AS (SELECT page_id, rn, min(other) AS component FROM reach GROUP BY page_id, rn)"""
GROUPS = """groups AS (SELECT page_id, component, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h,
  count(*) FILTER (vertical) * 2 >= count(*) AS vertical, count(*) AS members, count(*) FILTER (source = 'ctd') AS ctd, count(*) FILTER (source = 'multiscale') AS multiscale,
  count(*) FILTER (source = 'mask_fallback') AS fallback, round(avg(confidence), 6) AS confidence FROM regions JOIN parts USING (page_id, rn) GROUP BY page_id, component)"""
ALL = f"WITH RECURSIVE {REGIONS}, {EDGES.format(predicate=g.should_group())}, {CLOSURE}, {GROUPS}"


def regions(spark, sf):
    return pages.regions(spark.read.parquet(f"{sf}/lineitem.parquet"))


@query("region_filter", f"""WITH {REGIONS}, c AS (SELECT page_id, rn, greatest(x, 0) AS x, greatest(y, 0) AS y, least(x + w, 900) - greatest(x, 0) AS w, least(y + h, 900) - greatest(y, 0) AS h FROM regions)
SELECT page_id, rn, x, y, w, h, printf('r%04d', row_number() OVER (PARTITION BY page_id ORDER BY rn) - 1) AS region_id FROM c WHERE w > 1 AND h > 1 AND w * h >= 36 AND least(w, h) >= 0.015 * greatest(w, h)""")  # fmt: skip
def region_filter(spark, sf):
    return pages.filtered(regions(spark, sf)).select("page_id", "rn", "x", "y", "w", "h", "region_id")


MEASURES = {"inter": g.intersection(), "iou": g.iou(), "iom": g.iom(), "contained": g.max_containment(), "ratio": g.area_ratio(), "distance": g.center_distance(), "axis": g.axis_overlap(), "gap": g.gap_ratio()}


@query("box_pairs_overlap", f"WITH {REGIONS} SELECT a.page_id, a.rn AS i, b.rn AS j, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in MEASURES.items()) + f" FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.rn < b.rn AND {g.intersection()} > 0")
def box_pairs_overlap(spark, sf):
    return pages.pairs(regions(spark, sf), f"{g.intersection()} > 0").selectExpr("a.page_id", "a.rn AS i", "b.rn AS j", *[f"cast({e} as double) AS {n}" for n, e in MEASURES.items()])


@query("box_duplicate_flags", f"WITH {REGIONS} SELECT a.page_id, a.rn, EXISTS (SELECT 1 FROM regions b WHERE a.page_id = b.page_id AND a.rn <> b.rn AND ({g.iom()} >= 0.55 OR {g.max_containment()} >= 0.82)) AS duplicate FROM regions a")
def box_duplicate_flags(spark, sf):
    return pages.duplicate_flags(regions(spark, sf)).select("page_id", "rn", "duplicate")


@query("region_groups", ALL + """, o AS (SELECT *, avg(vertical::INT) OVER (PARTITION BY page_id) >= 0.5 AS rtl FROM groups),
k AS (SELECT *, CASE WHEN rtl THEN -(x + w / 2.0) ELSE y + h / 2.0 END AS ka, CASE WHEN rtl THEN y + h / 2.0 ELSE x + w / 2.0 END AS kb FROM o)
SELECT page_id, component, x, y, w, h, vertical, members, printf('g%03d', row_number() OVER (PARTITION BY page_id ORDER BY ka, kb, component) - 1) AS group_id FROM k""")
def region_groups(spark, sf):
    return pages.reading_order(pages.grouped(regions(spark, sf))).select("page_id", "component", "x", "y", "w", "h", "vertical", "members", "group_id")


@query("group_bbox_vote", ALL + " SELECT * FROM groups")
def group_bbox_vote(spark, sf):
    return pages.grouped(regions(spark, sf))


for _mode, _keys in (("rtl", "-(x + w / 2.0), y + h / 2.0"), ("ltr", "y + h / 2.0, x + w / 2.0")):

    @query(f"reading_order_{_mode}", ALL + f" SELECT page_id, component, row_number() OVER (PARTITION BY page_id ORDER BY {_keys}, component) - 1 AS position FROM groups")
    def reading_order(spark, sf, mode=_mode):
        return pages.reading_order(pages.grouped(regions(spark, sf)), mode).select("page_id", "component", "position")


@query("grid_order", f"""WITH {REGIONS}, c AS (SELECT *, x + w / 2.0::DOUBLE AS cx, y + h / 2.0::DOUBLE AS cy FROM regions), d AS (SELECT *, floor(cx / (900 / 3.0::DOUBLE)) AS gx, floor(cy / (900 / 4.0::DOUBLE)) AS gy FROM c),
e AS (SELECT *, (gy * 3 + gx) * 810000::DOUBLE + 1.2::DOUBLE * (cx - gx * 900 / 3.0::DOUBLE) + (cy - gy * 900 / 4.0::DOUBLE) AS weight FROM d)
SELECT page_id, rn, round(weight, 6) AS weight, row_number() OVER (PARTITION BY page_id ORDER BY weight, rn) AS position FROM e""")  # fmt: skip
def grid_order(spark, sf):
    return pages.grid_order(regions(spark, sf)).select("page_id", "rn", F.round("weight", 6).alias("weight"), "position")


def greedy(rows: str, by: str, order: str, conflict: str) -> str:
    """Recursive SQL of a greedy suppression: rank by rank, with the kept ones in a list."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k FROM {rows}),
walk AS (SELECT {by}, 1::BIGINT AS k, [{{rn: rn, x: x, y: y, w: w, h: h, vertical: vertical}}] AS acc FROM ranked WHERE k = 1
UNION ALL SELECT {', '.join('b.' + c.strip() for c in by.split(','))}, b.k, CASE WHEN len(list_filter(s.acc, lambda a: {conflict})) > 0 THEN s.acc ELSE list_append(s.acc, {{rn: b.rn, x: b.x, y: b.y, w: b.w, h: b.h, vertical: b.vertical}}) END
  FROM walk s JOIN ranked b ON {' AND '.join(f's.{c.strip()} = b.{c.strip()}' for c in by.split(','))} AND b.k = s.k + 1),
final AS (SELECT {by}, arg_max(acc, k) AS acc FROM walk GROUP BY {by})
SELECT page_id, r.rn, list_contains([e.rn for e in f.acc], r.rn) AS kept FROM ranked r JOIN final f USING ({by})"""


@query("nms", f"WITH RECURSIVE {REGIONS}, " + greedy("regions", "page_id", "-confidence, rn", f"{g.iou()} > 0.3"))
def nms(spark, sf):
    return pages.nms(regions(spark, sf)).select("page_id", "rn", "kept")


@query("nms_per_class", f"WITH RECURSIVE {REGIONS}, " + greedy("regions", "page_id, source", "-confidence, rn", f"{g.iou()} > 0.3"))
def nms_per_class(spark, sf):
    return pages.nms(regions(spark, sf), by=("page_id", "source")).select("page_id", "rn", "kept")


@query("render_collisions", ALL + ", g2 AS (SELECT *, component AS rn FROM groups), " + greedy("g2", "page_id", "-ctd, -multiscale, fallback, -confidence, w * h, component", g.render_conflict()))
def render_collisions(spark, sf):
    return pages.render_collisions(pages.grouped(regions(spark, sf))).select("page_id", "rn", "kept")


@query("status_funnel", ALL + ", g2 AS (SELECT *, component AS rn FROM groups), k AS (" + greedy("g2", "page_id", "-ctd, -multiscale, fallback, -confidence, w * h, component", g.render_conflict()).replace("ranked AS", "WITH RECURSIVE ranked AS", 1) + ") SELECT CASE WHEN kept THEN 'ready' ELSE 'render_collision_rejected' END AS status, count(*) AS groups FROM k GROUP BY 1")
def status_funnel(spark, sf):
    kept = pages.render_collisions(pages.grouped(regions(spark, sf)))
    return kept.groupBy(F.when(F.col("kept"), "ready").otherwise("render_collision_rejected").alias("status")).agg(F.count("*").alias("groups"))


@query("unresolved", ALL + " SELECT page_id, count(*) AS unresolved FROM groups WHERE confidence < 0.46 GROUP BY page_id")
def unresolved(spark, sf):
    return pages.grouped(regions(spark, sf)).where("confidence < 0.46").groupBy("page_id").agg(F.count("*").alias("unresolved"))


@query("page_direction", ALL + " SELECT page_id, round(avg(vertical::INT), 6) AS vertical_share, avg(vertical::INT) >= 0.5 AS rtl, sum(members)::BIGINT AS regions FROM groups GROUP BY page_id")
def page_direction(spark, sf):
    return pages.grouped(regions(spark, sf)).groupBy("page_id").agg(F.round(F.avg(F.col("vertical").cast("int")), 6).alias("vertical_share"), (F.avg(F.col("vertical").cast("int")) >= 0.5).alias("rtl"), F.sum("members").alias("regions"))

"""Queries over the forms of boxes, blocks and lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import shapes
from ..functions import text as t
from ..functions.steps import apply, nested
from ..operators import manifest, pages, polygons
from .page_queries import REGIONS, regions
from .registry import query


def _query(name: str, steps, columns: list[str], source: str = "regions"):
    shown = ", ".join(columns)

    @query(name, f"WITH {REGIONS} SELECT page_id, rn, {shown} FROM {nested(source, steps)}")
    def fn(spark, sf):
        return apply(regions(spark, sf), steps).select("page_id", "rn", *columns)

    return fn


_query("bbox_clip", shapes.clipped("x - 12.5E0", "y + 0.5E0", "w + 37.0E0", "h * 1.5E0", 900, 900), ["clip_x", "clip_y", "clip_w", "clip_h"])
_query("text_window", shapes.window(900, 900), ["win_x1", "win_y1", "win_x2", "win_y2"])
_query("text_window_shrunk", shapes.window(900, 900, 8, -1), ["win_x1", "win_y1", "win_x2", "win_y2"])
_query("block_region", shapes.block_region("x - 30", "y - 30", "x + w", "y + h", 900, 900), ["bx1", "by1", "bw", "bh", "usable"])
_query("box_forms", [*shapes.relative(900, 900), *shapes.absolute(900, 900), {"rel": "round(rel_cx, 9)", "rel_side": "round(rel_h, 9)"}], ["rel", "rel_side", "abs_x1", "abs_y1", "abs_x2", "abs_y2"])


@query("box_polygon", f"WITH {REGIONS} SELECT page_id, rn, concat_ws(' ', x, y, x + w, y, x + w, y + h, x, y + h) AS polygon FROM regions")
def box_polygon(spark, sf):
    return regions(spark, sf).select("page_id", "rn", F.concat_ws(" ", F.transform(shapes.corners(), lambda v: v.cast("string"))).alias("polygon"))


# a quarter turn about (450, 450): (x, y) goes to (y, 900 - x)
@query("polygon_rotate", f"WITH {REGIONS} SELECT page_id, rn, concat_ws(' ', y, 900 - x, y, 900 - x - w, y + h, 900 - x - w, y + h, 900 - x) AS polygon FROM regions")
def polygon_rotate(spark, sf):
    turned = regions(spark, sf).withColumn("p", shapes.corners()).withColumn("t", shapes.rotated("p", "450", "450", "90"))
    return turned.select("page_id", "rn", F.concat_ws(" ", F.transform("t", lambda v: v.cast("string"))).alias("polygon"))


LABELS = "printf('%d %d %d %d %d', rn % 2, x, y, w, h)"


@query("yolo_labels", f"WITH {REGIONS} SELECT page_id, string_agg({LABELS}, chr(10) ORDER BY rn) AS label FROM regions GROUP BY page_id")
def yolo_labels(spark, sf):
    one = regions(spark, sf).withColumn("line", F.concat_ws(" ", F.col("rn") % 2, "x", "y", "w", "h"))
    return one.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda r: r["line"]), "\n").alias("label"))


AXES = "(SELECT page_id, sum(rn % 3)::BIGINT AS vx, sum(h)::BIGINT AS vy, sum(w)::BIGINT AS hx, sum(rn % 5)::BIGINT AS hy, count(*) AS lines, CASE WHEN page_id % 2 = 0 THEN 'ja' ELSE 'eng' END AS language FROM regions GROUP BY page_id)"


@query("block_orientation", f"WITH {REGIONS} SELECT page_id, upright, font, angle FROM {nested(AXES, shapes.ORIENTATION)}")
def block_orientation(spark, sf):
    sums = regions(spark, sf).groupBy("page_id").agg(F.sum(F.col("rn") % 3).alias("vx"), F.sum("h").alias("vy"), F.sum("w").alias("hx"), F.sum(F.col("rn") % 5).alias("hy"), F.count("*").alias("lines"))
    return apply(sums.withColumn("language", F.expr("if(page_id % 2 = 0, 'ja', 'eng')")), shapes.ORIENTATION).select("page_id", "upright", "font", "angle")


LINES = "(SELECT page_id, rn, x + w / 2.0::DOUBLE AS px, y + h / 2.0::DOUBLE AS py, 900 AS ox, 0 AS oy, 1 AS dx, 8 AS dy FROM regions)"


@query("line_distance_order", f"WITH {REGIONS} SELECT page_id, rn, row_number() OVER (PARTITION BY page_id ORDER BY round(d, 6), rn) AS position FROM (SELECT *, {shapes.LINE_DISTANCE} AS d FROM {LINES})")
def line_distance_order(spark, sf):
    lines = regions(spark, sf).selectExpr("page_id", "rn", "x + w / 2.0D AS px", "y + h / 2.0D AS py", "900 AS ox", "0 AS oy", "1 AS dx", "8 AS dy")
    w = Window.partitionBy("page_id").orderBy(F.round(F.expr(shapes.LINE_DISTANCE), 6), "rn")
    return lines.select("page_id", "rn", F.row_number().over(w).cast("long").alias("position"))


@query("pass_union", f"WITH {REGIONS}, u AS (SELECT page_id, rn, 1024 AS pass FROM regions UNION ALL SELECT page_id, rn, 1536 FROM regions WHERE rn % 2 = 0) SELECT pass, count(*) AS regions, count(DISTINCT page_id) AS pages FROM u GROUP BY pass")
def pass_union(spark, sf):
    r = regions(spark, sf).select("page_id", "rn")
    sizes = F.array_distinct(F.array(*[F.lit(s) for s in (1024, 1536, 1024)]))
    both = r.withColumn("pass", F.explode(sizes)).where("pass = 1024 or rn % 2 = 0")
    return both.groupBy("pass").agg(F.count("*").alias("regions"), F.countDistinct("page_id").alias("pages"))


@query("contour_cap", f"WITH {REGIONS} SELECT page_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rn) AS k FROM regions) WHERE k <= 3")
def contour_cap(spark, sf):
    w = Window.partitionBy("page_id").orderBy("rn")
    return regions(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 3").select("page_id", "rn")


@query("rotated_iou", f"WITH {REGIONS} SELECT a.page_id, a.rn AS i, b.rn AS j, round({g.iou()}, 6) AS iou FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.rn < b.rn AND {g.intersection()} > 0")
def rotated_iou(spark, sf):
    boxes = regions(spark, sf).withColumn("p", shapes.corners())
    both = pages.pairs(boxes, f"{g.intersection()} > 0").select("a.page_id", F.col("a.rn").alias("i"), F.col("b.rn").alias("j"), F.col("a.p").alias("p"), F.col("b.p").alias("q"))
    return both.select("page_id", "i", "j", F.round(polygons.rotated_iou("p", "q"), 6).alias("iou"))


@query("mini_box", f"WITH {REGIONS} SELECT page_id, rn, concat_ws(' ', x, y, x + w, y, x + w, y + h, x, y + h) AS box FROM regions")
def mini_box(spark, sf):
    # the corners and a point on each of two sides
    dented = regions(spark, sf).withColumn("p", F.expr("array(x + w, y + h, x, y, x + w, y, x, y + h, x + w div 2, y, x, y + h div 3)"))
    return dented.select("page_id", "rn", F.concat_ws(" ", F.transform(polygons.mini_box("p"), lambda v: v.cast("long").cast("string"))).alias("box"))


@query("merged_lines")
def merged_lines(spark, sf):
    r = regions(spark, sf).withColumn("polygon", F.transform(shapes.corners(), lambda v: v.cast("double")))
    lines = r.selectExpr("page_id", "rn", "polygon", "cast(least(w, h) as double) AS font", "cast(if(vertical, 0, w) as double) AS vx", "cast(if(vertical, h, 0) as double) AS vy", "cast(if(vertical, 900 - x - w / 2, y + h / 2) as double) AS distance")
    return polygons.merged_lines(lines)


@query("annotation_files", f"WITH {REGIONS} SELECT page_id, count(*) AS lines, string_agg(concat_ws(',', x, y, x + w, y, x + w, y + h, x, y + h), chr(10) ORDER BY rn) AS polygons FROM regions GROUP BY page_id")
def annotation_files(spark, sf):
    return manifest.annotations(regions(spark, sf), 900, 900).select("page_id", F.size(F.split("labels", "\n")).cast("long").alias("lines"), "polygons")


@query("horizontal_wrap", "WITH l AS (SELECT item_id, text, length(text) AS n FROM benchmark) SELECT item_id, ceil(n / 12.0)::BIGINT AS lines, substr(text, 13, 12) AS second FROM l WHERE n > 12")
def horizontal_wrap(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet").where("char_length(text) > 12").withColumn("advances", F.expr("transform(sequence(1, char_length(text)), i -> 8.0D)"))
    return b.withColumn("l", t.wrapped("text", "advances", "100")).select("item_id", F.size("l").cast("long").alias("lines"), F.expr("l[1]").alias("second"))


@query("page_record", f"WITH {REGIONS} SELECT page_id, count(*) AS regions, count(*) AS groups, string_agg(printf('g%03d', rn), ',' ORDER BY rn) FILTER (confidence < 0.46) AS unresolved FROM regions GROUP BY page_id")
def page_record(spark, sf):
    r = regions(spark, sf)
    made = {"position": "rn", "group_id": "format_string('g%03d', rn)", "status": "if(confidence < 0.46, 'ocr_rejected', 'ready')", "skip_reason": "if(confidence < 0.46, 'low', '')", "text": "source", "translation": "upper(source)"}
    record = manifest.page_record(r, r.withColumns({k: F.expr(v) for k, v in made.items()}))
    return record.select("page_id", F.size("regions").cast("long").alias("regions"), F.size("groups").cast("long").alias("groups"), F.expr("nullif(array_join(transform(unresolved, u -> u.group_id), ','), '')").alias("unresolved"))

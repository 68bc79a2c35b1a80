"""Operators over the boxes of a page: filters, pairs, groups, order, suppression.

A page is the unit of all of them, and one exchange on ``page_id`` serves a whole chain. Pages are
small (tens of boxes), so order-dependent steps fold a sorted array of the page's boxes inside the
aggregation; components of larger graphs belong to a distributed union-find instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

BOX = ("x", "y", "w", "h")
MIN_AREA, THIN = 36, 0.015


def regions(lineitem: DataFrame) -> DataFrame:
    """Deterministic boxes from order lines: an order is a page."""
    # named before the numbering, so that what is asked of a page later needs no other exchange
    lines = lineitem.withColumnRenamed("l_orderkey", "page_id")
    w = Window.partitionBy("page_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    made = lines.select(
        "page_id", F.row_number().over(w).cast("long").alias("rn"),
        F.expr("(l_partkey * 37) % 900").alias("x"), F.expr("(l_suppkey * 53) % 900").alias("y"), F.expr("20 + 4 * cast(l_quantity as bigint)").alias("w"), F.expr("20 + 5 * (l_partkey % 50)").alias("h"),
        F.expr("(cast(l_extendedprice as bigint) % 1000) / 1000.0D").alias("confidence"), F.expr("element_at(array('ctd', 'multiscale', 'mask_fallback'), cast(l_linenumber % 3 as int) + 1)").alias("source"),
    )
    return made.withColumn("vertical", F.col("h") > F.col("w"))


def filtered(boxes: DataFrame, width: int = 900, height: int = 900) -> DataFrame:
    """Boxes clamped to the page, without tiny and thin ones, numbered in the order that survives."""
    clamped = boxes.withColumns({"x2": F.least(F.col("x") + F.col("w"), F.lit(width)), "y2": F.least(F.col("y") + F.col("h"), F.lit(height)), "x": F.greatest("x", F.lit(0)), "y": F.greatest("y", F.lit(0))})
    clamped = clamped.withColumns({"w": F.col("x2") - F.col("x"), "h": F.col("y2") - F.col("y")}).drop("x2", "y2")
    kept = clamped.where(f"w > 1 AND h > 1 AND w * h >= {MIN_AREA} AND least(w, h) >= {THIN} * greatest(w, h)")
    order = Window.partitionBy("page_id").orderBy("rn")
    return kept.withColumn("region_id", F.format_string("r%04d", F.row_number().over(order) - 1))


def pairs(boxes: DataFrame, predicate: str) -> DataFrame:
    """Pairs ``a.rn < b.rn`` of a page that satisfy a predicate over ``a.`` and ``b.``: a hash join on
    the page with the rest as its condition."""
    return boxes.alias("a").join(boxes.alias("b"), F.expr(f"a.page_id = b.page_id AND a.rn < b.rn AND {predicate}"))


def duplicate_flags(boxes: DataFrame) -> DataFrame:
    """Boxes with ``duplicate``: another box of the page covers the same place."""
    hit = pairs(boxes, f"({g.iom()} >= 0.55 OR {g.max_containment()} >= 0.82)").select("a.page_id", F.explode(F.expr("array(a.rn, b.rn)")).alias("rn")).distinct()
    return boxes.join(hit.withColumn("duplicate", F.lit(True)), ["page_id", "rn"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


#: The smallest ordinal that each ordinal of sorted ``edges`` reaches.
LABELS = (
    "aggregate(edges, map_from_entries(transform(array_distinct(flatten(transform(edges, e -> array(e.i, e.j)))), n -> struct(n, n))), "
    "(m, e) -> if(m[e.i] = m[e.j], m, transform_values(m, (k, v) -> if(v = greatest(m[e.i], m[e.j]), least(m[e.i], m[e.j]), v))))"
)


def connected(nodes: DataFrame, edges: DataFrame, label: str = "component") -> DataFrame:
    """``nodes(page_id, rn)`` with the smallest ordinal that ``edges(page_id, i, j)`` reach, folded from the page's sorted edges."""
    listed = edges.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("edges"))
    closed = listed.withColumn("labels", F.expr(LABELS)).select("page_id", "labels")
    return nodes.join(closed, "page_id", "left").withColumn(label, F.coalesce(F.expr("labels[rn]"), F.col("rn"))).drop("labels")


def components(boxes: DataFrame, predicate: str, label: str = "component") -> DataFrame:
    """Boxes with the smallest ordinal they are connected to by pairs that satisfy the predicate.

    A page is one row in between, so neither its pairs nor its labels are joined.
    """
    rest = [c for c in boxes.columns if c not in ("page_id", "rn")]
    listed = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rn", *rest))).alias("_b"))
    edges = f"flatten(transform(_b, a -> transform(filter(_b, b -> a.rn < b.rn AND {predicate}), b -> struct(a.rn as i, b.rn as j))))"
    closed = listed.withColumn("edges", F.when(F.col("page_id").isNotNull(), F.expr(edges))).withColumn("labels", F.when(F.size("edges") > 0, F.expr(LABELS)))
    rows = closed.select("page_id", "labels", F.explode("_b").alias("_b"))
    return rows.select("page_id", *[F.col(f"_b.{c}").alias(c) for c in boxes.columns if c != "page_id"], F.coalesce(F.expr("labels[_b.rn]"), F.col("_b.rn")).alias(label))


def grouped(boxes: DataFrame, **more: Column) -> DataFrame:
    """Text groups: union of boxes, direction by vote, member count, best source, and ``more`` aggregates of a group."""
    parts = components(boxes, g.should_group())
    return parts.groupBy("page_id", "component").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.expr("count_if(vertical) * 2 >= count(*)").alias("vertical"), F.count("*").alias("members"),
        F.count_if(F.col("source") == "ctd").alias("ctd"), F.count_if(F.col("source") == "multiscale").alias("multiscale"), F.count_if(F.col("source") == "mask_fallback").alias("fallback"), F.round(F.avg("confidence"), 6).alias("confidence"),
        *[c.alias(n) for n, c in more.items()],
    )


def reading_order(groups: DataFrame, mode: str = "auto") -> DataFrame:
    """Groups ranked within the page and named ``g%03d``: right to left, left to right, or by vote."""
    page = Window.partitionBy("page_id")
    right = F.lit(True) if mode == "rtl" else F.lit(False) if mode == "ltr" else F.avg(F.col("vertical").cast("int")).over(page) >= 0.5
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    keyed = groups.withColumns({"_a": F.when(right, -cx).otherwise(cy), "_b": F.when(right, cy).otherwise(cx)})
    order = Window.partitionBy("page_id").orderBy("_a", "_b", "component")
    ranked = keyed.withColumn("position", (F.row_number().over(order) - 1).cast("long"))
    return ranked.withColumn("group_id", F.format_string("g%03d", F.col("position"))).drop("_a", "_b")


def grid_order(boxes: DataFrame, width: int = 900, height: int = 900) -> DataFrame:
    """Boxes ranked on a grid of three columns and four rows, cell weight before place."""
    cell = boxes.withColumns({"cx": F.expr("x + w / 2.0D"), "cy": F.expr("y + h / 2.0D")}).withColumns({"gx": F.expr(f"floor(cx / ({width} / 3.0D))"), "gy": F.expr(f"floor(cy / ({height} / 4.0D))")})
    weight = F.expr(f"(gy * 3 + gx) * {width * height}D + 1.2D * (cx - gx * {width} / 3.0D) + (cy - gy * {height} / 4.0D)")
    order = Window.partitionBy("page_id").orderBy("weight", "rn")
    return cell.withColumn("weight", weight).withColumn("position", F.row_number().over(order).cast("long"))


def suppressed(boxes: DataFrame, order: str, conflict: str, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Greedy suppression: ``kept`` is false for a box that conflicts with a kept one before it.

    ``order``: a struct expression that sorts a page's boxes, ordinal last; ``conflict``: a predicate
    over ``a.`` (kept before) and ``b.`` (the box at hand).
    """
    listed = boxes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.expr(order).alias("_k"), *[c for c in boxes.columns if c not in by]))).alias("_b"))
    # only what stands in the way is kept in the accumulator
    fold = f"aggregate(_b, cast(array() as array<struct<rn:bigint,x:bigint,y:bigint,w:bigint,h:bigint,vertical:boolean>>), (acc, b) -> if(exists(acc, a -> {conflict}), acc, concat(acc, array(named_struct('rn', b.rn, 'x', b.x, 'y', b.y, 'w', b.w, 'h', b.h, 'vertical', b.vertical)))))"
    rows = listed.where(" AND ".join(f"{c} IS NOT NULL" for c in by)).withColumn("_kept", F.expr(f"transform({fold}, a -> a.rn)")).withColumn("_b", F.explode("_b"))
    return rows.select(*[F.col(c) if c in by else F.col(f"_b.{c}").alias(c) for c in boxes.columns], F.expr("array_contains(_kept, _b.rn)").alias("kept"))


def nms(boxes: DataFrame, threshold: float = 0.3, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Boxes by falling confidence; one that overlaps a kept one by more than the threshold goes."""
    return suppressed(boxes, "struct(-confidence, rn)", f"{g.iou()} > {threshold}", by)


#: Groups are drawn in this order: best sources first, then confidence, then size.
RENDER_ORDER = "struct(-ctd, -multiscale, fallback, -confidence, w * h, component)"


def render_collisions(groups: DataFrame) -> DataFrame:
    """Groups with ``kept``: false for one that would be drawn over a better one."""
    return suppressed(groups.withColumn("rn", F.col("component")), RENDER_ORDER, g.render_conflict())

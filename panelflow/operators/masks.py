"""Sparse masks: one row a pixel, keyed by page; set algebra is joins and aggregation on pixel ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 4096


def fill(boxes: DataFrame, every: int = 16) -> DataFrame:
    """Pixel ids of the boxes on a grid of ``every`` pixels."""
    xs = boxes.withColumn("px", F.explode(F.expr(f"sequence(x div {every}, (x + w - 1) div {every})")))
    return xs.withColumn("py", F.explode(F.expr(f"sequence(y div {every}, (y + h - 1) div {every})"))).select("page_id", "rn", (F.col("py") * WIDTH + F.col("px")).alias("pixel"))


def boxes(of: DataFrame, every: int = 16) -> DataFrame:
    """The same masks as boxes of the grid: ``x0, y0, x1, y1``, both ends included."""
    ends = {"x0": f"x div {every}", "y0": f"y div {every}", "x1": f"(x + w - 1) div {every}", "y1": f"(y + h - 1) div {every}"}
    return of.withColumns({n: F.expr(e) for n, e in ends.items()})


def rows(boxes: DataFrame, every: int = 16) -> DataFrame:
    """The same masks as runs: one row for each grid line of a box, with its first and last pixel."""
    return boxes.withColumn("py", F.explode(F.expr(f"sequence(y div {every}, (y + h - 1) div {every})"))).select("page_id", "rn", "py", F.expr(f"x div {every}").alias("x0"), F.expr(f"(x + w - 1) div {every}").alias("x1"))


def run_overlaps(runs: DataFrame) -> DataFrame:
    """Intersection over union and over the smaller mask for pairs that share pixels.

    Masks are runs that are disjoint within a mask, so this is a join of lines, not of pixels.
    """
    size = runs.groupBy("page_id", "rn").agg(F.sum(F.expr("x1 - x0 + 1")).alias("n"))
    a, b = runs.alias("a"), runs.alias("b")
    shared = F.expr("a.page_id = b.page_id and a.py = b.py and a.rn < b.rn and a.x0 <= b.x1 and b.x0 <= a.x1")
    both = a.join(b, shared).groupBy(F.col("a.page_id").alias("page_id"), F.col("a.rn").alias("i"), F.col("b.rn").alias("j")).agg(F.sum(F.expr("least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1")).alias("both"))
    sized = both.join(size.toDF("page_id", "i", "ni"), ["page_id", "i"]).join(size.toDF("page_id", "j", "nj"), ["page_id", "j"])
    return sized.select("page_id", "i", "j", F.expr("both / (ni + nj - both)").alias("iou"), F.expr("both / least(ni, nj)").alias("contained"))

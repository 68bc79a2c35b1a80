"""Per-page records and ports of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model behind a table: takes the rows to work on, returns them with its output.
Port = Callable[[DataFrame], DataFrame]


def manifest(groups: DataFrame) -> DataFrame:
    """One row a page: its groups in reading order, and those that stay unresolved."""
    one = F.struct("position", "group_id", "x", "y", "w", "h", "members", "confidence")
    return groups.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("groups")).withColumn("reading_order", F.expr("transform(groups, g -> g.group_id)")).withColumn("unresolved", F.expr("transform(filter(groups, g -> g.confidence < 0.46), g -> g.group_id)"))


def write(groups: DataFrame, folder: str) -> None:
    manifest(groups).write.mode("overwrite").json(folder)


def once(rows: DataFrame, content: str, port: Port) -> DataFrame:
    """Runs a port once for each distinct content and joins its output back: dear models see no copy twice."""
    keyed = rows.withColumn("_key", F.sha2(F.col(content).cast("binary"), 256))
    out = port(keyed.select("_key", content).dropDuplicates(["_key"]))
    return keyed.join(out.drop(content), "_key").drop("_key")


def with_status(pages: DataFrame, failed: DataFrame) -> DataFrame:
    """Pages with an explicit status instead of a failure that looks like success."""
    return pages.join(failed.select("page_id", F.lit("failed").alias("_s")).distinct(), "page_id", "left").withColumn("page_status", F.coalesce("_s", F.lit("done"))).drop("_s")


def page_record(regions: DataFrame, groups: DataFrame) -> DataFrame:
    """One nested row a page: its regions, its groups in reading order with status and texts, texts by group, and what
    stays unresolved with its reason."""
    boxes = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rn", "x", "y", "w", "h", "vertical", "confidence", "source"))).alias("regions"))
    one = F.struct("position", "group_id", "x", "y", "w", "h", "status", "skip_reason", "text", "translation")
    listed = groups.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("groups"))
    by_group = lambda c: F.expr(f"map_from_entries(transform(groups, g -> struct(g.group_id, g.{c})))")
    told = listed.withColumns({"reading_order": F.expr("transform(groups, g -> g.group_id)"), "ocr_text": by_group("text"), "translation": by_group("translation"), "unresolved": F.expr("transform(filter(groups, g -> g.status <> 'ready'), g -> struct(g.group_id, g.status, g.skip_reason))")})
    return boxes.join(told, "page_id", "full")


def annotations(regions: DataFrame, width: int, height: int) -> DataFrame:
    """Per page the label file (class, centre and sides as shares of the page) and the polygon file, a line a region."""
    label = F.expr(f"concat_ws(' ', if(vertical, 1, 0), round((x + w / 2.0D) / {width}, 6), round((y + h / 2.0D) / {height}, 6), round(w / {width}, 6), round(h / {height}, 6))")
    corners = F.expr("concat_ws(',', x, y, x + w, y, x + w, y + h, x, y + h)")
    rows = regions.withColumns({"_l": label, "_p": corners})
    listed = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rn", "_l", "_p"))).alias("_r"))
    text = lambda c: F.expr(f"array_join(transform(_r, r -> r.{c}), '\\n')")
    return listed.select("page_id", text("_l").alias("labels"), text("_p").alias("polygons"))

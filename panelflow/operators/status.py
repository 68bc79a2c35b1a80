"""What becomes of a group: each step moves a live group on or rejects it, with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_QUALITY = 0.46


def vetoed(groups: DataFrame) -> DataFrame:
    """Readings with ``fallback_only``; those without mask pixels are rejected whatever they say."""
    out = groups.withColumns({"fallback_only": F.expr("members > 0 and fallback = members"), "reason": F.expr("if(mask_pixels > 0, reason, 'missing_text_mask')")})
    return out.withColumn("status", F.expr("if(reason is null or reason = '', 'ocr_done', 'ocr_rejected')"))


def translatable(groups: DataFrame, noise_check: bool = True) -> DataFrame:
    """Groups that are accepted for translation; failures of reading keep their status."""
    low = f"confidence < {MIN_QUALITY}" if noise_check else "false"
    rejected = F.expr(f"status not in ('ocr_rejected', 'ocr_failed') and (norm = '' or {low})")
    reason = F.expr("if(norm = '', 'empty_ocr', concat('low_ocr_quality:', format_string('%.3f', confidence)))")
    status = F.when(rejected, "ocr_rejected").when(F.col("status").isin("ocr_rejected", "ocr_failed"), F.col("status")).otherwise("ocr_accepted")
    return groups.withColumns({"status": status, "skip_reason": F.when(rejected, reason).otherwise(F.col("skip_reason"))})


def validated(groups: DataFrame, issues: str = "issues") -> DataFrame:
    """Translated groups: ready, or rejected with what is wrong; an invalid text is not kept."""
    good = f"size({issues}) = 0"
    return groups.withColumns({"translation": F.expr(f"if({good}, translation, '')"), "translation_valid": F.expr(good), "status": F.expr(f"if({good}, 'ready', 'translation_rejected')"), "skip_reason": F.expr(f"if({good}, '', array_join({issues}, ','))")})


def renderable(groups: DataFrame) -> DataFrame:
    return groups.where("translation_valid and trim(translation) <> ''")


def active(groups: DataFrame, only_translated: bool = True) -> DataFrame:
    """Groups whose source pixels are erased."""
    return renderable(groups) if only_translated else groups


def members(groups: DataFrame, regions: DataFrame, ids: str = "region_ids") -> DataFrame:
    """``page_id, group_id, place`` with the region of each id; ids without a region stay out."""
    listed = groups.select("page_id", "group_id", F.posexplode(ids).alias("place", "region_id"))
    return listed.join(regions, ["page_id", "region_id"])


def totals(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: pages, failed pages, groups, regions, and groups that were rejected."""
    a = groups.agg(F.count("*").alias("groups"), F.sum("members").alias("regions"), F.count_if(F.col("status").like("%rejected")).alias("rejected"))
    return pages.agg(F.count("*").alias("pages"), F.count_if("failed").alias("failed")).join(a)


def survivors(groups: DataFrame, conflict: str) -> DataFrame:
    """Layout conflicts settled in order: ``layout_status`` of each group of ``x, y, w, h`` (its block), ``font``, and
    ``cx, cy, cw, ch, cfont`` (its compact block, null if there is none).

    A block that conflicts with one that stands takes its compact form if that is free, else it goes.
    ``conflict``: a predicate over ``a.`` (standing) and ``b.`` with ``x, y, w, h, font``.
    """
    block = "named_struct('rn', b.rn, 'x', b.{0}x, 'y', b.{0}y, 'w', b.{0}w, 'h', b.{0}h, 'font', b.{0}font, 'how', '{1}')"
    clash = conflict
    free = "cast(null as struct<rn:bigint,x:bigint,y:bigint,w:bigint,h:bigint,font:bigint,how:string>)"
    compact = clash.replace("b.x", "b.cx").replace("b.y", "b.cy").replace("b.w", "b.cw").replace("b.h", "b.ch").replace("b.font", "b.cfont")
    step = f"if(not exists(acc, a -> {clash}), {block.format('', 'planned')}, if(b.cx is not null and not exists(acc, a -> {compact}), {block.format('c', 'compact')}, {free}))"
    row = "struct(rank, rn, x, y, w, h, font, cx, cy, cw, ch, cfont)"
    fold = f"aggregate(array_sort(collect_list({row})), cast(array() as array<struct<rn:bigint,x:bigint,y:bigint,w:bigint,h:bigint,font:bigint,how:string>>), (acc, b) -> filter(concat(acc, array({step})), s -> s is not null))"
    kept = groups.groupBy("page_id").agg(F.expr(fold).alias("_kept")).select("page_id", F.explode("_kept").alias("s")).select("page_id", "s.rn", F.col("s.how").alias("_how"))
    return groups.join(kept, ["page_id", "rn"], "left").withColumn("layout_status", F.coalesce("_how", F.lit("layout_collision_rejected"))).drop("_how")

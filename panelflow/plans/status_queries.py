"""Queries over statuses, lookups and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import layout, metrics, pages, raster, status
from .page_queries import ALL, REGIONS, regions
from .registry import query
from .text_queries import PAIRS, pairs

#: Groups of one region each, with a reading that some of them lack.
READ = "read AS (SELECT *, CASE WHEN rn % 6 = 5 THEN '' ELSE source END AS norm, CASE WHEN rn % 11 = 10 THEN 'ocr_failed' ELSE 'ocr_done' END AS status, '' AS skip_reason, 1 AS members, CASE WHEN source = 'mask_fallback' THEN 1 ELSE 0 END AS fallback, CASE WHEN rn % 4 = 3 THEN 0 ELSE w END AS mask_pixels FROM regions)"


def read(spark, sf):
    made = {"norm": "if(rn % 6 = 5, '', source)", "status": "if(rn % 11 = 10, 'ocr_failed', 'ocr_done')", "skip_reason": "''", "members": "1", "fallback": "if(source = 'mask_fallback', 1, 0)", "mask_pixels": "if(rn % 4 = 3, 0, w)", "reason": "if(rn % 6 = 5, 'empty_ocr', '')"}
    return regions(spark, sf).withColumns({k: F.expr(v) for k, v in made.items()})


@query("status_veto", f"WITH {REGIONS}, {READ} SELECT page_id, rn, source = 'mask_fallback' AS fallback_only, CASE WHEN mask_pixels = 0 OR norm = '' THEN 'ocr_rejected' ELSE 'ocr_done' END AS status, CASE WHEN mask_pixels = 0 THEN 'missing_text_mask' WHEN norm = '' THEN 'empty_ocr' ELSE '' END AS reason FROM read")
def status_veto(spark, sf):
    return status.vetoed(read(spark, sf)).select("page_id", "rn", "fallback_only", "status", "reason")


@query("status_translatable", f"WITH {REGIONS}, {READ} SELECT page_id, rn, CASE WHEN status = 'ocr_failed' THEN status WHEN norm = '' OR confidence < 0.46 THEN 'ocr_rejected' ELSE 'ocr_accepted' END AS status, CASE WHEN status = 'ocr_failed' THEN '' WHEN norm = '' THEN 'empty_ocr' WHEN confidence < 0.46 THEN printf('low_ocr_quality:%.3f', confidence) ELSE '' END AS skip_reason FROM read")
def status_translatable(spark, sf):
    return status.translatable(read(spark, sf)).select("page_id", "rn", "status", "skip_reason")


CHECKED = f"""WITH {PAIRS}, w AS (SELECT *, length(regexp_replace(target, '\\s', '', 'g')) AS n, greatest(1, length(regexp_replace(source, '\\s', '', 'g'))) AS m FROM pairs WHERE role = 'user' AND next_role = 'assistant'), v AS (SELECT conv_id, turn, target, n, CASE WHEN trim(target) = '' THEN ['empty'] ELSE list_filter([CASE WHEN n > greatest(24, trunc(m * 4.0 + 12)) THEN 'too_long' END, CASE WHEN NOT regexp_matches(target, '[\\p{{L}}\\p{{N}}]') THEN 'punctuation_only' END,
CASE WHEN regexp_matches(target, '[\\p{{L}}\\p{{N}}]') AND n >= 4 AND length(regexp_replace(target, '[^\\p{{P}}\\p{{S}}]', '', 'g')) > 0.65 * n THEN 'excessive_punctuation' END], lambda x: x IS NOT NULL) END AS issues FROM w)"""


def checked(spark, sf):
    return pairs(spark, sf).withColumn("issues", t.issues("source", "target")).withColumn("translation", F.col("target"))


@query("status_validated", CHECKED + " SELECT conv_id, turn, CASE WHEN len(issues) = 0 THEN 'ready' ELSE 'translation_rejected' END AS status, array_to_string(issues, ',') AS skip_reason, CASE WHEN len(issues) = 0 THEN target ELSE '' END AS translation FROM v")
def status_validated(spark, sf):
    return status.validated(checked(spark, sf)).select("conv_id", "turn", "status", "skip_reason", "translation")


@query("status_renderable", CHECKED + " SELECT conv_id, turn FROM v WHERE len(issues) = 0 AND trim(target) <> ''")
def status_renderable(spark, sf):
    return status.active(status.validated(checked(spark, sf))).select("conv_id", "turn")


@query("region_lookup", ALL + " SELECT r.page_id, p.component, row_number() OVER (PARTITION BY r.page_id, p.component ORDER BY r.rn) - 1 AS place, r.rn FROM regions r JOIN parts p USING (page_id, rn) WHERE r.rn % 7 <> 6")
def region_lookup(spark, sf):
    parts = pages.components(regions(spark, sf), pages.g.should_group())
    groups = parts.where("rn % 7 <> 6").groupBy("page_id", F.col("component").alias("group_id")).agg(F.array_sort(F.collect_list("rn")).alias("ids"))
    # ids of regions that are gone name nothing
    groups = groups.withColumn("region_ids", F.concat("ids", F.array(F.lit(-1).cast("long"))))
    found = status.members(groups, regions(spark, sf).withColumnRenamed("rn", "region_id"))
    return found.select("page_id", F.col("group_id").alias("component"), F.col("place").cast("long").alias("place"), F.col("region_id").alias("rn"))


@query("run_totals", f"WITH {REGIONS}, {READ}, s AS (SELECT CASE WHEN norm = '' OR confidence < 0.46 THEN 1 ELSE 0 END AS bad, status FROM read) SELECT (SELECT count(DISTINCT page_id) FROM regions) AS pages, (SELECT count(DISTINCT page_id) FROM regions WHERE page_id % 97 = 0) AS failed, count(*) AS groups, count(*) AS regions, count(*) FILTER (bad = 1 AND status <> 'ocr_failed') AS rejected FROM s")
def run_totals(spark, sf):
    all_pages = regions(spark, sf).select("page_id").distinct().withColumn("failed", F.col("page_id") % 97 == 0)
    return status.totals(status.translatable(read(spark, sf)), all_pages)


CONFLICT = layout.block_conflict("a.", "b.", "least(a.font, b.font)")
COMPACT = CONFLICT.replace("b.x", "b.cx").replace("b.y", "b.cy").replace("b.w", "b.cw").replace("b.h", "b.ch").replace("b.font", "b.cfont")
_KEPT = "{{rn: b.rn, x: b.{0}x, y: b.{0}y, w: b.{0}w, h: b.{0}h, font: b.{0}font, how: '{1}'}}"
BLOCKS = "blocks AS (SELECT page_id, rn, x, y, w, h, 20 + rn % 9 AS font, x + w // 4 AS cx, y + h // 4 AS cy, w // 2 AS cw, h // 2 AS ch, 12 AS cfont, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, rn) AS rank FROM regions)"


@query("layout_survivors", f"""WITH RECURSIVE {REGIONS}, {BLOCKS},
walk AS (SELECT b.page_id, b.rank, [{_KEPT.format('', 'planned')}] AS acc FROM blocks b WHERE rank = 1 UNION ALL SELECT b.page_id, b.rank, CASE WHEN len(list_filter(s.acc, lambda a: {CONFLICT})) = 0 THEN list_append(s.acc, {_KEPT.format('', 'planned')})
  WHEN len(list_filter(s.acc, lambda a: {COMPACT})) = 0 THEN list_append(s.acc, {_KEPT.format('c', 'compact')}) ELSE s.acc END FROM walk s JOIN blocks b ON b.page_id = s.page_id AND b.rank = s.rank + 1),
done AS (SELECT page_id, unnest(arg_max(acc, rank)) AS e FROM walk GROUP BY page_id)
SELECT b.page_id, b.rn, coalesce(e.how, 'layout_collision_rejected') AS layout_status FROM blocks b LEFT JOIN done d ON d.page_id = b.page_id AND d.e.rn = b.rn""")  # fmt: skip
def layout_survivors(spark, sf):
    from pyspark.sql import Window

    r = regions(spark, sf).withColumns({"font": F.expr("20 + rn % 9"), "cx": F.expr("x + w div 4"), "cy": F.expr("y + h div 4"), "cw": F.expr("w div 2"), "ch": F.expr("h div 2"), "cfont": F.expr("12L"), "rank": F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("confidence"), "rn"))})
    return status.survivors(r, CONFLICT).select("page_id", "rn", "layout_status")


@query("undetected_pieces", f"WITH {REGIONS} SELECT a.page_id, a.rn FROM regions a WHERE rn % 2 = 1 AND NOT EXISTS (SELECT 1 FROM regions b WHERE b.page_id = a.page_id AND b.rn % 2 = 0 AND {metrics.g.intersection()} * 2 >= {metrics.g.area('a.')})")
def undetected_pieces(spark, sf):
    r = regions(spark, sf)
    return raster.missed(r.where("rn % 2 = 1"), r.where("rn % 2 = 0")).select("page_id", "rn")


CARE = f"{REGIONS}, truth AS (SELECT * FROM regions WHERE rn % 2 = 1), found AS (SELECT * FROM regions WHERE rn % 2 = 0)"


@query("ignored_detections", f"WITH {CARE} SELECT b.page_id, b.rn FROM found b WHERE EXISTS (SELECT 1 FROM truth a WHERE a.page_id = b.page_id AND a.rn % 3 = 0 AND {metrics.g.intersection()} * 1.0E0 / greatest(1, {metrics.g.area('b.')}) > 0.5)")
def ignored_detections(spark, sf):
    r = regions(spark, sf)
    return metrics.ignored(r.where("rn % 2 = 1 and rn % 3 = 0"), r.where("rn % 2 = 0")).select("page_id", "rn")


@query("dataset_scores", "SELECT 3::BIGINT AS batches, 0.5::DOUBLE AS precision, 0.25::DOUBLE AS recall, round(2 * 0.5 * 0.25 / (0.5 + 0.25 + 1e-8), 9)::DOUBLE AS fmeasure")
def dataset_scores(spark, sf):
    batches = spark.createDataFrame([(2, 8, 4), (0, 4, 4), (2, 4, 0)], "hits long, gts long, dets long")
    total = metrics.dataset(batches)
    return total.select("batches", "precision", "recall", F.round("fmeasure", 9).alias("fmeasure"))


@query("running_average", f"WITH {REGIONS} SELECT page_id, rn, w AS val, sum(w) OVER k::BIGINT AS sum, count(*) OVER k AS count, round(avg(w) OVER k, 6) AS avg FROM regions WINDOW k AS (PARTITION BY page_id ORDER BY rn ROWS UNBOUNDED PRECEDING)")
def running_average(spark, sf):
    return metrics.running(regions(spark, sf), "page_id", "rn", "w").withColumn("avg", F.round("avg", 6))

"""Detection metrics: matching of found boxes with true ones, precision, recall, average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def match(truth: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy one-to-one matches ``page_id, gt, det`` in (truth, found) order where IoU passes."""
    pairs = truth.alias("a").join(found.alias("b"), F.expr(f"a.page_id = b.page_id AND {g.intersection()} > 0 AND {g.iou()} > {threshold}"))
    listed = pairs.groupBy(F.col("a.page_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("a.rn").alias("gt"), F.col("b.rn").alias("det")))).alias("pairs"))
    fold = "aggregate(pairs, cast(array() as array<struct<gt:bigint,det:bigint>>), (acc, p) -> if(exists(acc, m -> m.gt = p.gt or m.det = p.det), acc, concat(acc, array(p))))"
    return listed.select("page_id", F.explode(F.expr(fold)).alias("m")).select("page_id", "m.gt", "m.det")


def page_scores(truth: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    """Recall, precision and their harmonic mean of each page."""
    n = truth.groupBy("page_id").agg(F.count("*").alias("gts")).join(found.groupBy("page_id").agg(F.count("*").alias("dets")), "page_id", "full").join(matched.groupBy("page_id").agg(F.count("*").alias("hits")), "page_id", "left").na.fill(0, ["gts", "dets", "hits"])
    scored = n.withColumns({"recall": F.expr("if(gts = 0, 1.0D, hits / gts)"), "precision": F.expr("if(gts = 0, if(dets > 0, 0.0D, 1.0D), if(dets = 0, 0.0D, hits / dets))")})
    return scored.withColumn("hmean", F.expr("if(recall + precision = 0, 0.0D, 2 * recall * precision / (recall + precision))"))


def average_precision(found: DataFrame, matched: DataFrame, truths: DataFrame) -> DataFrame:
    """Per page: the sum of the running precision at hits, in falling confidence, over the number of true boxes."""
    flagged = found.join(matched.select("page_id", F.col("det").alias("rn"), F.lit(1).alias("hit")), ["page_id", "rn"], "left").na.fill(0, ["hit"])
    w = Window.partitionBy("page_id").orderBy(F.desc("confidence"), "rn").rowsBetween(Window.unboundedPreceding, 0)
    at = flagged.withColumn("p", F.when(F.col("hit") == 1, F.sum("hit").over(w) / F.count("*").over(w)).otherwise(0.0))
    return at.groupBy("page_id").agg(F.sum("p").alias("p")).join(truths.groupBy("page_id").agg(F.count("*").alias("n")), "page_id").select("page_id", F.round(F.col("p") / F.col("n"), 6).alias("ap"))


def ignored(unread: DataFrame, found: DataFrame, most: float = 0.5) -> DataFrame:
    """Found boxes of which more than a share lies in a true box that does not count."""
    share = f"{g.intersection()} * 1.0E0 / greatest(1, {g.area('b.')}) > {most}"
    return found.alias("b").join(unread.alias("a"), F.expr(f"a.page_id = b.page_id AND {share}"), "left_semi")


def dataset(pages: DataFrame) -> DataFrame:
    """Precision, recall and their measure over all of ``pages(hits, gts, dets)``."""
    total = pages.agg(F.count("*").alias("batches"), F.sum("hits").alias("hits"), F.sum("gts").alias("gts"), F.sum("dets").alias("dets"))
    rated = total.withColumns({"recall": F.expr("if(gts > 0, hits / gts, 0.0D)"), "precision": F.expr("if(dets > 0, hits / dets, 0.0D)")})
    return rated.withColumns({"hmean": F.expr("if(recall + precision > 0, 2 * recall * precision / (recall + precision), 0.0D)"), "fmeasure": F.expr("2 * precision * recall / (precision + recall + 1e-8D)")})


def running(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The value, sum, count and average of each key so far."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(by, order, F.col(value).alias("val"), F.sum(value).over(w).alias("sum"), F.count(value).over(w).alias("count"), F.avg(value).over(w).alias("avg"))

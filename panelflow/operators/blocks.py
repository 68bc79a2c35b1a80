"""Lines and blocks: nearest block of a line, lines split at gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def assign(lines: DataFrame, blocks: DataFrame, least: float = 0.4) -> DataFrame:
    """``page_id, rn, block``: the block that covers most of a line, the first on ties, else null."""
    share = f"{g.intersection()} * 1.0D / greatest(1, {g.area('a.')})"
    pairs = lines.alias("a").join(blocks.alias("b"), F.expr(f"a.page_id = b.page_id AND {g.intersection()} > 0")).select("a.page_id", "a.rn", F.col("b.rn").alias("block"), F.expr(share).alias("share"))
    best = pairs.groupBy("page_id", "rn").agg(F.expr("max_by(struct(block, share), struct(share, -block))").alias("best"))
    return lines.select("page_id", "rn").join(best, ["page_id", "rn"], "left").select("page_id", "rn", F.when(F.col("best.share") > least, F.col("best.block")).alias("block"))


def split(lines: DataFrame, gap: str) -> DataFrame:
    """Lines of a page with the number of their piece: a new one starts where the distance to the line before exceeds ``gap``."""
    w = Window.partitionBy("page_id").orderBy("y", "rn")
    new = F.when(F.col("y") - F.lag(F.col("y") + F.col("h")).over(w) > F.expr(gap), 1).otherwise(0)
    return lines.withColumn("_new", new).withColumn("piece", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

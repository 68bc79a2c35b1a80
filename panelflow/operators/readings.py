"""Readings of one group: agreement, acceptance, the order to read again, and their combination.

Likeness of texts is measured once a pair, in Arrow; every fold over a group's readings looks its
steps up in what was measured, so the folds stay in Catalyst.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions import text as t


def once(candidates: DataFrame) -> DataFrame:
    """Candidates once per (group, source, text), the first of them."""
    w = Window.partitionBy("group_id", "source", "normalized").orderBy("ordinal")
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def agreement(best: DataFrame, candidates: DataFrame) -> DataFrame:
    """``group_id, agreement``: how like a group's ``best(group_id, source, normalized)`` is to what other sources read."""
    other = candidates.where("normalized <> ''").select("group_id", F.col("source").alias("_source"), F.col("normalized").alias("_other"))
    pairs = best.join(other, "group_id").where("source <> _source").withColumn("like", t.similarity("normalized", "_other"))
    return best.select("group_id").distinct().join(pairs.groupBy("group_id").agg(F.max("like").alias("agreement")), "group_id", "left").withColumn("agreement", F.coalesce("agreement", F.lit(0.0)))


@F.pandas_udf(T.DoubleType())
def _most_alike(text: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([max((t.ratio(a or "", o) for o in os), default=0.0) for a, os in zip(text, others, strict=True)], dtype="float64")


def first_agreement(candidates: DataFrame, by: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """``by, agreement`` of each group's first reading, as ``agreement`` has it: a group is one row, so nothing is joined."""
    one = candidates.groupBy(*by).agg(F.min_by(F.struct("source", "normalized"), "ordinal").alias("b"), F.collect_set(F.struct("source", "normalized")).alias("rs"))
    others = F.expr("transform(filter(rs, r -> r.source <> b.source and r.normalized <> ''), r -> r.normalized)")
    return one.select(*by, _most_alike("b.normalized", others).alias("agreement"))


def fallback_reason(q: str, meaningful: str, agreed: str) -> Column:
    """The first reason to reject a reading that only fallback regions gave, or null."""
    return F.expr(
        f"case when {q} < {t.FALLBACK_QUALITY} then concat('fallback_low_quality:', format_string('%.3f', {q})) when {meaningful} < 2 then concat('fallback_too_short:', {meaningful}) "
        f"when {agreed} < {t.AGREEMENT} then concat('fallback_disagreement:', format_string('%.3f', {agreed})) end"
    )


def meaningful(text: str) -> Column:
    """Number of kana and ideographs."""
    return F.expr(f"{t.count(text, t.KANA)} + {t.count(text, t.CJK)}").cast("long")


#: Which groups are read again: with other views of the image, and region by region (over raw_quality,
#: members, fallback, marked, alike, and the lengths of both first readings).
DISAGREE = "(mask_length > 0 AND raw_length + mask_length > 0 AND (alike < 0.88 OR abs(raw_length - mask_length) >= 2))"
AGAIN = {
    "other_views": f"(raw_quality < 0.76 OR members > 1 OR fallback > 0 OR marked OR {DISAGREE})",
    "by_region": f"(members > 1 OR greatest(raw_quality, mask_quality) < 0.66 OR fallback > 0 OR marked OR {DISAGREE})",
}


def leaves(parts: DataFrame) -> DataFrame:
    """``group_id, text, quality``: texts of ``parts(group_id, ordinal, text, quality)`` in order, and their mean quality,
    a little more for several."""
    listed = parts.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("_p"), F.avg("quality").alias("_q"), F.count("*").alias("_n"))
    return listed.select("group_id", F.expr("array_join(transform(_p, p -> p.text), '')").alias("text"), F.expr("least(1.0D, _q + if(_n > 1, 0.03D, 0.0D))").alias("quality"))


def _shared(a: str, b: str) -> float:
    """Longest common run over the shorter text; all of it where one holds the other."""
    return 1.0 if a and b and (a in b or b in a) else t.longest(a, b)


likeness, shares = t.square(t.ratio), t.square(_shared)


def combined(readings: DataFrame, by: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """``by, text, quality, source`` from ``readings(by, ordinal, x, y, w, h, text, normalized, quality)``
    of a group's regions, in reading order.

    Readings of one footprint that say the same become one, the fuller kept. One that holds a clearly
    smaller one is a whole beside its columns: wholes and the columns joined are alternatives, never
    added up. Of the alternatives the best candidate counts, or a fuller one that explains it. A group
    is one row from the start, so nothing is joined; a single text is not compared, and nothing asks for it.
    """
    one = readings.where("normalized <> ''").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ordinal", "x", "y", "w", "h", "text", "normalized", "quality"))).alias("rs"))
    one = one.withColumns({"n": F.size("rs"), "words": F.expr("if(size(rs) > 1, transform(rs, r -> r.normalized), null)")}).withColumns({"likes": likeness("words"), "runs": shares("words")})
    weight = lambda p: f"struct({p}.quality + least(0.10D, 0.006D * length({p}.normalized)), length({p}.normalized), {g.area(p + '.')})"
    same = f"{g.iom('rs[e].', 'rs[o].')} >= 0.62 and {g.area_ratio('rs[e].', 'rs[o].')} >= 0.55 and (likes[e * n + o] >= 0.66 or runs[e * n + o] >= 0.78)"
    kept = f"aggregate(sequence(0, n - 1), cast(array() as array<int>), (acc, o) -> transform(array(array_position(transform(acc, e -> {same}), true)), at -> if(at = 0, concat(acc, array(o)), transform(acc, (e, k) -> if(k + 1 = at and {weight('rs[o]')} > {weight('rs[e]')}, o, e))))[0])"
    held = f"{g.containment('rs[i].', 'rs[o].')} >= 0.88 and {g.area('rs[i].')} * 1.0D / greatest(1, {g.area('rs[o].')}) <= 0.78"
    split = one.withColumn("kept", F.expr(kept)).withColumn("wholes", F.expr(f"filter(kept, o -> exists(kept, i -> i <> o and {held}))")).withColumn("columns", F.expr("filter(kept, o -> not array_contains(wholes, o))"))
    joined = "array_join(transform(columns, i -> rs[i].text), '')"
    quality = "least(1.0D, aggregate(columns, 0.0D, (a, i) -> a + rs[i].quality) / size(columns) + if(size(columns) > 1, 0.03D, 0.0D))"
    split = split.withColumn("joined", F.expr(joined)).withColumn("weak", t.weak(F.col("joined")))
    last = f"if(size(columns) > 0, array(struct(joined as text, weak as normalized, {quality} as quality, if(size(wholes) > 0, 'leaves', 'combined') as source)), array())"
    alternatives = f"filter(concat(transform(wholes, i -> struct(rs[i].text as text, rs[i].normalized as normalized, rs[i].quality as quality, concat('whole:', i) as source)), {last}), c -> c.normalized <> '')"
    made = split.select(*by, F.expr(alternatives).alias("cs")).withColumns({"m": F.size("cs"), "words": F.expr("if(size(cs) > 1, transform(cs, c -> c.normalized), null)")})
    # before what is measured, the optimizer would move this down and spell out every fold in it many times over
    made = made.withColumns({"likes": likeness("words"), "runs": shares("words"), "mid": F.expr("array_sort(transform(cs, c -> length(c.normalized)))[int(size(cs) / 2)]")}).where("m > 0")
    agreed = "coalesce(array_max(transform(filter(sequence(0, m - 1), j -> j <> i), j -> likes[i * m + j])), 0.0D)"
    fuller = "aggregate(filter(cs, d -> contains(c.normalized, d.normalized) and length(c.normalized) > length(d.normalized)), 0.0D, (a, d) -> a + least(0.12D, 0.025D * (length(c.normalized) - length(d.normalized))))"
    scores = f"transform(cs, (c, i) -> 0.72D * c.quality + 0.28D * {agreed} + {fuller} - if(length(c.normalized) > 2.8D * mid + 6, 0.18D, 0.0D))"
    best = made.withColumn("scores", F.expr(scores)).withColumn("best", F.expr("cast(array_position(scores, array_max(scores)) - 1 as int)"))
    takes = "runs[b * m + o] >= 0.62 and length(cs[o].normalized) >= length(cs[b].normalized) + 2 and cs[o].quality >= cs[b].quality - 0.16"
    chosen = best.withColumn("best", F.expr(f"aggregate(sequence(0, m - 1), best, (b, o) -> if({takes}, o, b))")).withColumn("c", F.expr("cs[best]"))
    return chosen.select(*by, "c.text", "c.quality", "c.source")

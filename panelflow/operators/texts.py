"""Operators over readings and translations: candidates, context, batches, responses, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

BATCH, CONTEXT, PAGE_CHARS, PAGE_ITEMS = 20, 2, 6000, 120


def best_per_key(candidates: DataFrame) -> DataFrame:
    """Candidates once per (group, text, source): the higher quality, the first on ties."""
    w = Window.partitionBy("group_id", "normalized", "source").orderBy(F.desc("quality"), "ordinal")
    return candidates.where("normalized <> ''").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The reading of each group that quality, agreement and completeness speak for.

    Pairs stay within a group, whose candidates are a handful; similarity is an Arrow function.
    """
    a, b = candidates.alias("a"), candidates.alias("b")
    pairs = a.join(b, F.expr("a.group_id = b.group_id and a.ordinal <> b.ordinal")).select("a.group_id", "a.ordinal", F.col("a.normalized").alias("x"), F.col("b.normalized").alias("y"))
    scored = pairs.withColumn("sim", t.similarity("x", "y")).withColumn("bonus", F.expr("if(contains(x, y) and x <> y, least(0.12D, 0.025D * (char_length(x) - char_length(y))), 0.0D)"))
    support = scored.groupBy("group_id", "ordinal").agg(F.max("sim").alias("sim"), F.sum("bonus").alias("bonus"))
    middle = candidates.groupBy("group_id").agg(F.expr("array_sort(collect_list(char_length(normalized)))[cast(floor(count(*) / 2) as int)]").alias("mid"))
    joined = candidates.join(support, ["group_id", "ordinal"], "left").join(middle, "group_id")
    score = F.expr("0.72D * quality + 0.28D * coalesce(sim, 0.0D) + coalesce(bonus, 0.0D) - if(char_length(normalized) > 2.8D * mid + 6, 0.18D, 0.0D)")
    w = Window.partitionBy("group_id").orderBy(F.desc("score"), "ordinal")
    return joined.withColumn("score", score).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "sim", "bonus", "mid")


def context(items: DataFrame, page: str, order: str, k: int = CONTEXT) -> DataFrame:
    """Each item with its neighbours within ``k`` places, as an array in order."""
    w = Window.partitionBy(page).orderBy(order).rowsBetween(-k, k)
    return items.withColumn("window", F.collect_list(F.struct(F.col(order).alias("at"), F.col("text"))).over(w))


def batches(items: DataFrame, page: str, order: str, size: int = BATCH) -> DataFrame:
    """Items that are not blank, numbered, in batches of ``size``."""
    w = Window.partitionBy(page).orderBy(order)
    live = items.where(F.trim("text") != "")
    return live.withColumn("item_no", F.row_number().over(w) - 1).withColumn("batch", F.expr(f"cast(item_no div {size} as bigint)")).withColumn("item_id", F.format_string("T%04d", F.col("item_no")))


def route(items: DataFrame, page: str, chars: int = PAGE_CHARS, most: int = PAGE_ITEMS) -> DataFrame:
    """Per page, whether it is translated at once or in batches."""
    return items.groupBy(page).agg(F.sum(F.char_length("text")).alias("chars"), F.count("*").alias("items")).withColumn("mode", F.when((F.col("chars") > chars) | (F.col("items") > most), "batch").otherwise("page"))


def glossary_terms(items: DataFrame, glossary: DataFrame) -> DataFrame:
    """Glossary entries ``term, target`` that occur in some text, terms with themselves as a key.

    Every text gives its pieces of the lengths that terms have, so the search is an equi-join however
    many terms there are; a text gives each piece once, and pieces that are no terms end there.
    """
    lengths = glossary.select(F.char_length("term").alias("_n")).where("_n > 0").distinct()
    texts_ = items.select("text").distinct()
    pieces = texts_.join(F.broadcast(lengths), F.expr("char_length(text) >= _n")).select(F.explode(F.expr("array_distinct(transform(sequence(1, char_length(text) - _n + 1), i -> substr(text, i, _n)))")).alias("term"))
    pieces = pieces.join(glossary.select("term").distinct(), "term", "left_semi").distinct()
    return glossary.join(pieces, "term", "left_semi").select("term", "target").distinct()


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per key the upper median of whole numbers, from counts of each value, so that no list of all rows is held."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"_upto": F.sum("_n").over(up), "_all": F.sum("_n").over(Window.partitionBy(by))})
    return placed.where("_upto > _all div 2").groupBy(by).agg(F.min(value).alias(value))


def strip_fences(text: str) -> F.Column:
    return F.expr(f"regexp_replace(regexp_replace({text}, '^\\\\s*```(json)?\\\\s*', ''), '\\\\s*```\\\\s*$', '')")


def parse_json(responses: DataFrame) -> DataFrame:
    """``request, item_id, text`` of answers ``{"translations": [{"id", "text"}]}``; malformed ones give none."""
    parsed = responses.withColumn("r", F.from_json(strip_fences("response"), "translations array<struct<id:string,text:string>>"))
    return parsed.select("request", F.explode("r.translations").alias("i")).select("request", F.col("i.id").alias("item_id"), F.col("i.text").alias("text"))


def parse_numbered(responses: DataFrame) -> DataFrame:
    """``request, no, text`` of answers with lines like ``[0]: text``."""
    lines = responses.select("request", F.explode(F.split("response", "\n")).alias("line"))
    pattern = r"^\s*\[?T?(\d+)\]?\s*[:：.]\s*(.+)$"
    return lines.where(F.col("line").rlike(pattern)).select("request", F.regexp_extract("line", pattern, 1).cast("long").alias("no"), F.trim(F.regexp_extract("line", pattern, 2)).alias("text"))


def first_valid(attempts: DataFrame) -> DataFrame:
    """Of an item's answers the first valid one: ``request, item_id, text``; items without one stay out."""
    w = Window.partitionBy("request", "item_id").orderBy("attempt")
    return attempts.where("valid").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

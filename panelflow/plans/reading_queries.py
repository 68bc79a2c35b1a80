"""Queries over the readings of a group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages, readings
from .page_queries import ALL, REGIONS, regions
from .registry import query
from .source_queries import SAID

#: Literal Japanese readings, as the test tables hold Latin text only.
WORDS = "(VALUES (1, 'どうしたの'), (2, '今日は良い天気'), (3, 'abc'), (4, 'え'), (5, 'コーヒー 3杯'), (6, ''), (7, '𠮷野家')) v(id, text)"
PARTS = "said AS (SELECT r.*, p.component, {0} AS text FROM regions r JOIN parts p USING (page_id, rn))".format(SAID)


def parts(spark, sf):
    r = pages.components(regions(spark, sf), pages.g.should_group()).withColumn("text", F.expr(SAID))
    return r.select("page_id", F.concat_ws(":", "page_id", "component").alias("group_id"), F.col("rn").alias("ordinal"), "x", "y", "w", "h", "source", "text", F.col("text").alias("normalized"), F.col("confidence").alias("quality"))


@query("meaningful_count", f"SELECT id, length(regexp_replace(text, '[^\\x{{3040}}-\\x{{30FF}}\\x{{31F0}}-\\x{{31FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}\\x{{20000}}-\\x{{323AF}}]', '', 'g')) AS meaningful FROM {WORDS}")
def meaningful_count(spark, sf):
    return spark.sql(f"SELECT * FROM {WORDS}").select("id", readings.meaningful("text").alias("meaningful"))


@query("leaf_readings", ALL + f", {PARTS} SELECT page_id || ':' || component AS group_id, string_agg(text, '' ORDER BY rn) AS text, round(least(1.0, avg(confidence) + CASE WHEN count(*) > 1 THEN 0.03 ELSE 0 END), 6) AS quality FROM said GROUP BY page_id, component")
def leaf_readings(spark, sf):
    return readings.leaves(parts(spark, sf)).withColumn("quality", F.round("quality", 6))


@query("readings_once", ALL + f", {PARTS} SELECT page_id || ':' || component AS group_id, min(rn) AS ordinal FROM said GROUP BY page_id, component, source, text")
def readings_once(spark, sf):
    return readings.once(parts(spark, sf)).select("group_id", "ordinal")


@query("reading_agreement", ALL + f""", {PARTS}, best AS (SELECT page_id, component, arg_min(source, rn) AS source, arg_min(text, rn) AS text FROM said GROUP BY ALL)
SELECT b.page_id || ':' || b.component AS group_id, round(coalesce(max(CASE WHEN s.text[1] <> b.text[1] THEN 0 ELSE least(length(s.text), length(b.text)) / greatest(length(s.text), length(b.text))::DOUBLE END) FILTER (s.source <> b.source), 0), 6)::DOUBLE AS agreement
FROM best b JOIN said s ON s.page_id = b.page_id AND s.component = b.component GROUP BY b.page_id, b.component""")  # fmt: skip
def reading_agreement(spark, sf):
    return readings.first_agreement(parts(spark, sf), ("page_id", "group_id")).select("group_id", F.round("agreement", 6).alias("agreement"))


@query("fallback_reject", f"WITH {REGIONS} SELECT page_id, rn, CASE WHEN confidence < 0.74 THEN printf('fallback_low_quality:%.3f', confidence) WHEN rn % 4 < 2 THEN 'fallback_too_short:' || rn % 4 WHEN (x % 100) / 100.0 < 0.70 THEN printf('fallback_disagreement:%.3f', (x % 100) / 100.0) ELSE 'accepted' END AS reason FROM regions")
def fallback_reject(spark, sf):
    made = regions(spark, sf).withColumns({"q": F.col("confidence"), "j": F.expr("rn % 4"), "a": F.expr("(x % 100) / 100.0D")})
    return made.select("page_id", "rn", F.coalesce(readings.fallback_reason("q", "j", "a"), F.lit("accepted")).alias("reason"))


AGAIN = "again AS (SELECT *, confidence AS raw_quality, (x % 90) / 100.0::DOUBLE AS mask_quality, rn % 3 AS raw_length, rn % 4 AS mask_length, (y % 100) / 100.0::DOUBLE AS alike, w > 200 AS marked FROM groups, LATERAL (SELECT component AS rn))"


@query("read_again", ALL + f", {AGAIN} SELECT page_id, component, {', '.join(f'{e} AS {n}' for n, e in readings.AGAIN.items())} FROM again")
def read_again(spark, sf):
    made = pages.grouped(regions(spark, sf)).withColumns({"raw_quality": F.col("confidence"), "mask_quality": F.expr("(x % 90) / 100.0D"), "raw_length": F.expr("component % 3"), "mask_length": F.expr("component % 4"), "alike": F.expr("(y % 100) / 100.0D"), "marked": F.expr("w > 200")})
    return made.select("page_id", "component", *[F.expr(e).alias(n) for n, e in readings.AGAIN.items()])


@query("combine_readings")
def combine_readings(spark, sf):
    return readings.combined(parts(spark, sf), ("page_id", "group_id")).select("group_id", "text", F.round("quality", 6).alias("quality"), "source")


@query("visible_length", f"SELECT id, length(regexp_replace(text, '\\s', '', 'g')) AS visible, translate(text, '「」ー', '﹁﹂｜') AS upright FROM {WORDS}")
def visible_length(spark, sf):
    return spark.sql(f"SELECT * FROM {WORDS}").select("id", F.char_length(F.regexp_replace("text", r"\s", "")).cast("long").alias("visible"), F.translate("text", "「」ー", "﹁﹂｜").alias("upright"))


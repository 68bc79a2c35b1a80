"""Queries over model answers and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers
from .registry import query
from .text_queries import load

#: Forms of an answer by conversation: wrappers, lists, maps, prose, numbers, cut JSON, objects without ids, lines.
FORMS = 9


def said(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = load(spark, sf, "conversations").withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    return c.withColumn("no", F.row_number().over(w) - 1)


def shaped(spark, sf):
    listed = said(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("i"))
    js = lambda body: F.to_json(F.expr(f"transform(i, x -> {body})"))
    wrapper = F.concat(F.lit('{"translations": '), js("named_struct('id', format_string('T%04d', x.no), 'text', x.text)"), F.lit("}"))
    forms = [
        F.concat(F.lit("```json\n"), wrapper, F.lit("\n```")),
        F.concat(F.lit('{"note": "ok", "items": '), js("named_struct('index', x.no, 'translation', x.text)"), F.lit("}")),
        js("x.text"),
        F.to_json(F.expr("map_from_entries(transform(i, x -> struct(if(x.no % 2 = 0, concat('T', x.no), cast(x.no as string)), x.text)))")),
        F.concat(F.lit("Here you are:\n"), wrapper, F.lit("\nAnything else {open?")),
        F.expr("array_join(transform(i, x -> concat('- 【', x.no, '】： ', x.text)), '\\n')"),
        F.expr("left(concat('{\"translations\": ', to_json(transform(i, x -> named_struct('id', format_string('T%04d', x.no), 'text', x.text))), '}'), 40)"),
        js("named_struct('translated_text', if(x.no % 3 = 2, null, x.text))"),
        F.expr("array_join(transform(i, x -> concat(' ', x.text, ' ')), '\\n')"),
    ]
    body = forms[-1]
    for k, f in enumerate(forms[:-1]):
        body = F.when(F.col("conv_id") % FORMS == k, f).otherwise(body)
    return listed.select(F.col("conv_id").alias("request"), body.alias("response"), F.size("i").cast("long").alias("count"))


ITEMS = "items AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no, count(*) OVER (PARTITION BY conv_id) AS n, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations)"


@query("parse_response", f"""WITH {ITEMS} SELECT conv_id AS request, no, CASE conv_id % {FORMS} WHEN 6 THEN CASE WHEN n > 1 THEN '' ELSE left('{{"translations": [{{"id":"T0000","text":"' || text || '"}}]}}', 40) END WHEN 7 THEN CASE WHEN no % 3 = 2 THEN '' ELSE text END ELSE text END AS text FROM items""")
def parse_response(spark, sf):
    return answers.parsed(shaped(spark, sf))


@query("parse_response_cleaned")
def parse_response_cleaned(spark, sf):
    return answers.cleaned(shaped(spark, sf))


@query("translation_zip", f"WITH {ITEMS} SELECT conv_id, no, CASE WHEN no % 3 = 1 THEN '' ELSE text END AS text FROM items")
def translation_zip(spark, sf):
    c = said(spark, sf)
    return answers.zipped(c.select("conv_id", "no"), c.where("no % 3 <> 1"), "conv_id", "no", "text").select("conv_id", F.col("no").cast("long").alias("no"), "text")


@query("strip_prefix", f"WITH {ITEMS} SELECT conv_id, no, text FROM items WHERE regexp_matches(text, '^[A-Za-z]')")
def strip_prefix(spark, sf):
    c = said(spark, sf).where("text rlike '^[A-Za-z]'")
    labelled = F.expr("concat(element_at(array('', '> ', 'Translation: ', '[T0001] ', '(3)：', '【12】- ', '原文：x → ', '> 譯文: [7] '), cast(no % 8 + 1 as int)), text)")
    return c.select("conv_id", F.col("no").cast("long").alias("no"), answers.without_label(labelled).alias("text"))


@query("glossary_apply", "SELECT conv_id, turn, replace(replace(replace(text, 'the', 'le'), 'le', 'li'), 'a', 'ah') AS text FROM conversations")
def glossary_apply(spark, sf):
    c = load(spark, sf, "conversations")
    return c.select("conv_id", "turn", answers.apply_glossary("text", [("the", "le"), ("le", "li"), ("a", "ah")]).alias("text"))


@query("prompt_items", f"WITH {ITEMS} SELECT conv_id, json_array_length(j) AS items, json_extract_string(j, '$[0].id') AS first_id, json_extract_string(j, '$[0].source') AS first_source FROM (SELECT conv_id, to_json(list({{id: printf('T%04d', no), source: text}} ORDER BY no)) AS j FROM items GROUP BY conv_id)")
def prompt_items(spark, sf):
    j = answers.serialised(said(spark, sf), "conv_id", "no")
    return j.select("conv_id", F.json_array_length("items").cast("long").alias("items"), F.get_json_object("items", "$[0].id").alias("first_id"), F.get_json_object("items", "$[0].source").alias("first_source"))


GLOSSARY = [("the", "T1"), ("a", "T2"), ("zzzz", "T3")]


@query("prompt_glossary", f"WITH {ITEMS} SELECT conv_id, coalesce(string_agg(DISTINCT term || ' = ' || target, chr(10) ORDER BY term || ' = ' || target), '-') AS terms FROM items LEFT JOIN (VALUES ('the', 'T1'), ('a', 'T2'), ('zzzz', 'T3')) g(term, target) ON contains(text, term) GROUP BY conv_id")
def prompt_glossary(spark, sf):
    p = answers.prompts(said(spark, sf), spark.createDataFrame(GLOSSARY, "term string, target string"), "conv_id", "no")
    return p.select("conv_id", F.regexp_extract("prompt", r"(?s)Glossary:\n(.*?)\n\nItems:", 1).alias("terms"))


@query("prompt_context", f"""WITH {ITEMS} SELECT conv_id, no, string_agg(role, ',' ORDER BY place) AS roles, coalesce(string_agg(known, ',' ORDER BY place), '') AS known FROM (SELECT a.conv_id, a.no, b.no AS place, CASE WHEN a.no = b.no THEN 'target' ELSE 'context' END AS role, CASE WHEN a.no <> b.no AND b.no % 2 = 0 THEN 'k' || b.no END AS known
FROM items a JOIN items b ON a.conv_id = b.conv_id AND b.no BETWEEN a.no - 2 AND a.no + 2) GROUP BY conv_id, no""")  # fmt: skip
def prompt_context(spark, sf):
    c = said(spark, sf)
    known = c.where("no % 2 = 0").select("conv_id", "no", F.concat(F.lit("k"), F.col("no")).alias("target"))
    shown = answers.context_items(c, known, "conv_id", "no", 2)
    return shown.select("conv_id", F.col("no").cast("long").alias("no"), F.expr("array_join(transform(context, x -> x.role), ',')").alias("roles"), F.expr("array_join(transform(context, x -> x.known), ',')").alias("known"))

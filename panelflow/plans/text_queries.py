"""Queries over texts, candidates, conversations and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import texts
from .registry import query

PAIRS = """pairs AS (SELECT conv_id, turn, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS target,
  role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations)"""


def load(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pairs(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = load(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("source"), F.lead("text").over(w).alias("target"), "role", F.lead("role").over(w).alias("next_role")).where("role = 'user' and next_role = 'assistant'")


@query("script_counts", """SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
length(regexp_replace(text, '[^ぁ-ゖァ-ヺ]', '', 'g')) AS kana, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS cjk FROM documents""")  # fmt: skip
def script_counts(spark, sf):
    return load(spark, sf, "documents").select("doc_id", *[F.expr(f"cast({t.count('text', c)} as bigint)").alias(n) for n, c in (("latin", "A-Za-z"), ("digits", "0-9"), ("kana", t.KANA), ("cjk", t.CJK))])


@query("max_run", """SELECT item_id, max(n) AS longest FROM (SELECT item_id, c, grp, count(*) AS n FROM (SELECT item_id, i, substr(text, i, 1) AS c, i - row_number() OVER (PARTITION BY item_id, substr(text, i, 1) ORDER BY i) AS grp
FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark)) GROUP BY item_id, c, grp) GROUP BY item_id""")  # fmt: skip
def max_run(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", t.max_run("text").cast("long").alias("longest"))


@query("weak_normalize", """SELECT item_id, regexp_replace(text, '[\\p{P}\\p{Z}\\p{S}\\s]', '', 'g') AS weak FROM benchmark""")
def weak_normalize(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", t.weak(F.col("text")).alias("weak"))


SCORED = """s AS (SELECT item_id, regexp_replace(text, '\\s', '', 'g') AS v FROM benchmark),
c AS (SELECT item_id, v, length(v) AS n, length(regexp_replace(v, '[^A-Za-z]', '', 'g')) AS l, length(regexp_replace(v, '[^0-9]', '', 'g')) AS d, length(regexp_replace(v, '[^\\p{P}\\p{S}]', '', 'g')) AS p FROM s),
u AS (SELECT *, (l + d + p) / greatest(n, 1)::DOUBLE AS useful FROM c),
q AS (SELECT *, 0.18 + 0.18 * least(1.0, useful) + least(0.10, 0.025 * log2(n + 1)) AS base FROM u),
r AS (SELECT item_id, v, n, CASE WHEN n = 0 OR p = n THEN 0.0 ELSE greatest(0.0, least(1.0, (CASE WHEN l > 0 AND l / n::DOUBLE >= 0.6 THEN greatest(base, 0.38) ELSE base END) - CASE WHEN useful < 0.55 THEN 0.25 ELSE 0.0 END)) END AS quality FROM q)"""


def scored(spark, sf):
    v = load(spark, sf, "benchmark").select("item_id", F.expr("regexp_replace(text, '\\\\s', '')").alias("v"))
    return v.withColumn("_run", t.max_run("v")).withColumn("quality", t.quality("v"))


@query("text_quality", "WITH " + SCORED + " SELECT item_id, round(quality, 6) AS quality FROM r")
def text_quality(spark, sf):
    return scored(spark, sf).select("item_id", F.round("quality", 6).alias("quality"))


@query("text_accept", "WITH " + SCORED + " SELECT CASE WHEN v = '' THEN 'empty_ocr' WHEN quality < 0.46 THEN 'low_ocr_quality' ELSE 'accepted' END AS verdict, count(*) AS texts FROM r GROUP BY 1")
def text_accept(spark, sf):
    verdict = F.coalesce(F.split(t.reject_reason("v", "quality"), ":")[0], F.lit("accepted"))
    return scored(spark, sf).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("texts"))


@query("exact_dup_docs", "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_docs(spark, sf):
    return load(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("k")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("k")


CANDIDATES = "SELECT doc_id AS ordinal, lang AS group_id, source, lower(text) AS normalized, round(n_chars / 50000.0, 6) AS quality FROM documents"


@query("candidate_dedup", f"SELECT ordinal, group_id, source, normalized FROM (SELECT *, row_number() OVER (PARTITION BY group_id, normalized, source ORDER BY quality DESC, ordinal) AS r FROM ({CANDIDATES}) WHERE normalized <> '') WHERE r = 1")
def candidate_dedup(spark, sf):
    c = load(spark, sf, "documents").selectExpr("doc_id as ordinal", "lang as group_id", "source", "lower(text) as normalized", "round(n_chars / 50000.0D, 6) as quality")
    return texts.best_per_key(c).select("ordinal", "group_id", "source", "normalized")


@query("upper_median_length", "SELECT lang, list_sort(list(length(text)))[(count(*) // 2)::INT + 1] AS length FROM documents GROUP BY lang")
def upper_median_length(spark, sf):
    lengths = load(spark, sf, "documents").select("lang", F.char_length("text").cast("long").alias("length"))
    return texts.upper_median(lengths, "lang", "length")


@query("best_candidate")
def best_candidate(spark, sf):
    b = load(spark, sf, "benchmark")
    views = None
    for i, (source, text, q) in enumerate((("raw", "text", 0.80), ("mask", "text", 0.82), ("contrast", "text", 0.79))):
        v = b.selectExpr("item_id as group_id", f"{i} as ordinal", f"'{source}' as source", f"{text} as normalized", f"{q}D as quality")
        views = v if views is None else views.unionByName(v)
    return texts.best_candidate(views).select("group_id", "ordinal", F.round("score", 6).alias("score"))


@query("fuzzy_similarity")
def fuzzy_similarity(spark, sf):
    b = load(spark, sf, "benchmark").withColumn("weak", t.weak(F.col("text")))
    x, y = b.alias("x"), b.alias("y")
    return x.join(y, F.expr("x.item_id + 1 = y.item_id")).select("x.item_id", F.round(t.similarity("x.weak", "y.weak"), 6).alias("similarity"), F.round(t.coverage("x.weak", "y.weak"), 6).alias("coverage"), F.round(t.longest_common("x.weak", "y.weak"), 6).alias("longest"))


@query("context_window", """SELECT conv_id, turn, array_to_string(list(turn::VARCHAR) OVER w, ',') AS near, sum(length(text)) OVER w::BIGINT AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def context_window(spark, sf):
    return texts.context(load(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.expr("array_join(transform(window, w -> cast(w.at as string)), ',')").alias("near"), F.expr("aggregate(window, 0L, (a, w) -> a + char_length(w.text))").alias("chars"))


@query("batch_buckets", "SELECT conv_id, turn, (row_number() OVER p - 1) // 3 AS batch, printf('T%04d', row_number() OVER p - 1) AS item_id FROM conversations WHERE trim(text) <> '' WINDOW p AS (PARTITION BY conv_id ORDER BY turn)")
def batch_buckets(spark, sf):
    return texts.batches(load(spark, sf, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "batch", "item_id")


@query("route_mode", "SELECT conv_id, sum(length(text))::BIGINT AS chars, count(*) AS items, CASE WHEN sum(length(text)) > 1000 OR count(*) > 6 THEN 'batch' ELSE 'page' END AS mode FROM conversations GROUP BY conv_id")
def route_mode(spark, sf):
    return texts.route(load(spark, sf, "conversations"), "conv_id", 1000, 6)


WORDS = "SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM benchmark"


@query("glossary_terms", f"SELECT term, upper(term) AS target FROM ({WORDS}) g WHERE length(term) >= 3 AND EXISTS (SELECT 1 FROM conversations c WHERE contains(c.text, g.term))")
def glossary_terms(spark, sf):
    words = load(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where("length(term) >= 3").distinct()
    return texts.glossary_terms(load(spark, sf, "conversations"), words.withColumn("target", F.upper("term")))


def responses(spark, sf):
    items = load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("request")).agg(F.array_sort(F.collect_list(F.struct("turn", F.format_string("T%04d", F.col("turn")).alias("id"), "text"))).alias("i"))
    return items.select("request", F.concat(F.lit('```json\n{"translations": '), F.to_json(F.expr("transform(i, x -> struct(x.id as id, x.text as text))")), F.lit("}\n```")).alias("response"))


@query("parse_response_json", "SELECT conv_id AS request, printf('T%04d', turn) AS item_id, text FROM conversations")
def parse_response_json(spark, sf):
    return texts.parse_json(responses(spark, sf))


@query("strip_fences", "SELECT conv_id AS request, length(printf('%s', string_agg(text, '' ORDER BY turn))) AS chars FROM conversations GROUP BY conv_id")
def strip_fences(spark, sf):
    joined = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("i"))
    fenced = joined.select(F.col("conv_id").alias("request"), F.expr("concat('```json\\n', array_join(transform(i, x -> x.text), ''), '\\n```')").alias("response"))
    return fenced.select("request", F.char_length(texts.strip_fences("response")).cast("long").alias("chars"))


@query("parse_numbered", "SELECT conv_id AS request, turn AS no, trim(replace(text, chr(10), ' ')) AS text FROM conversations WHERE trim(text) <> ''")
def parse_numbered(spark, sf):
    c = load(spark, sf, "conversations").where("trim(text) <> ''").withColumn("text", F.regexp_replace("text", "\n", " "))
    lines = c.groupBy(F.col("conv_id").alias("request")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("i")).select("request", F.expr("array_join(transform(i, x -> concat('[', x.turn, ']: ', x.text)), '\\n')").alias("response"))
    return texts.parse_numbered(lines)


@query("validate_pair", f"""WITH {PAIRS}, v AS (SELECT *, length(regexp_replace(target, '\\s', '', 'g')) AS n, length(regexp_replace(target, '[^\\p{{P}}\\p{{S}}]', '', 'g')) AS p, regexp_matches(target, '[\\p{{L}}\\p{{N}}]') AS has_some FROM pairs WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, turn, CASE WHEN trim(target) = '' THEN 'empty' ELSE concat_ws(',', CASE WHEN contains(target, '�') OR contains(target, 'Ã') OR contains(target, 'â€') OR contains(target, 'ðŸ') THEN 'mojibake' END,
CASE WHEN n > greatest(24, trunc(greatest(1, length(regexp_replace(source, '\\s', '', 'g'))) * 4.0 + 12)) THEN 'too_long' END, CASE WHEN NOT has_some THEN 'punctuation_only' END, CASE WHEN has_some AND n >= 4 AND p > 0.65 * n THEN 'excessive_punctuation' END) END AS issues FROM v""")  # fmt: skip
def validate_pair(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.array_join(t.issues("source", "target"), ",").alias("issues"))


@query("sanitize_text")
def sanitize_text(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", t.sanitize_translation("target", "source").alias("clean"))


@query("repeat_detect")
def repeat_detect(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.col("text").rlike("(.{12,60})\\1").alias("repeats"))


@query("translation_duplicates")
def translation_duplicates(spark, sf):
    from ..operators import merging

    c = load(spark, sf, "conversations")
    # turns of a conversation stand as boxes of a page, each half over the next
    boxes = c.select(F.col("conv_id").alias("page_id"), F.col("turn").cast("long").alias("ordinal"), F.lit(10).cast("long").alias("x"), (F.col("turn") * 10).cast("long").alias("y"), F.lit(100).cast("long").alias("w"), F.lit(100).cast("long").alias("h"), F.col("role").alias("source"), F.col("text").alias("target"), F.lit(0.9).alias("confidence"))
    return merging.translation_duplicates(boxes)

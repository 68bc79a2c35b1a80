"""Page files, glossary, model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes of page images, and statuses after which a request is tried again.
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")
RETRY_STATUS = (408, 425, 429, 500, 502, 503, 504)
ATTEMPTS, BASE_DELAY, MOST_DELAY = 5, 2.0, 30.0


def natural_key(name: str) -> Column:
    """Sort key under which digit runs compare as numbers and letters without case."""
    return F.expr(f"array_join(transform(regexp_extract_all(lower({name}), '[0-9]+|[^0-9]+', 0), p -> if(p rlike '^[0-9]', lpad(regexp_replace(p, '^0+(?=.)', ''), 20, '0'), p)), '')")


def numbered(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows with their place in the order of ``key``: ranges are counted, and each is numbered from where it begins."""
    # a stated number of ranges is never merged, so both uses of the one exchange see the same ranges
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_k", key).repartitionByRange(ranges, "_k").withColumn("_range", F.spark_partition_id())
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_k"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + own).cast("long")).drop("_k", "_range", "_start")


def is_page(name: str) -> Column:
    return F.lower(F.element_at(F.split(F.col(name), r"\."), -1)).isin(*SUFFIXES) & F.col(name).contains(".")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Page images of a folder's top level: path, name, size, bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(is_page("name"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """``term, target`` of a JSON file with the entries at the top or under ``entries``."""
    raw = spark.read.text(path, wholetext=True)
    flat = raw.select(F.coalesce(F.from_json(F.get_json_object("value", "$.entries"), "map<string,string>"), F.from_json("value", "map<string,string>")).alias("m"))
    return flat.select(F.explode("m").alias("term", "target")).select(F.trim("term").alias("term"), F.trim("target").alias("target")).where("term <> '' and target <> ''")


def answer_text(body: str) -> Column:
    """Content of a chat answer: a string, or the text blocks joined; null where there is none."""
    content = f"get_json_object({body}, '$.choices[0].message.content')"
    blocks = f"array_join(transform(from_json({content}, 'array<struct<type:string,text:string>>'), b -> b.text), '')"
    return F.expr(f"if({content} like '[%', nullif({blocks}, ''), {content})")


def answer_error(body: str) -> Column:
    return F.expr(f"coalesce(get_json_object({body}, '$.error.message'), get_json_object({body}, '$.error'))")


def retry_delay(status: str, attempt: str, after: str) -> Column:
    """Seconds to wait before the next attempt, without jitter; null if there is none."""
    again = f"{status} in ({', '.join(map(str, RETRY_STATUS))}) and {attempt} < {ATTEMPTS}"
    return F.expr(f"if({again}, coalesce({after}, least({MOST_DELAY}D, {BASE_DELAY}D * pow(2, {attempt} - 1))), null)")


def request(model: str, prompt: str, temperature: float, most: int) -> Column:
    return F.expr(f"to_json(named_struct('model', '{model}', 'messages', array(named_struct('role', 'user', 'content', {prompt})), 'temperature', {temperature}D, 'max_tokens', {most}))")

"""Mixing sources to target weights by hierarchical budgets (operator 2, DataFrame operations only).

Every document is a leaf's: one leaf for each domain, language and source. The token budget runs
from the root down. A node's children get shares in proportion to their weights, but never more
than their subtree can give (its tokens times ``max_epochs``); what a child cannot use goes to its
siblings first, and only what all siblings together cannot use was never given to their parent, so
that it went to the parent's siblings. Leftover units of whole-number division go to the open
children in name order.

A leaf is read in seeded epochs: whole passes first, then the prefix of one more pass, in the order
of an MD5 of seed, epoch and id, up to the last document that still fits its budget. Running
totals are taken in two levels, hash slots and rows within a slot, so that a source with a third
of all rows is spread over ``SLOTS`` windows.

Defined cases: null or empty texts have no tokens and fit wherever they stand in the order; null
domains, languages and sources form a leaf of their own named ``?``; repeated rows count each;
rows with a null id are ordered by their empty id, rows that repeat an id by their tokens; weights below 1 exclude a node; an empty table
gives no rows; columns of other names pass through untouched in ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored

LEVELS = ("domain", "lang", "source")
#: Target weights of the registered query, relative among siblings; others weigh 1.
WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 2, "news": 1}, "lang": {"en": 3}, "source": {"src0": 2}}
DOMAINS = ("web", "books", "code", "news")
SEED, MAX_EPOCHS, SHARE, SLOTS_HEX = 17, 2, (6, 10), 3
_BIG = "decimal(38,0)"


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number that ends its name."""
    n = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(n.isNull() | (n == ""), F.lit("?")).otherwise(F.element_at(F.array(*map(F.lit, DOMAINS)), (F.pmod(n.cast("decimal(38,0)"), F.lit(len(DOMAINS))) + 1).cast("int")))


def tokens_of(text: Column) -> Column:
    """Pieces between single spaces; none in a null or empty text."""
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def leaves_of(docs: DataFrame, *more: Column) -> DataFrame:
    """``domain, lang, source, doc_id, tokens`` of each row, and what else is asked for."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    return docs.select(
        domain_of(source).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("lang"), F.coalesce(source, F.lit("?")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), tokens_of(text).alias("tokens"), *more
    )


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Shares ``budget`` of each parent among its children by ``w``, within their ``cap``: ``alloc``.

    Children are taken by capacity over weight; a child is full if its fair share of what the ones
    before it left is at least its capacity, and full ones come first.
    """
    by = [F.col(p) for p in parent] or [F.lit(0)]
    whole = Window.partitionBy(*by)
    order = Window.partitionBy(*by).orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    big = lambda c: F.col(c).cast(_BIG)
    step = (
        children.withColumn("_used", F.coalesce(F.sum(big("cap")).over(before), F.lit(0)).cast(_BIG))
        .withColumn("_left", (F.sum(big("w")).over(whole) - F.coalesce(F.sum(big("w")).over(before), F.lit(0))).cast("decimal(18,0)"))
        .withColumn("_full", F.col("cap").cast("decimal(19,0)") * F.col("_left") <= F.col("w").cast("decimal(18,0)") * (big("budget") - F.col("_used")).cast("decimal(19,0)"))
        .withColumn("_rest", (big("budget") - F.coalesce(F.sum(F.when(F.col("_full"), big("cap"))).over(whole), F.lit(0))).cast("decimal(19,0)"))
        .withColumn("_open", F.sum(F.when(~F.col("_full"), big("w"))).over(whole).cast("decimal(18,0)"))
        .withColumn("_floor", F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("(cast(w as decimal(18,0)) * _rest) div _open")))
        .withColumn("_spare", F.col("_rest") - F.coalesce(F.sum(F.when(~F.col("_full"), big("_floor"))).over(whole), F.lit(0)))
        .withColumn("_turn", F.row_number().over(Window.partitionBy(*by, F.col("_full")).orderBy(name)))
    )
    alloc = F.col("_floor") + F.when(~F.col("_full") & (F.col("_turn") <= F.col("_spare")), F.lit(1)).otherwise(F.lit(0))
    return step.withColumn("alloc", alloc.cast("long")).drop("_used", "_left", "_full", "_rest", "_open", "_floor", "_spare", "_turn")


def budgets(leaves: DataFrame, weights: dict | None = None, budget: int | None = None, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``domain, lang, source, leaf_tokens, alloc`` of each leaf.

    ``budget``: tokens in all; without it, ``share`` (a fraction) of the tokens there are.
    """
    weights = WEIGHTS if weights is None else weights
    sums = leaves.groupBy(*LEVELS).agg(F.sum("tokens").alias("leaf_tokens"))
    live = F.lit(True)
    for level in LEVELS:
        live = live & (_weight(level, weights) > 0)
    sums = sums.withColumn("cap", F.when(live, F.col("leaf_tokens") * max_epochs).otherwise(F.lit(0)).cast("long"))
    total = F.lit(budget).cast("long") if budget is not None else F.expr(f"cast((sum(cast(leaf_tokens as decimal(38,0))) over (partition by 0)) * {share[0]} div {share[1]} as bigint)")
    level_rows = sums.withColumn("budget", total)
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        nodes = level_rows.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.first("budget").alias("budget"))
        shared = fill(nodes.withColumn("w", F.greatest(_weight(level, weights), F.lit(1))), keys[:-1], level)
        level_rows = level_rows.drop("budget").join(shared.select(*keys, F.col("alloc").alias("budget")), keys)
    return level_rows.select(*LEVELS, "leaf_tokens", F.col("budget").alias("alloc"))


def _placed(leaves: DataFrame, plan: DataFrame, max_epochs: int, seed: int) -> DataFrame:
    """The rows of ``leaves`` chosen at least once, with ``copies``; their other columns stay."""
    spread = leaves.join(plan, list(LEVELS))
    passes = F.when(F.col("leaf_tokens") > 0, F.expr("least(alloc div leaf_tokens, %d)" % max_epochs)).otherwise(F.lit(max_epochs))
    spread = spread.withColumn("passes", passes.cast("long")).withColumn("rest", F.col("alloc") - F.col("passes") * F.col("leaf_tokens"))
    spread = spread.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("passes").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    spread = spread.withColumn("slot", F.substring("key", 1, SLOTS_HEX))
    sums = spread.groupBy(*LEVELS, "slot").agg(F.sum("tokens").alias("in_slot"))
    starts = sums.withColumn("start", F.coalesce(F.sum("in_slot").over(Window.partitionBy(*LEVELS).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("in_slot")
    within = Window.partitionBy(*LEVELS, "slot").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = spread.withColumn("upto", F.sum("tokens").over(within)).join(starts, [*LEVELS, "slot"])
    more = ((F.col("passes") < max_epochs) & (F.col("start") + F.col("upto") <= F.col("rest"))).cast("long")
    return placed.withColumn("copies", F.col("passes") + more).where("copies > 0")


def select(docs: DataFrame, weights: dict | None = None, budget: int | None = None, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, domain, lang, source, tokens, copies`` of the rows chosen at least once."""
    leaves = Stored(leaves_of(docs), "leaves").df
    plan = Stored(budgets(leaves, weights, budget, share, max_epochs), "budgets").small()
    return _placed(leaves, plan, max_epochs, seed).select("doc_id", *LEVELS, "tokens", "copies")


def mixed(docs: DataFrame, weights: dict | None = None, budget: int | None = None, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that were chosen, each as often as its epochs read it, all columns kept.

    Rows travel whole to their leaf's slots, once, so every row is placed for itself, whatever ids repeat.
    """
    plan = Stored(budgets(leaves_of(docs), weights, budget, share, max_epochs), "budgets").small()
    rows = leaves_of(docs, F.struct("*").alias("_row"))
    chosen = _placed(rows, plan, max_epochs, seed).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return chosen.select("_row.*")


def _sql_level(i: int, weights: dict) -> str:
    level, keys = LEVELS[i], ", ".join(LEVELS[: i + 1])
    parent = ", ".join(LEVELS[:i]) or "0"
    w = "CASE " + " ".join(f"WHEN {level} = '{n}' THEN {max(1, v)}" for n, v in weights.get(level, {}).items()) + " ELSE 1 END" if weights.get(level) else "1"
    return f"""
n{i} AS (SELECT {keys}, sum(cap)::HUGEINT AS cap, any_value(budget)::HUGEINT AS budget, ({w})::HUGEINT AS w FROM b{i} GROUP BY {keys}),
o{i} AS (SELECT *, coalesce(sum(cap) OVER q, 0)::HUGEINT AS used, (sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER q, 0))::HUGEINT AS rem
  FROM n{i} WINDOW q AS (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{i} AS (SELECT *, cap * rem <= w * (budget - used) AS is_full FROM o{i}),
g{i} AS (SELECT *, (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (PARTITION BY {parent}), 0))::HUGEINT AS rest,
  (sum(CASE WHEN NOT is_full THEN w END) OVER (PARTITION BY {parent}))::HUGEINT AS open_w FROM f{i}),
h{i} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (w * rest) // open_w END AS flo FROM g{i}),
k{i} AS (SELECT *, rest - coalesce(sum(CASE WHEN NOT is_full THEN flo END) OVER (PARTITION BY {parent}), 0) AS spare,
  row_number() OVER (PARTITION BY {parent}, is_full ORDER BY {level}) AS turn FROM h{i}),
b{i + 1} AS (SELECT b.* EXCLUDE (budget), k.flo + CASE WHEN NOT k.is_full AND k.turn <= k.spare THEN 1 ELSE 0 END AS budget
  FROM b{i} b JOIN k{i} k USING ({keys})),"""


def oracle(share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """The registered query as DuckDB SQL."""
    names = ", ".join(f"'{d}'" for d in DOMAINS)
    return f"""
WITH leaves AS (SELECT CASE WHEN source IS NULL OR regexp_extract(source, '([0-9]+)$', 1) = '' THEN '?'
    ELSE ([{names}])[(regexp_extract(source, '([0-9]+)$', 1)::HUGEINT % {len(DOMAINS)})::INT + 1] END AS domain,
  coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, doc_id,
  CASE WHEN text IS NULL OR text = '' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END::BIGINT AS tokens FROM documents),
sums AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS leaf_tokens, (sum(tokens) * {max_epochs})::HUGEINT AS cap FROM leaves GROUP BY ALL),
b0 AS (SELECT *, (sum(leaf_tokens) OVER () * {share[0]})::HUGEINT // {share[1]} AS budget FROM sums),
{"".join(_sql_level(i, WEIGHTS) for i in range(3))}
p AS (SELECT l.*, leaf_tokens, budget AS alloc, CASE WHEN leaf_tokens > 0 THEN least(budget // leaf_tokens, {max_epochs}) ELSE {max_epochs} END::BIGINT AS passes
  FROM leaves l JOIN b3 USING (domain, lang, source)),
r AS (SELECT *, alloc - passes * leaf_tokens AS rest, md5('{seed}:' || passes || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM p),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, domain, lang, source, tokens, (passes + CASE WHEN passes < {max_epochs} AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c WHERE passes + CASE WHEN passes < {max_epochs} AND upto <= rest THEN 1 ELSE 0 END > 0"""

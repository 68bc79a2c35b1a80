"""Exact top-k inner products by no-random-access aggregation (operator 7).

Candidates are dealt to shards. A shard keeps, for every dimension, a list of its candidates sorted
by that component, and reads all lists in step, each from the end that a query's weight favours.
What was read gives every candidate a lower bound (the worst value of each list it was not seen in)
and an upper one (the value at which that list's reading stands). The k-th best lower bound is the
bar: candidates whose upper bound is below it are out. A query ends when no more than k are left, or
when its lists are read to the end; only then are the scores of those that are left resolved. No
vector is looked up before. A block of queries shares the reading: the bounds of all its queries and
candidates at one depth are two products of matrices. The shards' winners meet in one ranking per query.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; vectors are compared with those of the same length only; rows with the query's
id are its own and not candidates; repeated rows count each; equal scores rank by smaller id;
components of any finite size are exact, and a score outside the range of a long counts as the
nearest long; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, QUERY_ROWS = 4096, 2048
#: Shares of the lists, in quarters, at which the reading stops to compare bounds; queries whose bounds are held at once.
STOPS, TILE = (1, 2, 3, 4), 256
#: Sums of products below this are whole in double precision.
WHOLE = 2.0**53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``: doubles while they hold it and its products, else Python integers."""
    top = float(np.abs(x).max(initial=0.0)) * scale + 1
    if 4 * top * top * max(1, x.shape[1]) < WHOLE:
        return np.floor(x * scale)
    numerator = np.frompyfunc(lambda v: (lambda n, d: n * scale // d)(*float(v).as_integer_ratio()), 1, 1)
    return numerator(x)


class Lists:
    """The sorted lists of a shard, ready to be read to any depth."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        up = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, up, axis=0)
        self.rank = np.empty(up.shape, np.int64)  # place in the list read from below
        np.put_along_axis(self.rank, up, np.arange(len(ids))[:, None], axis=0)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What ``depth`` entries of each list tell: values by which lower bounds are summed, and
        what upper bounds add to them; first for positive weights, then for negative ones."""
        n = len(self.ids)
        seen = np.concatenate([self.rank >= n - depth, self.rank < depth], axis=1)
        value = np.concatenate([self.vectors, self.vectors], axis=1)
        worst = np.concatenate([self.sorted[0], self.sorted[-1]])
        stand = np.concatenate([self.sorted[n - depth], self.sorted[depth - 1]])
        return np.where(seen, value, worst), np.where(seen, 0, stand - worst)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query its k best ``(id, score)`` without rows of its own id; ties to smaller ids."""
        n = len(self.ids)
        split = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
        first, last = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        found: list[list[tuple[int, int]]] = [[] for _ in own]
        todo = np.arange(len(own))
        for stop in STOPS:
            depth = -(-n * stop // STOPS[-1])
            values, slack = self.read(depth)
            open_ = []
            for at in range(0, len(todo), TILE):
                tile = todo[at : at + TILE]
                lower = split[tile] @ values.T
                upper = lower + split[tile] @ slack.T if depth < n else lower.copy()
                least = lower.min() - 1 if lower.size else 0
                for i, q in enumerate(tile.tolist()):
                    lower[i, first[q] : last[q]] = least  # its own rows set no bar
                bar = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(tile), least)
                inside = upper >= bar[:, None]
                for i, q in enumerate(tile.tolist()):
                    inside[i, first[q] : last[q]] = False
                for i, (q, left) in enumerate(zip(tile.tolist(), inside.sum(axis=1).tolist(), strict=True)):
                    if left > k and depth < n:
                        open_.append(q)
                        continue
                    at_end = np.flatnonzero(inside[i])
                    scores = [min(MOST, max(LEAST, int(s))) for s in self.vectors[at_end] @ queries[q]]
                    found[q] = sorted(zip(self.ids[at_end].tolist(), scores, strict=True), key=lambda r: (-r[1], r[0]))[:k]
            todo = np.array(open_, np.int64)
            if not len(todo):
                break
        return found


def taking_part(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, x array<double>)`` of the rows that take part."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return embeddings.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``; queries are the rows whose id ``every`` divides."""
    rows = taking_part(embeddings)
    n = rows.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // (every * query_rows)))
    rows = rows.withColumn("dims", F.size("x")).withColumn("one", F.xxhash64("vec_id", "x"))
    candidates = rows.select("dims", F.expr(f"int(pmod(one, {shards}))").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "x")
    queries = rows.where(F.col("vec_id") % every == 0).select(
        "dims", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.expr(f"int(pmod(xxhash64(vec_id, 1), {blocks}))").alias("block"), "vec_id", "x", F.col("one").alias("query")
    )

    def matrix(t: pa.Table) -> np.ndarray:
        x = t["x"].combine_chunks()
        return (x.values if isinstance(x, pa.ListArray) else x.chunk(0).values).to_numpy().reshape(t.num_rows, -1)

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            both = whole_numbers(np.concatenate([matrix(left), matrix(right)]), scale)
            lists = Lists(left["vec_id"].to_numpy(), both[: left.num_rows])
            own = right["vec_id"].to_numpy()
            for a, key, best in zip(own.tolist(), right["query"].to_pylist(), lists.top(both[left.num_rows :], own, k), strict=True):
                out += [(a, key, i, s) for i, s in best]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "query", "vec_id", "score"), cols, strict=True)})

    keys = ["dims", "shard", "block"]
    found = candidates.groupBy(*keys).cogroup(queries.distinct().groupBy(*keys)).applyInArrow(find, "query_id long, query long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, every: int = 50, scale: int = 256) -> str:
    """The registered query as DuckDB SQL."""
    return f"""
WITH rows_in AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1]::HUGEINT * z[2]))::BIGINT AS score
  FROM rows_in a JOIN rows_in b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {k}"""

"""Layout of translations: font bounds, runs, clusters, chunks, plan search, conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import _pieces, within

MIN_FONT, MAX_FONT = 10, 180


def font_bounds(p: str) -> tuple[Column, Column]:
    """Smallest and largest allowed size for an estimated one."""
    high = f"cast(least({MAX_FONT}, greatest({MIN_FONT}, ceil(1.15D * {p}))) as bigint)"
    return F.expr(f"cast(least({high}, greatest({MIN_FONT}, floor(0.85D * {p}))) as bigint)"), F.expr(high)


def chunks(text: str, n: str) -> Column:
    """A text in ``n`` parts whose lengths differ by one at most, longer ones first."""
    return F.expr(
        f"transform(sequence(0, {n} - 1), i -> substr({text}, i * cast(char_length({text}) div {n} as int) + least(i, char_length({text}) % {n}) + 1, cast(char_length({text}) div {n} as int) + if(i < char_length({text}) % {n}, 1, 0)))"
    )


def runs(flags: DataFrame, by: str, at: str, flag: str) -> DataFrame:
    """Gaps and islands: first, last and length of each run of set flags."""
    w = Window.partitionBy(by).orderBy(at)
    return flags.where(flag).withColumn("_island", F.col(at) - F.row_number().over(w)).groupBy(by, "_island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length")).drop("_island")


def centre_clusters(points: DataFrame, by: str, value: str, reach: str) -> DataFrame:
    """One-dimensional clusters: a value joins while it lies within ``reach`` of the cluster's running mean."""
    fold = f"""aggregate(array_sort(collect_list(cast({value} as double))), cast(array() as array<struct<s:double,n:bigint>>), (acc, v) ->
      if(size(acc) > 0 and v - element_at(acc, -1).s / element_at(acc, -1).n <= {reach},
         concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s + v, 'n', element_at(acc, -1).n + 1L))),
         concat(acc, array(named_struct('s', v, 'n', 1L)))))"""
    return points.groupBy(by).agg(F.expr(fold).alias("c")).select(by, F.posexplode("c").alias("cluster", "c")).select(by, F.col("cluster").cast("long"), (F.col("c.s") / F.col("c.n")).alias("centre"), F.col("c.n").alias("points"))


def vertical_plans(groups: DataFrame) -> DataFrame:
    """Every size and column count that fits ``w, h`` with ``n`` characters at size estimate ``p``, with its cost."""
    low, high = font_bounds("p")
    sized = groups.withColumns({"low": low, "high": high}).withColumn("size", F.explode(F.sequence("low", "high")))
    # one more than fits by the quotient, as rounding may be off; the test on bw decides
    widest = "greatest(1L, least(n, cast(floor(w / (size * 1.08D)) as bigint) + 1L))"
    grid = sized.withColumn("columns", F.explode(F.expr(f"sequence(1L, {widest})")))
    grid = grid.withColumn("rows", F.expr("cast(ceil(n / cast(columns as double)) as bigint)"))
    plan = grid.withColumns({"bw": F.expr("columns * size * 1.08D"), "bh": F.expr("rows * size * 1.0D")}).where("bw <= w and bh <= h")
    return plan.withColumn("cost", F.expr("4.4D * abs(ln(size / p)) + 1.15D * abs(ln(bw / w)) + 1.45D * abs(ln(bh / h)) + 0.32D * abs(columns - expected)"))


def horizontal_plans(groups: DataFrame, advance: float = 1.0, tracking: float = 1.0) -> DataFrame:
    """Every size whose greedily wrapped lines fit ``w, h`` with ``n`` characters of equal ``advance``."""
    low, high = font_bounds("p")
    sized = groups.withColumns({"low": low, "high": high}).withColumn("size", F.explode(F.sequence("low", "high")))
    # a line holds at least one character, however narrow the box
    wrapped = sized.withColumn("per_line", F.expr(f"greatest(1L, cast(floor(w / (size * {advance}D * {tracking}D)) as bigint))"))
    lined = wrapped.withColumn("lines", F.expr("cast(ceil(n / cast(per_line as double)) as bigint)"))
    plan = lined.withColumns({"bw": F.expr(f"least(n, per_line) * size * {advance}D * {tracking}D"), "bh": F.expr("lines * size * 1.18D")}).where("bw <= w and bh <= h")
    return plan.withColumn("cost", F.expr(f"4.8D * abs(ln(size / p)) + 1.55D * abs(ln(bw / w)) + 1.75D * abs(ln(bh / h)) + 0.08D * abs(ln({tracking}D))"))


def choose(plans: DataFrame, key: list[str], last: str = "columns") -> DataFrame:
    """The cheapest plan, among those near the estimate if there are any; larger size on ties."""
    near = F.col("size") >= F.greatest(F.lit(float(MIN_FONT)), 0.92 * F.col("p"))
    w = Window.partitionBy(*key).orderBy(~near, F.round("cost", 9), F.round(F.abs(F.log(F.col("size") / F.col("p"))), 9), F.desc("size"), last)
    return plans.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def vertical_choice(groups: DataFrame, key: list[str]) -> DataFrame:
    """``key, size, columns`` of the plan that ``choose`` takes of ``vertical_plans``; groups that nothing fits stay out.

    A group's plans are numbers of its own batch, so neither an exchange nor a sort holds them. Numpy leaves out
    what costs more than the least by over 1e-8; of the few that remain the expressions choose.
    """
    low, high = font_bounds("p")
    kinds = dict(groups.dtypes)
    given = ["w", "h", "p", "expected"]
    known = groups.where("w > 0 AND h > 0 AND p > 0 AND n > 0 AND expected IS NOT NULL").select(*key, *[F.col(c).cast("double").alias(f"_{c}") for c in given], F.col("n").cast("long").alias("_n"), low.alias("_low"), high.alias("_high"))
    passed = [*key, *[f"_{c}" for c in given], "_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, p, expected, n, low, high = (batch.column(c).to_numpy() for c in ("_w", "_h", "_p", "_expected", "_n", "_low", "_high"))

            def widest(size: np.ndarray, row: np.ndarray) -> np.ndarray:
                return np.maximum(1, np.minimum(n[row], np.floor(w[row] / (size * 1.08)).astype(np.int64) + 1))

            many = high - low + 1
            # a plan takes the place of some cells
            for lo, hi in _pieces(np.cumsum(8 * many * widest(low, np.arange(len(low))))):
                row = np.repeat(np.arange(lo, hi), many[lo:hi])
                size = low[row] + within(many[lo:hi])
                most = widest(size, row)
                columns = within(most) + 1
                row, size = np.repeat(row, most), np.repeat(size, most)
                bw, bh = columns * size * 1.08, np.ceil(n[row] / columns) * size
                fit = (bw <= w[row]) & (bh <= h[row])
                row, size, columns, bw, bh = (c[fit] for c in (row, size, columns, bw, bh))
                far = size < np.maximum(float(MIN_FONT), 0.92 * p[row])
                cost = 4.4 * abs(np.log(size / p[row])) + 1.15 * abs(np.log(bw / w[row])) + 1.45 * abs(np.log(bh / h[row])) + 0.32 * abs(columns - expected[row])
                found = np.bincount(row - lo, minlength=hi - lo)
                first = (np.cumsum(found) - found)[found > 0]
                if len(first):
                    all_far = np.repeat(np.logical_and.reduceat(far, first), found[found > 0])
                    cost = np.where(far == all_far, cost, np.inf)
                    kept = cost <= np.repeat(np.minimum.reduceat(cost, first), found[found > 0]) + 1e-8
                    row, size, columns = row[kept], size[kept], columns[kept]
                ends = np.append(0, np.cumsum(np.bincount(row - lo, minlength=hi - lo)))
                plans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(size), pa.array(columns)], ["size", "columns"]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in passed), plans], [*passed, "_plans"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in key], *[f"_{c} double" for c in given], "_n long", "_plans array<struct<size:bigint,columns:bigint>>"])
    bw, bh = "(q.columns * q.size * 1.08D)", "(cast(ceil(_n / cast(q.columns as double)) as bigint) * q.size * 1.0D)"
    cost = f"4.4D * abs(ln(q.size / _p)) + 1.15D * abs(ln({bw} / _w)) + 1.45D * abs(ln({bh} / _h)) + 0.32D * abs(q.columns - _expected)"
    ranked = f"transform(_plans, q -> struct(round({cost}, 9) as cost, round(abs(ln(q.size / _p)), 9) as off, -q.size as back, q.columns as columns, q.size as size))"
    # of a single plan nothing is asked
    best = F.expr(f"if(size(_plans) < 2, _plans, transform(slice(array_sort({ranked}), 1, 1), q -> struct(q.size as size, q.columns as columns)))")
    return known.mapInArrow(run, schema).withColumn("_best", F.explode(best)).select(*key, "_best.size", "_best.columns")


def block_box(x: str, y: str, cx: str, cy: str, bw: str, bh: str) -> dict[str, Column]:
    """Whole-number box of a planned block."""
    left, top = f"floor({x} + {cx} - {bw} / 2.0D)", f"floor({y} + {cy} - {bh} / 2.0D)"
    return {"bx": F.expr(left), "by": F.expr(top), "bw2": F.expr(f"ceil({x} + {cx} + {bw} / 2.0D) - {left}"), "bh2": F.expr(f"ceil({y} + {cy} + {bh} / 2.0D) - {top}")}


def block_conflict(a: str, b: str, font: str) -> str:
    """Whether two planned blocks overlap too much for their smaller font."""
    ox = f"(least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x))"
    oy = f"(least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y))"
    return f"({ox} >= greatest(2, 0.24 * {font}) AND {oy} >= greatest(2, 0.24 * {font}) AND {ox} * {oy} >= 0.06 * least({a}w * {a}h, {b}w * {b}h))"

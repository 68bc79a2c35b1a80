"""Queries over layout, masks and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, masks, metrics, pages, raster
from .page_queries import REGIONS, regions
from .registry import query


@query("font_bounds", f"WITH {REGIONS}, e AS (SELECT *, least(w, h) / 3.0::DOUBLE AS p FROM regions), f AS (SELECT *, least(180, greatest(10, ceil(1.15 * p)))::BIGINT AS high FROM e) SELECT page_id, rn, least(high, greatest(10, floor(0.85 * p)))::BIGINT AS low, high FROM f")
def font_bounds(spark, sf):
    low, high = layout.font_bounds("p")
    return regions(spark, sf).withColumn("p", F.expr("least(w, h) / 3.0D")).select("page_id", "rn", low.alias("low"), high.alias("high"))


@query("balanced_chunks", """SELECT item_id, i AS part, substr(text, (i * (length(text) // 5) + least(i, length(text) % 5) + 1)::BIGINT, (length(text) // 5 + CASE WHEN i < length(text) % 5 THEN 1 ELSE 0 END)::BIGINT) AS chunk FROM benchmark, range(5) t(i)""")
def balanced_chunks(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    return b.select("item_id", F.posexplode(layout.chunks("text", "5")).alias("part", "chunk")).withColumn("part", F.col("part").cast("long"))


@query("projection_runs", f"WITH {REGIONS}, f AS (SELECT page_id, rn, rn - row_number() OVER (PARTITION BY page_id ORDER BY rn) AS g FROM regions WHERE vertical) SELECT page_id, min(rn) AS first, max(rn) AS last, count(*) AS length FROM f GROUP BY page_id, g")
def projection_runs(spark, sf):
    return layout.runs(regions(spark, sf), "page_id", "rn", "vertical")


@query("centre_clusters", f"""WITH RECURSIVE {REGIONS}, o AS (SELECT page_id, (x + w / 2.0)::DOUBLE AS v, row_number() OVER (PARTITION BY page_id ORDER BY x + w / 2.0, rn) AS k FROM regions),
c AS (SELECT page_id, k, 0::BIGINT AS cluster, v AS s, 1::BIGINT AS n FROM o WHERE k = 1 UNION ALL SELECT o.page_id, o.k, CASE WHEN o.v - c.s / c.n <= 60 THEN c.cluster ELSE c.cluster + 1 END,
  CASE WHEN o.v - c.s / c.n <= 60 THEN c.s + o.v ELSE o.v END, CASE WHEN o.v - c.s / c.n <= 60 THEN c.n + 1 ELSE 1 END FROM c JOIN o ON o.page_id = c.page_id AND o.k = c.k + 1)
SELECT page_id, cluster, round(arg_max(s / n, k), 6) AS centre, max(n) AS points FROM c GROUP BY page_id, cluster""")  # fmt: skip
def centre_clusters(spark, sf):
    return layout.centre_clusters(regions(spark, sf), "page_id", "x + w / 2.0D", "60").withColumn("centre", F.round("centre", 6))


@query("geometry_steps", f"WITH {REGIONS}, d AS (SELECT page_id, lead(x) OVER (PARTITION BY page_id ORDER BY x, rn) - x AS step FROM regions) SELECT page_id, median(step)::DOUBLE AS step FROM d WHERE step IS NOT NULL GROUP BY page_id")
def geometry_steps(spark, sf):
    from pyspark.sql import Window

    step = F.lead("x").over(Window.partitionBy("page_id").orderBy("x", "rn")) - F.col("x")
    return regions(spark, sf).select("page_id", step.alias("step")).where("step is not null").groupBy("page_id").agg(F.median("step").alias("step"))


@query("moving_average", f"WITH {REGIONS} SELECT page_id, rn, round(sum(w) OVER (PARTITION BY page_id ORDER BY rn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0, 6)::DOUBLE AS smooth FROM regions")
def moving_average(spark, sf):
    from pyspark.sql import Window

    return regions(spark, sf).select("page_id", "rn", F.round(F.sum("w").over(Window.partitionBy("page_id").orderBy("rn").rowsBetween(-1, 1)) / 3.0, 6).alias("smooth"))


def groups(spark, sf):
    return regions(spark, sf).withColumns({"p": F.expr("least(w, h) / 3.0D"), "n": F.expr("4 + rn"), "expected": F.expr("2")})


PLANS = f"""WITH {REGIONS}, e AS (SELECT *, least(w, h) / 3.0::DOUBLE AS p, 4 + rn AS n FROM regions), f AS (SELECT *, least(180, greatest(10, ceil(1.15 * p)))::BIGINT AS high FROM e),
s AS (SELECT *, unnest(range(least(high, greatest(10, floor(0.85 * p)))::BIGINT, high + 1)) AS size FROM f), c AS (SELECT *, unnest(range(1, n + 1)) AS columns FROM s),
r AS (SELECT *, columns * size * 1.08::DOUBLE AS bw, ceil(n / columns::DOUBLE) * size AS bh FROM c),
q AS (SELECT *, 4.4 * abs(ln(size / p)) + 1.15 * abs(ln(bw / w)) + 1.45 * abs(ln(bh / h)) + 0.32 * abs(columns - 2) AS cost FROM r WHERE bw <= w AND bh <= h)"""


@query("layout_search_vertical", PLANS + " SELECT page_id, rn, count(*) AS plans, round(min(cost), 6)::DOUBLE AS best FROM q GROUP BY page_id, rn")
def layout_search_vertical(spark, sf):
    return layout.vertical_plans(groups(spark, sf)).groupBy("page_id", "rn").agg(F.count("*").alias("plans"), F.round(F.min("cost"), 6).alias("best"))


@query("layout_search_horizontal", f"""WITH {REGIONS}, e AS (SELECT *, least(w, h) / 3.0::DOUBLE AS p, 4 + rn AS n FROM regions), f AS (SELECT *, least(180, greatest(10, ceil(1.15 * p)))::BIGINT AS high FROM e),
s AS (SELECT *, unnest(range(least(high, greatest(10, floor(0.85 * p)))::BIGINT, high + 1)) AS size FROM f), c AS (SELECT *, greatest(1, w // size) AS k FROM s),
r AS (SELECT *, least(n, k) * size AS bw, ceil(n / k::DOUBLE) * size * 1.18::DOUBLE AS bh FROM c),
q AS (SELECT *, 4.8 * abs(ln(size / p)) + 1.55 * abs(ln(bw / w::DOUBLE)) + 1.75 * abs(ln(bh / h)) AS cost FROM r WHERE bw <= w AND bh <= h)
SELECT page_id, rn, count(*) AS plans, round(min(cost), 6)::DOUBLE AS best FROM q GROUP BY page_id, rn""")  # fmt: skip
def layout_search_horizontal(spark, sf):
    return layout.horizontal_plans(groups(spark, sf)).groupBy("page_id", "rn").agg(F.count("*").alias("plans"), F.round(F.min("cost"), 6).alias("best"))


@query("signed_overlap", f"WITH {REGIONS} SELECT a.page_id, a.rn AS i, b.rn AS j, {metrics.g.signed_overlap()}::BIGINT AS overlap FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.rn < b.rn")
def signed_overlap(spark, sf):
    return pages.pairs(regions(spark, sf), "true").select("a.page_id", F.col("a.rn").alias("i"), F.col("b.rn").alias("j"), F.expr(metrics.g.signed_overlap()).cast("long").alias("overlap"))


@query("reading_pad", f"WITH {REGIONS} SELECT page_id, rn, {metrics.g.reading_pad('0.125', '4')} AS pad FROM regions")
def reading_pad(spark, sf):
    return regions(spark, sf).select("page_id", "rn", F.expr(metrics.g.reading_pad("0.125", "4").replace("round_even", "bround")).alias("pad"))


@query("layout_choose", PLANS + """, k AS (SELECT *, row_number() OVER (PARTITION BY page_id, rn ORDER BY NOT (size >= greatest(10.0, 0.92 * p)), round(cost, 9), round(abs(ln(size / p)), 9), size DESC, columns) AS pick FROM q)
SELECT page_id, rn, size, columns FROM k WHERE pick = 1""")
def layout_choose(spark, sf):
    return layout.vertical_choice(groups(spark, sf), ["page_id", "rn"])


@query("block_bbox", f"WITH {REGIONS} SELECT page_id, rn, floor(x + w / 2.0 - w / 3.0)::BIGINT AS bx, floor(y + h / 2.0 - h / 4.0)::BIGINT AS by FROM regions")
def block_bbox(spark, sf):
    box = layout.block_box("x", "y", "w / 2.0D", "h / 2.0D", "(w * 2 / 3.0D)", "(h / 2.0D)")
    return regions(spark, sf).select("page_id", "rn", box["bx"].cast("long").alias("bx"), box["by"].cast("long").alias("by"))


@query("layout_collisions", f"WITH {REGIONS} SELECT a.page_id, a.rn AS i, b.rn AS j FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.rn < b.rn AND " + layout.block_conflict("a.", "b.", "20"))
def layout_collisions(spark, sf):
    return pages.pairs(regions(spark, sf), layout.block_conflict("a.", "b.", "20")).selectExpr("a.page_id", "a.rn as i", "b.rn as j")


PIXELS = f"{REGIONS}, px AS (SELECT page_id, rn, unnest(range(x // 16, (x + w - 1) // 16 + 1)) AS px, y, h FROM regions), pixels AS (SELECT page_id, rn, py * 4096 + px AS pixel FROM (SELECT page_id, rn, px, unnest(range(y // 16, (y + h - 1) // 16 + 1)) AS py FROM px))"


@query("mask_union", f"WITH {PIXELS} SELECT page_id, count(DISTINCT pixel) AS pixels FROM pixels GROUP BY page_id")
def mask_union(spark, sf):
    return raster.counted(masks.boxes(regions(spark, sf)).select("page_id", "x0", "y0", "x1", "y1"), lambda p: p.mask())


@query("mask_iou", f"""WITH {PIXELS}, n AS (SELECT page_id, rn, count(*) AS n FROM pixels GROUP BY ALL), b AS (SELECT a.page_id, a.rn AS i, b.rn AS j, count(*) AS c FROM pixels a JOIN pixels b ON a.page_id = b.page_id AND a.pixel = b.pixel AND a.rn < b.rn GROUP BY ALL)
SELECT b.page_id, i, j, round(c / (x.n + y.n - c)::DOUBLE, 6) AS iou, round(c / least(x.n, y.n)::DOUBLE, 6) AS contained FROM b JOIN n x ON x.page_id = b.page_id AND x.rn = i JOIN n y ON y.page_id = b.page_id AND y.rn = j""")  # fmt: skip
def mask_iou(spark, sf):
    return masks.run_overlaps(masks.rows(regions(spark, sf))).withColumns({c: F.round(c, 6) for c in ("iou", "contained")})


@query("mask_bounds", f"WITH {PIXELS}, d AS (SELECT DISTINCT page_id, pixel FROM pixels) SELECT page_id, min(pixel % 4096) AS x0, min(pixel // 4096) AS y0, max(pixel % 4096) AS x1, max(pixel // 4096) AS y1, count(*) AS pixels FROM d GROUP BY page_id")
def mask_bounds(spark, sf):
    return raster.bounds(masks.boxes(regions(spark, sf)).select("page_id", "x0", "y0", "x1", "y1"))


TRUTH = f"{REGIONS}, truth AS (SELECT * FROM regions WHERE rn % 5 <> 0), found AS (SELECT page_id, rn, x + 4 AS x, y + 3 AS y, w, h, confidence FROM regions WHERE rn % 7 <> 3)"


def halves(spark, sf):
    r = regions(spark, sf)
    return r.where("rn % 5 <> 0"), r.where("rn % 7 <> 3").withColumns({"x": F.col("x") + 4, "y": F.col("y") + 3})


MATCHED = TRUTH + """, cand AS (SELECT a.page_id, a.rn AS gt, b.rn AS det, row_number() OVER (PARTITION BY a.page_id ORDER BY a.rn, b.rn) AS k FROM truth a JOIN found b ON a.page_id = b.page_id AND {iou} > 0.5),
walk AS (SELECT page_id, 1::BIGINT AS k, [{{gt: gt, det: det}}] AS acc FROM cand WHERE k = 1 UNION ALL SELECT c.page_id, c.k, CASE WHEN len(list_filter(w.acc, lambda m: m.gt = c.gt OR m.det = c.det)) > 0 THEN w.acc ELSE list_append(w.acc, {{gt: c.gt, det: c.det}}) END FROM walk w JOIN cand c ON c.page_id = w.page_id AND c.k = w.k + 1),
matched AS (SELECT page_id, m.gt AS gt, m.det AS det FROM (SELECT page_id, unnest(arg_max(acc, k)) AS m FROM walk GROUP BY page_id))""".format(iou=metrics.g.iou())


@query("det_match", f"WITH RECURSIVE {MATCHED} SELECT * FROM matched")
def det_match(spark, sf):
    return metrics.match(*halves(spark, sf))


COUNTS = """n AS (SELECT page_id, coalesce(g.n, 0) AS gts, coalesce(d.n, 0) AS dets, coalesce(m.n, 0) AS hits FROM (SELECT page_id, count(*) AS n FROM truth GROUP BY 1) g FULL JOIN (SELECT page_id, count(*) AS n FROM found GROUP BY 1) d USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS n FROM matched GROUP BY 1) m USING (page_id)),
s AS (SELECT *, CASE WHEN gts = 0 THEN 1.0 ELSE hits / gts::DOUBLE END AS recall, CASE WHEN gts = 0 THEN CASE WHEN dets > 0 THEN 0.0 ELSE 1.0 END WHEN dets = 0 THEN 0.0 ELSE hits / dets::DOUBLE END AS precision FROM n)"""


@query("det_prf", f"WITH RECURSIVE {MATCHED}, {COUNTS} SELECT page_id, hits, round(recall, 6)::DOUBLE AS recall, round(precision, 6)::DOUBLE AS precision, round(CASE WHEN recall + precision = 0 THEN 0.0 ELSE 2 * recall * precision / (recall + precision) END, 6)::DOUBLE AS hmean FROM s")
def det_prf(spark, sf):
    truth, found = halves(spark, sf)
    return metrics.page_scores(truth, found, metrics.match(truth, found)).select("page_id", "hits", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "hmean")])


@query("det_prf_total", f"WITH RECURSIVE {MATCHED}, {COUNTS} SELECT round(sum(hits) / sum(gts)::DOUBLE, 6) AS recall, round(sum(hits) / sum(dets)::DOUBLE, 6) AS precision FROM n")
def det_prf_total(spark, sf):
    truth, found = halves(spark, sf)
    return metrics.page_scores(truth, found, metrics.match(truth, found)).agg(F.round(F.sum("hits") / F.sum("gts"), 6).alias("recall"), F.round(F.sum("hits") / F.sum("dets"), 6).alias("precision"))


@query("det_ap", f"""WITH RECURSIVE {MATCHED}, f AS (SELECT d.*, CASE WHEN m.det IS NULL THEN 0 ELSE 1 END AS hit FROM found d LEFT JOIN matched m ON m.page_id = d.page_id AND m.det = d.rn),
p AS (SELECT page_id, CASE WHEN hit = 1 THEN sum(hit) OVER w / count(*) OVER w::DOUBLE ELSE 0.0 END AS p FROM f WINDOW w AS (PARTITION BY page_id ORDER BY confidence DESC, rn ROWS UNBOUNDED PRECEDING))
SELECT page_id, round(sum(p) / any_value(n), 6)::DOUBLE AS ap FROM p JOIN (SELECT page_id, count(*) AS n FROM truth GROUP BY 1) t USING (page_id) GROUP BY page_id""")  # fmt: skip
def det_ap(spark, sf):
    truth, found = halves(spark, sf)
    return metrics.average_precision(found, metrics.match(truth, found), truth)

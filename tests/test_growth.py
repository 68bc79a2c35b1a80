"""Queries whose plans must not grow beyond their input: what they exchange, and how often."""

import contextlib
import io

import pytest

from panelflow.plans import queries as _all  # noqa: F401
from panelflow.plans.registry import QUERIES


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


#: Masks of pages: the lines of the table are dealt out once, by page; their pixels never are.
MASKS = [
    "mask_and",
    "mask_bounds",
    "mask_dilate",
    "mask_uncovered",
    "mask_union",
    "modal_colours",
    "flat_background",
    "mask_conservative",
    "pixel_components",
    "mask_bind",
    "mask_not",
    "nearest_pixels",
    "contrast_split",
    "mask_place",
]


@pytest.mark.parametrize("name", MASKS)
def test_pixels_are_not_exchanged(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    # pieces of masks are counted once more
    assert text.count("Exchange hashpartitioning") == 1 + (name == "pixel_components") and "Generate explode(sequence" not in text


@pytest.mark.parametrize("name", MASKS)
def test_boxes_are_not_listed(spark, sf, name):
    # lists of a page's boxes fell back to a second sort of what the exchange had sorted
    assert "collect_list" not in plan(QUERIES[name](spark, sf))


def test_pages_go_on_in_the_next_batch(spark):
    from panelflow.operators import raster

    # page 2 lies over several batches of two rows
    rows = [(p, i, i, 0, i + 1, p) for p, n in ((1, 1), (2, 7), (3, 2), (None, 3), (5, 2)) for i in range(n)]
    boxes = spark.createDataFrame(rows, "page_id long, rn long, x0 long, y0 long, x1 long, y1 long").where("y1 IS NOT NULL OR page_id IS NULL").fillna(0, ["y1"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r.page_id: r.pixels for r in raster.counted(boxes.coalesce(1), lambda p: p.mask()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1: 4, 2: 24, 3: 12, None: 4, 5: 18}


def test_medians_counted_and_sorted_agree():
    import numpy as np

    from panelflow.operators import raster

    draw = np.random.default_rng(1)
    key, value = draw.integers(0, 9, 500), draw.integers(-40, 60, 500)
    for wide in (1, 1 << 20):
        got = raster.medians(key, value * wide, 10)
        assert np.isnan(got[9]) and got[:9].tolist() == [np.median(value[key == k] * wide) for k in range(9)]


#: Groups and plans of a page: one exchange of the lines, whatever is asked of a page afterwards.
PAGES = [
    "plan_patch",
    "plan_vertical",
    "plan_block",
    "plan_horizontal",
    "group_bbox_vote",
    "preferred_size",
    "axis_centres",
    "original_geometry",
    "layout_box",
    "render_collisions",
]


@pytest.mark.parametrize("name", PAGES)
def test_a_page_is_dealt_out_once(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_repeats_are_found_by_runs():
    import random
    import time

    from panelflow.functions import text as t

    assert t.collapse("abcdeabcde, and so on, and so on") == "abcde, and so on" and t.collapse("abcd;abcd;abcd") == "abcd"
    draw = random.Random(1)
    words = [" ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 8))) for _ in range(700)) for _ in range(2)]
    start = time.perf_counter()
    assert [t.collapse(w) for w in words] == words
    # tens of seconds where each length was searched for
    assert time.perf_counter() - start < 5


def test_reaching_is_likeness():
    from panelflow.functions import text as t

    said = ["", "a", "ab", "abc", "abd", "x" * 200, "x" * 190 + "y" * 10, "xy" * 100]
    assert all(t.reaches(a, b, least) == (t.ratio(a, b) >= least) for a in said for b in said for least in (0.5, 0.78, 0.94))


def _upright_only(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from panelflow.operators import polygons

    def never(points):
        raise AssertionError("an upright box needs no search")

    monkeypatch.setattr(polygons, "smallest_box", never)
    made = [[x + 4.0, y + 3.0, x, y, x + 4, y, x, y + 3, x + 2, y] for x, y in ((0.0, 0.0), (2.0, 1.0), (9.0, 9.0))]
    return np, polygons, pa.array(made), pa.array(made[1:] + made[:1])


def test_upright_boxes_are_found_in_batches(monkeypatch):
    np, polygons, a, _ = _upright_only(monkeypatch)
    assert polygons.boxed(a)[1].tolist() == [2, 1, 6, 1, 6, 4, 2, 4]


def test_upright_overlaps_are_found_in_batches(monkeypatch):
    np, polygons, a, b = _upright_only(monkeypatch)
    assert np.allclose(polygons.overlaps(a, b), [4 / 20, 0, 0])


def test_turned_boxes_are_still_searched():
    import numpy as np
    import pyarrow as pa

    from panelflow.operators import polygons

    square, diamond = [0.0, 0, 10, 0, 10, 10, 0, 10], [5.0, -2, 12, 5, 5, 12, -2, 5]
    a, b = pa.array([square, diamond, diamond]), pa.array([diamond, square, diamond])
    assert np.allclose(polygons.overlaps(a, b), [82 / 116, 82 / 116, 1]) and np.allclose(polygons.boxed(a)[1], polygons.smallest_box(np.reshape(diamond, (4, 2))).ravel())


def test_a_point_is_no_part_of_a_line(spark):
    from panelflow.operators import polygons

    box = lambda x0, y0, x1, y1: [float(v) for v in (x0, y0, x1, y0, x1, y1, x0, y1)]
    rows = [(1, 1, box(0, 0, 100, 20), 20.0, 100.0, 0.0, 10.0), (1, 2, box(50, 10, 50, 10), 2.0, 1.0, 0.0, 11.0), (1, 3, box(90, 5, 190, 25), 2.0, 0.0, 9.0, 90.0), (2, 1, box(0, 0, 100, 20), 20.0, 100.0, 0.0, 10.0)]
    got = polygons.merged_lines(spark.createDataFrame(rows, "page_id long, rn long, polygon array<double>, font double, vx double, vy double, distance double"))
    # a point cut nothing off, so that it shared all of the line
    assert {(r.page_id, r.rn): r.into for r in got.collect()} == {(1, 1): 1, (1, 2): 2, (1, 3): 1, (2, 1): 1}


def test_duplicates_come_from_one_exchange(spark, sf):
    text = plan(QUERIES["duplicate_groups"](spark, sf))
    # each side of the pairs deals the lines out by page (the same exchange); masks are measured on the pair
    assert text.count("Exchange hashpartitioning") <= 2 and text.count("Join") == 1 and "explode(sequence" not in text


@pytest.mark.parametrize("name", ["merge_groups", "merge_groups_fuzzy"])
def test_merged_groups_meet_by_page_alone(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    # all dealing out is by page
    assert all("hashpartitioning(page_id#" in line and ", 8)" in line and line.count("#") <= 3 for line in text.splitlines() if "Exchange hashpartitioning" in line)


def test_masks_of_boxes_count_where_boxes_are_apart(spark):
    from panelflow.operators import merging

    boxes = [(1, 1, 0, 0, 10, 10, True, "ab", 0.9, 0, 0, 9, 9), (1, 2, 40, 0, 10, 10, True, "abc", 0.8, 0, 0, 9, 9), (1, 3, 80, 0, 10, 10, True, "abc", 0.8, 20, 0, 29, 9)]
    df = spark.createDataFrame(boxes, "page_id long, rn long, x long, y long, w long, h long, vertical boolean, text string, confidence double, x0 long, y0 long, x1 long, y1 long")
    assert [tuple(r) for r in merging.duplicates(df).collect()] == [(1, 1, 2)]


def test_agreement_needs_no_join(spark, sf):
    text = plan(QUERIES["reading_agreement"](spark, sf))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


@pytest.mark.parametrize("name", ["combine_readings", "axis_centres"])
def test_a_fold_is_not_spelled_out_again(spark, sf, name):
    lines = plan(QUERIES[name](spark, sf)).splitlines()
    # tens of thousands of characters, evaluated for each group, where a filter held the folds below it
    assert all(len(line) < 4000 for line in lines if "Filter" in line)


def test_a_page_of_readings_is_dealt_out_once(spark, sf):
    text = plan(QUERIES["combine_readings"](spark, sf))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_single_readings_are_not_compared(spark, monkeypatch):
    from panelflow.operators import readings

    def never(a, b):
        raise AssertionError("a single reading has nothing to be compared with")

    square = readings.t.square(never)
    monkeypatch.setattr(readings, "likeness", square)
    monkeypatch.setattr(readings, "shares", square)
    rows = [("a", 1, 0, 0, 9, 9, "ab", "ab", 0.5), ("b", 1, 0, 0, 9, 9, "!", "!", 0.5), ("c", 1, 0, 0, 9, 9, "c", "c", 1.5)]
    got = readings.combined(spark.createDataFrame(rows, "group_id string, ordinal long, x long, y long, w long, h long, text string, normalized string, quality double"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "ab", 0.5, "combined"), ("c", "c", 1.0, "combined")]


def test_hints_and_centres_of_parts(spark):
    from pyspark.sql import functions as F

    from panelflow.operators import fonts

    rows = [(g, s, h, x) for g, parts in enumerate(([("ctd", 20.0, 0)], [("multiscale", 20.0, 0)], [("ctd", 3.0, 0)], [("x", None, 0)], [("ctd", 10.0, 0), ("ctd", 30.0, 2), ("x", 90.0, 4)], [("ctd", 301.0, 0), ("x", 5.0, 40), (None, 8.0, 90)])) for s, h, x in parts]
    parts = spark.createDataFrame([(g, s, h, x, 0, 9, 9) for g, s, h, x in rows], "g long, source string, font_hint double, x long, y long, w long, h long")
    groups = parts.groupBy("g").agg(fonts.font_hint().alias("want"), F.array_sort(F.collect_list(F.struct("x", "source", "y", "w", "h", "font_hint"))).alias("parts"))
    made = groups.withColumns({"hint": fonts.parts_hint(), "p": F.lit(10.0), "x": F.lit(0), "y": F.lit(0), "vertical": F.lit(True)})
    got = {r.g: (r.hint, r.want, r.centres) for r in fonts.axis_centres(made).collect()}
    assert all(hint == want for hint, want, _ in got.values()) and [got[g][0] for g in range(6)] == [20, 20, None, None, 20, 6.5]
    assert [got[g][2] for g in range(6)] == [[4.5]] * 4 + [[5.5], [4.5]]
    assert fonts.axis_centres(made.where("g = 0").withColumn("p", F.lit(1.0))).first().centres == []


def test_medians_of_hints_are_not_aggregated(spark, sf):
    # a median's table of values was written and read for each group
    assert "percentile" not in plan(QUERIES["preferred_size"](spark, sf)).lower() and "median" not in plan(QUERIES["preferred_size"](spark, sf)).lower()


def test_plans_are_chosen_within_the_row(spark, sf):
    text = plan(QUERIES["layout_choose"](spark, sf))
    # all plans of a partition were sorted
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Window") == 1 and text.count("+- Sort") == 1


def test_choice_is_that_of_all_plans(spark):
    from panelflow.operators import layout

    rows = [(k, w, h, min(w, h) / 3.0, n, 2) for k, (w, h, n) in enumerate([(40, 200, 9), (220, 60, 30), (20, 20, 5), (100, 100, 12), (3, 400, 4), (90, 30, 1), (150, 160, 44), (-5, 40, 3)])] + [(98, None, 5, None, 3, 2)]
    df = spark.createDataFrame(rows, "k long, w long, h long, p double, n long, expected int")
    got, want = ({r.k: (r.size, r.columns) for r in d.collect()} for d in (layout.vertical_choice(df, ["k"]), layout.choose(layout.vertical_plans(df), ["k"])))
    assert got == want and 0 < len(got) < len(rows)

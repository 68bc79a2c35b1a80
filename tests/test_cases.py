"""Literal cases of the operators, and models in plain Python."""

import pytest
from pyspark.sql import functions as F

from panelflow.functions import text as t
from panelflow.operators import answers, layout, manifest, merging, metrics, pages, readings, texts
from panelflow.sources import config, files
from panelflow.streaming import pages as streaming


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [tuple(r) for r in df.orderBy("i").select(*exprs).collect()]


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *r[:4], r[5] if len(r) > 5 else "ctd", float(r[6]) if len(r) > 6 else 0.9, r[4]) for i, r in enumerate(rows)], "page_id long, rn long, x long, y long, w long, h long, source string, confidence double, vertical boolean")


def test_natural_sort(spark):
    assert [r.v for r in spark.createDataFrame([("page10.png",), ("page2.png",), ("page1.png",)], "v string").orderBy(files.natural_key("v")).collect()] == ["page1.png", "page2.png", "page10.png"]


def test_sanitize_and_weak(spark):
    assert column(spark, [" こ​ん�に\nちは ", "||丨‖", None], t.sanitize("v")) == [("こんにちは",), ("",), ("",)]


def test_quality_order(spark):
    df = spark.createDataFrame([("今日はどうしたの?",), ("◆◆◆◆◆◆",), ("漢",), ("え",), ("",)], "v string").withColumn("_run", t.max_run("v"))
    assert [round(r.q, 4) for r in df.select(t.quality("v").alias("q")).collect()] == [0.9053, 0.0, 0.56, 0.72, 0.0]


def test_acceptance(spark):
    df = spark.createDataFrame([("", 0.0), ("!!", 0.9), ("abc", 0.1), ("漢", 0.56), ("大丈夫", 0.9)], "v string, q double")
    assert [r[0] for r in df.select(t.reject_reason("v", "q")).collect()] == ["empty_ocr", "symbol_only_ocr", "low_ocr_quality:0.100", "weak_short_ocr:0.560", None]


def test_similarity():
    assert t.ratio("", "a") == 0 and t.ratio("ab", "abcd") == 0.5 and t.covered("ab", "xaby") == 1 and t.longest("abcx", "zabc") == 0.75


@pytest.mark.parametrize(("text", "source", "want"), [("翻譯：等等â€¦\n翻譯：等等â€¦", None, "等等…"), ("||你好丨", "こんにちは", "你好"), ("你好...", "こんにちは", "你好"), ("等等…", "待って…", "等等…"), ("||...", "こんにちは", ""), ("謝謝指導——！", "ありがとうございましたーッ", "謝謝指導!"), ("等等——別過來！", "待て――来るな！", "等等——別過來!"), ("情報已經掌握了情報已經掌握了", "了解", "情報已經掌握了"), ("不要不要", "いや", "不要不要"), ("快跑快跑快跑快跑", "逃げろ逃げろ", "快跑快跑快跑快跑")])
def test_translation(text, source, want):
    assert t.translation(text, source) == want


def test_issues(spark):
    rows = [("どうしたの？", "你怎麼了？"), ("x", ""), ("どうしたの", "どうしたの"), ("待って", "ç­‰ä¸€ä¸‹Ã"), ("はい", "好" * 75)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, v string").select(t.issues("s", "v")).collect()]
    odd = spark.createDataFrame([("待って", "等一下\ue000"), ("はい", "好 " * 24)], "s string, v string").select(t.issues("s", "v"), t.issues("s", "v", "concat(v, 'Ã')")).collect()
    assert odd[0][0] == ["unsupported_unicode"] and odd[0][1] == ["mojibake", "unsupported_unicode"] and odd[1][0] == []
    assert t.translation("CafÃ© Ã©") == "Café é" and t.translation("你 Ã") == "你 Ã"
    assert got[0] == [] and got[1] == ["empty"] and "source_copied" in got[2] and "mojibake" in got[3] and got[4] == ["too_long"]


def test_groups(spark):
    far = pages.grouped(boxes(spark, [(0, 0, 1000, 1000, False), (40, 50, 80, 120, True), (700, 700, 80, 120, True)]))
    assert far.count() == 3
    assert pages.grouped(boxes(spark, [(10, 10, 80, 120, True), (14, 14, 76, 116, True)])).count() == 1


def test_auto_order(spark):
    got = pages.reading_order(boxes(spark, [(10, 10, 30, 20, False), (10, 100, 30, 20, False), (500, 200, 20, 40, True)]).withColumn("component", F.col("rn"))).orderBy("position").collect()
    assert [r.rn for r in got] == [0, 1, 2]


def test_collisions(spark):
    rows = [(1, 1, 10, 10, 120, 220, True, 1, 0, 0, 0.9), (1, 2, 30, 30, 100, 190, True, 0, 0, 1, 0.88), (1, 3, 500, 500, 50, 50, True, 1, 0, 0, 0.5)]
    groups = spark.createDataFrame(rows, "page_id long, component long, x long, y long, w long, h long, vertical boolean, ctd long, multiscale long, fallback long, confidence double")
    got = {r.component: r.kept for r in pages.render_collisions(groups).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_merge_keeps_lineage(spark):
    rows = [(1, 0, 10, 10, 80, 120, True, "今日はどうしたの", 0.9), (1, 1, 14, 14, 76, 116, True, "今日はどうしたろ", 0.8), (2, 0, 10, 10, 30, 50, True, "うん", 0.9), (2, 1, 80, 10, 30, 50, True, "うん", 0.9)]
    got = merging.merged(spark.createDataFrame(rows, "page_id long, ordinal long, x long, y long, w long, h long, vertical boolean, text string, confidence double")).collect()
    assert {(r.page_id, r.ordinal): r.into for r in got} == {(1, 0): 0, (1, 1): 0, (2, 0): 0, (2, 1): 1}


def test_translation_duplicates(spark):
    rows = [(1, 0, 10, 10, 80, 120, "どうした", "你怎麼了呢", 0.9), (1, 1, 14, 14, 76, 116, "どうしたの", "你怎麼了呢", 0.8), (1, 2, 500, 10, 80, 120, "どうした", "你怎麼了呢", 0.9), (2, 0, 0, 0, 50, 50, "うん", "嗯", 0.9), (2, 1, 1, 1, 50, 50, "いや", "嗯", 0.9), (3, 0, 0, 0, 50, 50, None, None, 0.9)]
    got = merging.translation_duplicates(spark.createDataFrame(rows, "page_id long, ordinal long, x long, y long, w long, h long, source string, target string, confidence double")).collect()
    assert {(r.page_id, r.ordinal): r.into for r in got} == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (2, 0): 0, (2, 1): 1, (3, 0): 0}


def test_horizontal_plans(spark):
    one = spark.createDataFrame([(1, 200, 30, 5, 20.0), (2, 5, 400, 3, 20.0)], "k long, w long, h long, n long, p double")
    got = {r.k: (r.size, r.lines) for r in layout.choose(layout.horizontal_plans(one), ["k"], "lines").collect()}
    assert got == {1: (20, 1)}  # a box narrower than a character takes no plan


def test_best_candidate(spark):
    rows = [("g", 0, "a", "今日は", 0.82), ("g", 1, "b", "今日はどうしたの", 0.79), ("g", 2, "c", "今日はどうした", 0.80)]
    assert [r.normalized for r in texts.best_candidate(spark.createDataFrame(rows, "group_id string, ordinal int, source string, normalized string, quality double")).collect()] == ["今日はどうしたの"]


def test_parse(spark):
    r = spark.createDataFrame([(1, '```json\n{"translations":[{"id":"T0000","text":"你好"},{"id":"T0001","text":"走吧"}]}\n```'), (2, "no json")], "request long, response string")
    assert [x.text for x in texts.parse_json(r).orderBy("item_id").collect()] == ["你好", "走吧"]
    n = spark.createDataFrame([(1, "[0]：你好\n[1]：走吧\nnote")], "request long, response string")
    assert [(x.no, x.text) for x in texts.parse_numbered(n).orderBy("no").collect()] == [(0, "你好"), (1, "走吧")]


def test_first_valid(spark):
    rows = [(1, "a", 1, "x", False), (1, "a", 2, "y", True), (1, "a", 3, "z", True), (1, "b", 1, "x", False)]
    assert [r.text for r in texts.first_valid(spark.createDataFrame(rows, "request long, item_id string, attempt int, text string, valid boolean")).collect()] == ["y"]


def test_blocks(spark):
    conflict = lambda a, b: spark.range(1).select(F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", a)]).alias("a"), F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", b)]).alias("b")).select(F.expr(layout.block_conflict("a.", "b.", "38"))).first()[0]
    assert conflict((60, 40, 80, 120), (100, 50, 80, 120)) and not conflict((60, 40, 80, 120), (431, 431, 38, 38))
    box = layout.block_box("100", "200", "80D", "120D", "40D", "90D")
    assert list(spark.range(1).select(*box.values()).first()) == [160, 275, 40, 90]


def test_metrics_without_truth(spark):
    t0 = boxes(spark, [(0, 0, 10, 10, True)])
    got = metrics.page_scores(t0.limit(0), t0, metrics.match(t0.limit(0), t0)).first()
    assert (got.recall, got.precision, got.hmean) == (1.0, 0.0, 0.0)


def test_sources(spark, tmp_path):
    (tmp_path / "a2.PNG").write_bytes(b"x")
    (tmp_path / "a.txt").write_bytes(b"x")
    assert [r.name for r in files.scan(spark, str(tmp_path)).collect()] == ["a2.PNG"]
    (tmp_path / "g.json").write_text('{"entries": {" A ": "B", "C": ""}}')
    assert [tuple(r) for r in files.glossary(spark, str(tmp_path / "g.json")).collect()] == [("A", "B")]
    bodies = ['{"choices":[{"message":{"content":"hi"}}]}', '{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}}]}', '{"error":{"message":"no"}}']
    assert column(spark, bodies, files.answer_text("v"), files.answer_error("v")) == [("hi", None), ("ab", None), (None, "no")]
    waits = spark.createDataFrame([(429, 1, None), (503, 5, None), (500, 4, 7.0), (200, 1, None), (500, 4, None)], "s int, a int, after double").select(files.retry_delay("s", "a", "after")).collect()
    assert [r[0] for r in waits] == [2.0, None, 7.0, None, 16.0]


def test_settings(tmp_path, monkeypatch):
    s = config.Settings.load(str(tmp_path / "c.json"), '{"translating": {"batch_size": 5}, "input_dir": "in"}')
    assert s.translating.batch_size == 5 and s.input_dir == str((tmp_path / "in").resolve())
    monkeypatch.setenv("PANELFLOW_API_KEY", "k")
    assert s.key() == "k"
    for kind, values in ((config.Translating, {"batch_size": 0}), (config.Layout, {"mode": "wide"}), (config.Layout, {"font_min": 200}), (config.Detecting, {"additional_input_sizes": [100]})):
        with pytest.raises(ValueError):
            config.build(kind, values)
    with pytest.raises(TypeError):
        config.build(config.Reading, {"unknown": 1})
    assert config.build(config.Detecting, {"additional_input_sizes": [1536, 1024, 1536]}).additional_input_sizes == (1536, 1024)
    run = s.overridden(no_grouping=True, page_context="window", scope="region")
    assert (run.grouping.enabled, run.grouping.dedup, run.grouping.translate_groups, run.translating.page_context, run.layout.scope) == (False, False, False, "window", "region") and s.grouping.enabled
    with pytest.raises(ValueError):
        s.overridden(scope="page")


def test_ports_see_no_copy_twice(spark):
    seen = []

    def port(rows):
        seen.append(rows.count())
        return rows.withColumn("out", F.upper("v"))

    got = manifest.once(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i long, v string"), "v", port)
    assert sorted(r.out for r in got.collect()) == ["A", "A", "B"] and seen == [2]


def test_order_and_partitions_do_not_matter(spark, sf):
    r = pages.regions(spark.read.parquet(f"{sf}/lineitem.parquet"))
    once = sorted(map(tuple, pages.nms(r).select("page_id", "rn", "kept").collect()))
    assert once == sorted(map(tuple, pages.nms(r.orderBy(F.desc("rn")).repartition(5)).select("page_id", "rn", "kept").collect()))


def test_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    folder = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").limit(200).write.parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))
    q = streaming.distinct_content(stream, "event_type", "ts").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(str(folder)).select("event_type").distinct().count()
    assert spark.table("seen").select("event_type").distinct().count() == want


def test_plans_of_many_columns(spark):
    groups = spark.createDataFrame([(1, 220, 100, 10.0, 100, 2)], "page_id long, w long, h long, p double, n long, expected long")
    assert sorted(r.columns for r in layout.vertical_plans(groups).where("size = 10").collect()) == list(range(10, 21))


def test_duplicates_by_rule(spark):
    a = (0, 0, 60, 100, True, "こんにちは")
    pairs = [
        (a, (65, 0, 60, 100, True, "こんにちは"), True),
        ((0, 0, 100, 60, False, "hello"), (0, 65, 100, 60, False, "hello"), True),
        (a, (70, 0, 60, 100, True, "こんにちは"), False),  # gap 0.10
        (a, (65, 50, 60, 100, True, "こんにちは"), False),  # overlap 0.50
        (a, (65, 0, 60, 100, True, "さようなら"), False),
        (a, (65, 0, 60, 100, False, "こんにちは"), False),
        (a, (65, 0, 60, 50, True, "こんにちは"), False),  # area ratio 0.50
        (a, (2, 2, 60, 100, True, ""), False),  # one place, but an empty reading needs masks
        (a, (5, 5, 20, 60, True, "んにち"), True),  # inside, and covered
    ]
    rows = [(k, i, *box, 0.9) for k, (x, y, _) in enumerate(pairs) for i, box in enumerate((x, y))]
    df = spark.createDataFrame(rows, "page_id long, rn long, x long, y long, w long, h long, vertical boolean, text string, confidence double")
    assert {r.page_id for r in merging.duplicates(df).collect()} == {k for k, p in enumerate(pairs) if p[2]}
    masks = spark.createDataFrame([(7, 0, 1, 0.6, 0.9)], "page_id long, i long, j long, iou double, contained double")
    assert {r.page_id for r in merging.duplicates(df, masks).collect()} == {k for k, p in enumerate(pairs) if p[2]} | {7}


def test_merge_joins_original_groups_and_keeps_the_best_reading(spark):
    """A chain A-B-C is one component by its pairs, whatever the merged box would overlap."""
    rows = [
        (1, 0, 0, 0, 60, 100, True, "早く逃げろ", 0.8), (1, 1, 10, 0, 60, 100, True, "早く逃げろよ", 0.7), (1, 2, 20, 0, 60, 100, True, "早く逃げろよ!", 0.6), (1, 3, 300, 0, 60, 100, True, "別", 0.9),
        (2, 0, 0, 0, 60, 100, True, "待ってくれ", 0.9), (2, 1, 2, 0, 60, 100, True, "待ってくわ", 0.95), (3, 0, 0, 0, 60, 100, True, None, 0.1),
    ]
    df = spark.createDataFrame(rows, "page_id long, ordinal long, x long, y long, w long, h long, vertical boolean, text string, confidence double")
    got = {(r.page_id, r.ordinal): r for r in merging.merged(df).collect()}
    assert {k: r.into for k, r in got.items()} == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 3, (2, 0): 0, (2, 1): 0, (3, 0): 0}
    assert (got[1, 0].text, got[1, 0].w, got[1, 0].confidence) == ("早く逃げろよ!", 80, 0.6) and got[2, 0].text == "待ってくわ"


def test_candidate_views_are_whole_texts(spark, sf, monkeypatch):
    from panelflow.plans import text_queries

    seen = []
    monkeypatch.setattr(text_queries.texts, "best_candidate", lambda views: seen.append(views) or views.withColumn("score", F.lit(1.0)))
    text_queries.best_candidate(spark, sf)
    whole = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    assert seen[0].join(whole, F.expr("group_id = item_id and normalized = text"), "left_anti").count() == 0


READINGS = "group_id string, ordinal long, x long, y long, w long, h long, text string, normalized string, quality double"


def test_combined_readings(spark):
    rows = [
        ("repeat", 0, 10, 10, 20, 30, "うん", "うん", 0.9), ("repeat", 1, 60, 10, 20, 30, "うん", "うん", 0.9),
        ("nested", 0, 0, 0, 120, 180, "今日はどうしたの", "今日はどうしたの", 0.9), ("nested", 1, 70, 0, 45, 180, "今日は", "今日は", 0.9), ("nested", 2, 10, 0, 45, 180, "どうしたの", "どうしたの", 0.9),
        ("twice", 0, 0, 0, 100, 100, "早く逃げろ", "早く逃げろ", 0.7), ("twice", 1, 2, 2, 98, 98, "早く逃げろよ", "早く逃げろよ", 0.8), ("empty", 0, 0, 0, 9, 9, "", "", 0.0),
    ]
    got = {r.group_id: (r.text, r.source) for r in readings.combined(spark.createDataFrame(rows, READINGS)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"repeat": "うんうん", "nested": "今日はどうしたの", "twice": "早く逃げろよ"} and got["repeat"][1] == "combined"


def test_fallback_reasons(spark):
    rows = [(0.9, "漢", 0.9), (0.9, "大丈夫", 0.9), (0.7, "大丈夫", 0.9), (0.9, "大丈夫", 0.5)]
    df = spark.createDataFrame(rows, "q double, v string, a double").withColumn("j", readings.meaningful("v"))
    assert [r[0] for r in df.select(readings.fallback_reason("q", "j", "a")).collect()] == ["fallback_too_short:1", None, "fallback_low_quality:0.700", "fallback_disagreement:0.500"]


def test_answers_of_any_form(spark):
    cases = [
        ('{"translations":[{"id":"T0000","text":"你好"},{"id":"T0001","text":"走吧"}]}', 2, ["你好", "走吧"]),
        ('{"translations":[{"id":"T0017","text":"別擔心"}]}', 1, ["別擔心"]),
        ("[0]：你好\n[1]：走吧", 2, ["你好", "走吧"]),
        ('note [x] {"items": [{"index": 1, "translated_text": 5}, {"index": 9, "text": "far"}, 7]} end', 2, ["", ""]),
        ('{"items": [{"index": 1, "translated_text": 5}, {"index": 9, "text": "far"}, 7, {"id": "T1", "text": "last"}]}', 2, ["", "last"]),
        ('["a", "b"]', 3, ["", "", ""]), ('{"T0": "a", "2": 3.5, "note": "x"}', 3, ["a", "", "3.5"]),
        ("3 men came\n4 left", 2, ["3 men came", "4 left"]), ("only this", 1, ["only this"]), (None, 2, ["", ""]), ("", 1, [""]), ('say {"translations": [{"text": "brace } and \\" quote"}]} !', 1, ['brace } and " quote']),
        ("- (1) - second\n【T0】= first", 2, ["first", "second"]),
    ]
    df = spark.createDataFrame([(i, r, n) for i, (r, n, _) in enumerate(cases)], "request long, response string, count long")
    got: dict = {}
    for r in answers.parsed(df).orderBy("request", "no").collect():
        got.setdefault(r.request, []).append(r.text)
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_labels(spark):
    lines = ["> 譯文：你好", "[T0001] 走吧", "(3)：嗯", "T0002- 好", "原文：あ → 啊", "我 → 你", "翻譯結果: 【2】是"]
    assert [r[0] for r in column(spark, lines, answers.without_label(F.col("v")))] == ["你好", "走吧", "嗯", "好", "啊", "我 → 你", "是"]


def test_layout_survivors(spark):
    from panelflow.operators import status

    rows = [(1, 0, 0, 60, 40, 80, 120, 40, None, None, None, None, None), (1, 1, 1, 100, 50, 80, 120, 38, None, None, None, None, None), (1, 2, 2, 431, 431, 38, 38, 38, None, None, None, None, None), (1, 3, 3, 100, 50, 80, 120, 38, 300, 300, 20, 20, 20)]
    df = spark.createDataFrame(rows, "page_id long, rank long, rn long, x long, y long, w long, h long, font long, cx long, cy long, cw long, ch long, cfont long")
    got = {r.rn: r.layout_status for r in status.survivors(df, layout.block_conflict("a.", "b.", "least(a.font, b.font)")).collect()}
    assert got == {0: "planned", 1: "layout_collision_rejected", 2: "planned", 3: "compact"}


def test_orientation_and_rotation(spark):
    from panelflow.functions import shapes
    from panelflow.functions.steps import apply

    df = spark.createDataFrame([(0, 300, 120, 0, 3, "ja"), (0, 100, 90, 0, 1, "eng"), (0, 100, 400, 300, 2, "eng")], "vx long, vy long, hx long, hy long, lines long, language string")
    assert [(r.upright, r.font, r.angle) for r in apply(df, shapes.ORIENTATION).collect()] == [(True, 40, 0), (False, 100, 0), (False, 50, 36)]


def test_pieces_of_a_mask(spark):
    from panelflow.operators import raster

    pixels = [(1, 0, x, y) for x, y in ((0, 0), (1, 1), (2, 0), (5, 5), (6, 5), (9, 0), (9, 1), (8, 2), (7, 3))]
    got = raster.labelled(spark.createDataFrame(pixels, "page_id long, rn long, px long, py long")).collect()
    assert sorted((r.x, r.y, r.w, r.h, r.pixels) for r in got) == [(0, 0, 3, 2, 3), (5, 5, 2, 1, 2), (7, 0, 3, 4, 4)]


def test_polygons():
    import numpy as np

    from panelflow.operators import polygons

    square = [0, 0, 10, 0, 10, 10, 0, 10]
    diamond = [5, -2, 12, 5, 5, 12, -2, 5]
    assert polygons.overlap(square, square) == 1 and polygons.overlap(square, [20, 0, 30, 0, 30, 10, 20, 10]) == 0
    assert abs(polygons.overlap(square, diamond) - (100 - 4 * 4.5) / (100 + 98 - 82)) < 1e-9
    assert {tuple(np.round(c).tolist()) for c in polygons.smallest_box(np.array(diamond).reshape(-1, 2))} == {(-2, 5), (5, -2), (12, 5), (5, 12)}


def test_lines_go_on_their_block(spark):
    from panelflow.operators import polygons

    line = lambda rn, x, y, w, h, d: (1, rn, [float(v) for v in (x, y, x + w, y, x + w, y + h, x, y + h)], float(h), float(w), 0.0, float(d))
    rows = [line(0, 0, 0, 200, 20, 10), line(1, 0, 30, 200, 20, 40), line(2, 0, 60, 200, 22, 71), line(3, 0, 400, 200, 20, 410), line(4, 500, 30, 200, 20, 41), line(5, 0, 95, 200, 60, 125)]
    got = polygons.merged_lines(spark.createDataFrame(rows, "page_id long, rn long, polygon array<double>, font double, vx double, vy double, distance double"))
    assert {r.rn: r.into for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}


def test_raw_and_drawn_forms(spark):
    assert column(spark, [" ﾃ ｽ ﾄ … ・・ "], t.read_form("v")) == [("テスト.....",)]
    assert column(spark, ["a\u200b\tb\n\n c ", None], t.drawn_form("v")) == [("a b c",), ("",)]


def test_translation_in_order(spark):
    rows = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 0, "z")], "page long, no long, text string")
    got = answers.in_order(rows, "page", "no", 2, lambda text, known: text.upper() + str(len(known)))
    assert {(r.page, r.no): r.target for r in got.collect()} == {(1, 0): "A0", (1, 1): "B1", (1, 2): "C2", (2, 0): "Z0"}

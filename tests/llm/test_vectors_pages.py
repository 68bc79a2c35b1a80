"""Operators over embeddings and pages, and the pipeline."""

import random

import numpy as np
import pytest

from panelflow.llm import html_text, neighbours, topk
from panelflow.llm.common import table
from panelflow.llm.queries import QUERIES


def vectors(spark, sf):
    return {r.vec_id: (r.label, np.array(r.embedding, np.float64)) for r in table(spark, sf, "embeddings").collect()}


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 1), (50, [2.0, 0.0], 1), (50, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [], 1), (100, [-1.0, 1e30], 3)]
    return spark.createDataFrame([(r[1], r[0], r[2], 5, 6, "x") for r in rows], "embedding array<float>, vec_id long, label int, rep long, dims long, u string")


def test_nn_descent(spark, sf):
    rows = vectors(spark, sf)
    got = {r.vec_id: r for r in QUERIES["op6_nn_descent"](spark, sf).collect()}
    ids = sorted(rows)
    m = np.stack([rows[i][1] / np.linalg.norm(rows[i][1]) for i in ids])
    lab = np.array([rows[i][0] for i in ids])
    near = (m @ m.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    want = near.sum(1)
    have = np.array([got[i].n_links for i in ids])
    assert (have <= want).all() and have.sum() >= 0.95 * want.sum()
    up = list(range(len(ids)))
    for a, b in zip(*np.nonzero(near), strict=True):
        ra, rb = up[a], up[b]
        up = [min(ra, rb) if u in (ra, rb) else u for u in up]
    assert np.mean([got[i].component_id == ids[up[k]] for k, i in enumerate(ids)]) >= 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_saturated_lists_are_enlarged(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + 0.01 * rng.normal(size=16)], 1) for i in range(700)] + [(1000 + i, [float(x) for x in rng.normal(size=16)], 1) for i in range(300)]
    got = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.n_links for r in got if r.vec_id < 700} == {699} and {r.component_id for r in got if r.vec_id < 700} == {0}


def _turned(rng, x, cosine):
    """A unit vector at the given cosine to the unit vector ``x``."""
    y = rng.normal(size=len(x))
    y -= (y @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def test_links_between_tight_groups(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(20):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        for centre in (x, _turned(rng, x, 0.985)):
            rows += [(len(rows) + i, [float(v) for v in _turned(rng, centre, 0.99995)], 1) for i in range(12)]
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {r.n_links for r in got.values()} == {23}
    assert all(r.component_id == r.vec_id // 24 * 24 for r in got.values())


def _table(spark, m):
    import pyarrow as pa

    n, d = m.shape
    rows = pa.table({"vec_id": np.arange(n), "label": np.ones(n, np.int32), "embedding": pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), m.ravel())})
    return spark.createDataFrame(rows)


def test_isolated_pairs_of_a_large_label(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(20000, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(0, 400, 2):
        m[i + 1] = _turned(rng, m[i], 0.985)
    got = neighbours.near_duplicates(_table(spark, m)).where("n_links > 0").collect()
    want = {(i, 1, i // 2 * 2) for i in range(400)}
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} <= want and len(got) >= 0.97 * len(want)


def test_low_recall_ends_in_the_exact_sweep(spark):
    """Without tables and rounds that find anything the audit stays low, and all pairs are compared."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(1500, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(0, 200, 2):
        m[i + 1] = _turned(rng, m[i], 0.982)
    got = neighbours.near_duplicates(_table(spark, m), tables=0, passes=1).where("n_links > 0").collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 1, i // 2 * 2) for i in range(200)}


def test_vectors_odd(spark, odd_vectors):
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(odd_vectors).collect()}
    assert {(0, 3, 0, True), (1, 3, 0, False), (50, 3, 0, False), (2, 0, 2, True), (8, 0, 8, True), (9, 0, 9, True), (6, 0, 6, True), (None, 0, None, True)} <= got
    assert neighbours.near_duplicates(odd_vectors).count() == 15 and neighbours.near_duplicates(odd_vectors.limit(0)).count() == 0


def slow_top(rows, k=5):
    q = {i: np.floor(256 * v).astype(np.int64) for i, v in rows.items()}
    for i in q:
        if i % 50 == 0:
            yield from [(i, n + 1, j, s) for n, (s, j) in enumerate(sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:k])]


def test_top_k(spark, sf):
    want = {(a, b, c, -d) for a, b, c, d in slow_top({i: v for i, (_, v) in vectors(spark, sf).items()})}
    got = {tuple(r) for r in QUERIES["op7_exact_top_k"](spark, sf).collect()}
    assert got == want


def test_top_k_shards_ties_and_odd(spark, odd_vectors):
    rng = np.random.default_rng(6)
    rows = {i: rng.integers(-2, 3, 8) / 256 for i in range(600)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk.top_k(df, shard_rows=100, query_rows=4).collect()}
    assert got == {(a, b, c, -d) for a, b, c, d in slow_top(rows)}
    odd = topk.top_k(odd_vectors).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in odd if r.query_id == 0} == {(0, 1, 50), (0, 2, 50), (0, 3, 1), (0, 4, 2), (0, 5, 8)}
    assert {(r.vec_id, r.score) for r in odd if r.query_id == 100 and r.rank == 1} == {(1, topk.MOST)}
    assert topk.top_k(odd_vectors.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    """Scores beyond double precision are whole, and those beyond a long are the nearest long."""
    rows = {0: [1.0, 1.0, 3.0], 1: [-1.0, 1e30, 0.0], 2: [1.0, -1e30, 0.0], 3: [2.0**40, 1.0, -(2.0**40)], 4: [2.0**41 + 0.5, 1.25, -(2.0**40) - 0.25], 50: [1.0 / 256, 2.0**45, 5.0]}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    q = {i: [int(np.floor(x)) * 256 if abs(x) > 2**50 else int(np.floor(256 * x)) for x in v] for i, v in rows.items()}
    want = set()
    for i in (0, 50):
        scores = sorted((-min(topk.MOST, max(topk.LEAST, sum(a * b for a, b in zip(q[i], q[j])))), j) for j in q if j != i)
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:5])}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want


def test_reading_stops_at_the_bounds_alone():
    """No list is read on once outsiders are out, and the bounds hold at every depth."""
    rng = np.random.default_rng(9)
    v = np.floor(256 * rng.normal(size=(300, 6)))
    lists = topk.Lists(np.arange(300), v)
    q = np.floor(256 * rng.normal(size=(40, 6)))
    split = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
    for depth in (1, 75, 150, 299, 300):
        values, slack = lists.read(depth)
        lower, true = split @ values.T, q @ lists.vectors.T
        assert (lower <= true).all() and (lower + split @ slack.T >= true).all()


def test_pages_of_unseen_layouts():
    rng = random.Random(12345)
    pages = [html_text.generate(rng) for _ in range(200)]
    got = html_text.extract([p for p, _ in pages], html_text.model())
    assert np.mean([g == m for g, (_, m) in zip(got, pages, strict=True)]) >= 0.97


def test_pages_table(spark, sf):
    import html
    import re

    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    for r in QUERIES["op9_html_main_text"](spark, sf).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Some words stand here, and they stay.</p></article>"), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "</p></div><!-- open"), (6, "u", "&amp;&lt;" * 20000)]
    df = spark.createDataFrame([(h, "x", p, u, 3) for p, u, h in rows], "html string, text string, page_id long, url string, n_chars int")
    got = html_text.main_text(df).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id in (1, 2, 5)] == ["", "", ""] and [r.text for r in got if r.page_id is None] == ["Some words stand here, and they stay."]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_share_of_like_siblings_in_long_parents():
    nodes = html_text.parse("<body>" + "<p>text</p>" * 64 + "<div>advert</div></body>")
    at = next(i for i, n in enumerate(nodes) if n.tag == "div")
    assert html_text.features(nodes)[at, 3] == np.float32(1 / 65)


@pytest.mark.parametrize("tag", ["<svg width='1'/>", "<math/>", "<button>", "<video src='x'>"])
def test_text_after_elements_without_an_end(tag):
    nodes = html_text.parse(f"<body><p>before</p>{tag}<p>after</p></body>")
    assert [t for n in nodes if n.tag == "p" for _, t in n.texts] == ["before", "after"]


def test_attribute_tokens_are_learned():
    tokens = html_text.model().tokens
    assert min(tokens[html_text.bucket(w)] for w in ("content", "story", "prose")) > 0 > max(tokens[html_text.bucket(w)] for w in ("sidebar", "cookie", "related"))
    assert tokens[html_text.bucket("qqqq")] == 0  # never seen: says nothing


def test_contracted_edges_keep_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1300)]
    from panelflow.llm.common import components

    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    whole = {r.node: r.component for r in components(df).collect()}
    assert {r.node: r.component for r in components(neighbours._contracted(df)).collect()} == whole


def test_members_of_a_round(spark):
    rows = [(1, 2, 0.99, 4), (2, 3, 0.95, 3), (5, 6, 0.3, 4), (7, 8, neighbours.JOIN, 4), (9, 10, neighbours.JOIN, 2), (-1, 1, neighbours.FOUND, 4), (11, 1, 0.2, 2)]
    lists = spark.createDataFrame(rows, "u long, v long, sim double, turn int")
    got = sorted(map(tuple, neighbours._round(lists, 5, 0.98).collect()))
    # new and close: 1, 2, 7 and 8; 3 met nobody new, 5 and 6 nobody close, and a probe that was met is no neighbour
    assert got == [(1, 1), (1, 2), (1, 11), (2, 1), (2, 2), (2, 3), (7, 7), (7, 8), (8, 7), (8, 8)]


def test_first_members_are_made_once(spark, monkeypatch):
    made = []
    stored = neighbours.Stored
    monkeypatch.setattr(neighbours, "Stored", lambda df, name: made.append((name, df.columns)) or stored(df, name))
    rng = np.random.default_rng(8)
    rows = [(i, 1, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    assert neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).count() == 200
    assert made.count(("members", ["centre", "rep"])) >= 1

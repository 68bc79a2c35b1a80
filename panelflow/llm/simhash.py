"""SimHash near-duplicates, linked exactly through a vantage-point tree (operator 4).

A document's fingerprint is the bitwise majority of the XXH64 of its word shingles. Distinct
fingerprints are dealt to shards by a vantage-point tree under Hamming distance: an inner node
holds a vantage point and a radius; a fingerprint is owned by one side and, by the triangle
inequality, visits the other side too when its distance lies within ``bits`` of the radius. Each
shard searches its own smaller tree in the same way and returns a spanning forest of its links,
never all pairs, and distributed union-find joins the forests.

Defined cases: a null text counts as empty; no words give fingerprint zero, which links like any
other; repeated rows stay rows of their own; other columns are not read; an empty table gives an
empty result; a null doc_id keeps its row and never names a component that has another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, bounded, components

#: Fingerprints that one shard owns; and how many sampled ones choose the vantage points of a shard.
SHARD_ROWS = 1 << 16
SAMPLE_PER_SHARD, SAMPLE_MOST = 256, 1 << 17
LEAF = 256


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n < width:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.empty(n, np.int64)
        starts[0], starts[1:] = 0, ends[:-1] + 1
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return majority(hashes)


def majority(hashes: list[int]) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # blocks bound the memory of very long texts
        h = np.array(hashes[at : at + (1 << 15)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _mark() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp, mark)`` for each row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64()), batch.column(2)], ["doc_id", "fp", "mark"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _mark().alias("mark")).mapInArrow(run, "doc_id long, fp long, mark long")


# --- vantage-point tree ------------------------------------------------------


def _far(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the median distance from it; None if no ring divides the points."""
    for pick in (0, len(points) // 3, len(points) // 2):
        d = _far(points, points[pick])
        radius = int(np.median(d))
        inside = int((d <= radius).sum())
        if 0 < inside < len(points):
            return points[pick], radius
    return None


def build_tree(sample: np.ndarray, depth: int) -> list:
    """Nested ``[point, radius, inside, outside]``; a leaf is its shard's number."""
    shards = iter(range(1 << (depth + 1)))

    def grow(points: np.ndarray, left: int):
        cut = _split(points) if left and len(points) > 8 else None
        if cut is None:
            return next(shards)
        d = _far(points, cut[0])
        return [int(cut[0]), cut[1], grow(points[d <= cut[1]], left - 1), grow(points[d > cut[1]], left - 1)]

    return grow(np.asarray(sample, np.uint64), depth)


def route(tree, fps: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard reached: its number, the positions that visit it, and which of them it owns."""

    def walk(node, at: np.ndarray, own: np.ndarray):
        if not len(at):
            return
        if isinstance(node, int):
            yield node, at, own
            return
        d = _far(fps[at], np.uint64(node[0])).astype(np.int64)
        inside, outside = d <= node[1] + bits, d > node[1] - bits
        yield from walk(node[2], at[inside], (own & (d <= node[1]))[inside])
        yield from walk(node[3], at[outside], (own & (d > node[1]))[outside])

    yield from walk(tree, np.arange(len(fps)), np.ones(len(fps), bool))


class Forest:
    """Union-find over positions 0..n-1, fed with blocks of pairs; labels are smallest positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            s = self.up[r]
            if np.array_equal(r, s):
                return r
            r = s

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            todo = ra != rb
            a, b, ra, rb = a[todo], b[todo], ra[todo], rb[todo]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def search(fps: np.ndarray, own: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the pairs within ``bits`` with at least one owned end."""
    forest = Forest(len(fps))

    def brute(p: np.ndarray, q: np.ndarray) -> None:
        for i in range(0, len(p), LEAF):
            block = p[i : i + LEAF]
            for k in range(0, len(q), 4096):
                part = q[k : k + 4096]
                near = np.bitwise_count(fps[block][:, None] ^ fps[part][None, :]) <= bits
                x, y = np.nonzero(near)
                x, y = block[x], part[y]
                new = x != y
                forest.link(x[new], y[new])

    todo = [(np.flatnonzero(own), np.arange(len(fps)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        cut = _split(fps[p]) if len(p) > LEAF else None
        if cut is None:
            brute(p, q)
            continue
        dp, dq = _far(fps[p], cut[0]).astype(np.int64), _far(fps[q], cut[0]).astype(np.int64)
        todo.append((p[dp <= cut[1]], q[dq <= cut[1] + bits]))
        todo.append((p[dp > cut[1]], q[dq > cut[1] - bits]))
    root = forest.roots(np.arange(len(fps)))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    signed = fps.view(np.int64)
    return list(zip(signed[moved].tolist(), signed[root[moved]].tolist(), strict=True))


def links(fps: DataFrame, bits: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``fps(fp long)``, distinct, to forest edges ``(a, b)`` over pairs within ``bits`` bits.

    The tree is fitted on a bounded sample (``SAMPLE_PER_SHARD`` a shard, ``SAMPLE_MOST`` at most);
    every fingerprint is routed through it and every shard is searched in full, so the pairs are
    exact whatever the sample.
    """
    n = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard_rows))))
    most = min(SAMPLE_MOST, SAMPLE_PER_SHARD << depth)
    sample = [r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(most).collect()] if depth else []
    tree = build_tree(np.array(sample, np.int64).view(np.uint64), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for shard, at, mine in route(tree, own, bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(own[at].view(np.int64)), pa.array(mine)], ["shard", "fp", "own"])

    def find(shard: pa.Table) -> pa.Table:
        found = search(shard["fp"].to_numpy().view(np.uint64), shard["own"].to_numpy(), bits)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return fps.select("fp").mapInArrow(deal, "shard int, fp long, own boolean").groupBy("shard").applyInArrow(find, "a long, b long")


def _classes(docs: DataFrame, bits: int, width: int, shard_rows: int) -> DataFrame:
    """``doc_id, mark, fp, label, component_id`` of each row; ``mark`` is a digest of its text, ``label``
    one number a component."""
    marks = Stored(fingerprints(docs, width), "simhash").df
    firsts = Stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps").df
    labels = components(links(firsts.select("fp"), bits, shard_rows)).withColumnRenamed("node", "fp")
    named = firsts.join(labels, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = Stored(named.join(least, "label").select("fp", "label", "component_id"), "classes").df
    return marks.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, bits: int = 3, width: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits)``, component_id``."""
    return _classes(docs, bits, width, shard_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, bits: int = 3, width: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row of the document with the smallest id.

    Of different texts under that id the one with the least digest stays; of equal rows one; a null
    doc_id stays where its component has no other id.
    """
    first = _classes(docs, bits, width, shard_rows).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    texts = first.groupBy("label", F.col("doc_id").alias("_id"), "mark").agg(F.count("*").alias("_rows"))
    heads = texts.groupBy("label").agg(F.min(F.struct("mark", "_id", "_rows")).alias("head")).select("head.*")
    keep = Stored(heads.withColumnRenamed("mark", "_mark"), "kept")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc_id"), _mark().alias("_text_mark"))
    stays = rows.join(keep.small(), F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_mark") == F.col("_mark")))
    one = stays.where("_rows = 1").select("_row.*")
    if keep.df.where("_rows > 1").isEmpty():
        return one
    return one.unionByName(stays.where("_rows > 1").groupBy("_id", "_mark").agg(F.first("_row").alias("_row")).select("_row.*"))

"""Fuzzy line dedup by MinHash (operator 1).

Equal lines are collapsed by digest. Every distinct line gets a signature of minima of hashed
character shingles (``WIDTH`` characters); bands of the signature deal it to buckets. In a bucket
every line is compared with the bucket's first one; buckets whose lines are not all connected by
then are compared in blocks of ``BLOCK`` lines, skipping pairs that are connected by then, which changes no
component. A pair counts only with a Jaccard similarity of at least ``THRESHOLD`` over the exact
shingle sets. Distributed union-find joins the pairs, and of each component the line that stands
first (by doc_id, then line number) stays.

``BANDS`` of ``ROWS`` minima find a pair at similarity 0.8 with probability 0.98, at 0.85 with
0.997, at 0.9 with more than 0.9999.

Defined cases: blank lines (white space only) are never compared and stay; a line shorter than a
shingle equals only its copies; a null text has one blank line; of rows
that repeat a doc_id each keeps the lines that are its own, and equal lines at the same place of
them stay or go together; a null doc_id stands before all others; other columns
pass through ``deduplicated`` untouched but for ``n_chars``, which follows the text; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, bounded, by_group, components

WIDTH, BANDS, ROWS, THRESHOLD = 8, 10, 5, 0.8
#: Lines compared at once with a first line, and with one another; lines of a bucket whose pairs are listed.
CHUNK, BLOCK, SMALL = 256, 256, 16
SEED = 29
BLANK = " \t\r\f\v"
_NOT_BLANK = r"[^ \t\r\f\x0B]"

_rng = np.random.default_rng(SEED)
_A = (_rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """32-bit hashes of all windows of ``WIDTH`` code points, by doubling a polynomial hash."""
    with np.errstate(over="ignore"):
        h, n, p = codes.astype(np.uint64), 1, _P
        while n < WIDTH:
            h = h[:-n] * p + h[n:]
            p, n = p * p, 2 * n
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def band_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """``BANDS`` keys for each run ``starts[i]:ends[i]`` of hashes; runs are disjoint and in order."""
    mins = np.empty((BANDS * ROWS, len(starts)), np.uint32)
    room, at = np.empty(0, np.uint32), 0
    while at < len(starts):  # blocks that fit the cache
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, side="right")))
        lo, hi = starts[at], ends[to - 1]
        piece = hashes[lo:hi]
        room = room if len(room) >= len(piece) else np.empty(len(piece), np.uint32)
        mixed = room[: len(piece)]
        cuts = np.empty(2 * (to - at), np.int64)
        cuts[::2], cuts[1::2] = starts[at:to] - lo, ends[at:to] - lo
        cuts = cuts[:-1]  # the last run ends with the piece
        for k in range(len(_A)):
            np.multiply(piece, _A[k], out=mixed)
            np.add(mixed, _B[k], out=mixed)
            mins[k, at:to] = np.minimum.reduceat(mixed, cuts)[::2]
        at = to
    out = np.empty((len(starts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            h = np.full(len(starts), np.uint64(b + 1) * _P)
            for m in mins[b * ROWS : (b + 1) * ROWS]:
                h = (h ^ m) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            out[:, b] = h
    return out


#: A line's place as one number, doc_id before line number and null before all ids.
_PLACES = 1 << 31


def _place() -> F.Column:
    # long arithmetic wherever it holds the number, which is far cheaper; the decimal says the same
    wide = f"(coalesce(cast(doc_id as decimal(20,0)), -9223372036854775809) * {_PLACES} + line_no)"
    return F.expr(f"if(doc_id between {-_PLACES} and {_PLACES - 1}, cast(doc_id * {_PLACES}L + line_no as decimal(38,0)), cast({wide} as decimal(38,0)))")


def _from_place(place: str) -> list[F.Column]:
    fits = f"{place} between {-(_PLACES**2)} and {_PLACES**2 - 1}"
    whole = f"(({place} - pmod({place}, {_PLACES})) / {_PLACES})"
    return [
        F.expr(f"if({fits}, shiftright(cast({place} as bigint), 31), if({whole} < -9223372036854775808, null, cast({whole} as bigint)))"),
        F.expr(f"if({fits}, cast(cast({place} as bigint) & {_PLACES - 1} as int), cast(pmod({place}, {_PLACES}) as int))"),
    ]


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, k1, k2`` (digest) ``, b0, b1, ..`` (band keys, null for lines without) of
    the lines that are not blank."""
    bands = [f"b{b}" for b in range(BANDS)]
    names = ["doc_id", "line_no", "k1", "k2", *bands]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part: list[tuple] = []
            chars = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part.append((doc_id, text or ""))
                chars += len(part[-1][1])
                if chars > 1 << 19:
                    yield block(part)
                    part, chars = [], 0
            if part:
                yield block(part)

    def block(part: list[tuple]) -> pa.RecordBatch:
        ids, numbers, lines = [], [], []
        for doc_id, text in part:
            for no, line in enumerate(text.split("\n")):
                if line.strip(BLANK):
                    ids.append(doc_id)
                    numbers.append(no)
                    lines.append(line)
        raw = [line.encode() for line in lines]
        keys = [[xxhash.xxh64_intdigest(mark + r, 42) for r in raw] for mark in (b"", b"\x01")]
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        ends = np.cumsum(sizes)
        codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
        long = sizes >= WIDTH
        got = np.zeros((len(lines), BANDS), np.int64)
        if long.any():
            got[long] = band_keys(shingle_hashes(codes), (ends - sizes)[long], ends[long] - WIDTH + 1).view(np.int64)
        columns = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), *(pa.array(np.array(k, np.uint64).view(np.int64)) for k in keys)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(got[:, b], mask=~long) for b in range(BANDS))], names)

    schema = "doc_id long, line_no int, " + ", ".join(f"{n} long" for n in names[2:])
    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def spread(distinct: DataFrame) -> DataFrame:
    """``(bucket, uid)`` for each band of each line."""
    return distinct.where("b0 is not null").select("uid", F.explode(F.array(*[f"b{b}" for b in range(BANDS)])).alias("bucket"))


def _packed(raw: bytes) -> np.ndarray:
    """All windows of eight bytes as 64-bit numbers, mixed by steps that can be undone: equal numbers are equal windows."""
    x = np.ndarray((len(raw) - WIDTH + 1,), "<u8", raw, strides=(1,)) * _P
    return x ^ (x >> np.uint64(32))


def shingles(line: str) -> frozenset:
    """The exact set of shingles; one of eight characters below 256 is a number, which is cheaper than a text."""
    if len(line) < WIDTH:
        return frozenset([line])
    try:
        return frozenset(_packed(line.encode("latin-1")).tolist())
    except UnicodeEncodeError:
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = np.lib.stride_tricks.sliding_window_view(codes > 255, WIDTH).any(axis=1)
        return frozenset(_packed(codes.astype(np.uint8).tobytes())[~wide].tolist() + [line[i : i + WIDTH] for i in np.flatnonzero(wide).tolist()])


def similar(a: frozenset, b: frozenset, threshold: float = THRESHOLD) -> bool:
    """Exact Jaccard similarity of at least the threshold."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= threshold * (len(a) + len(b) - both)


def _compare_first(t: dict[str, list]) -> dict | None:
    ids, first, lines = t["uid"], t["first"][0], t["line"]
    if first not in ids or len(ids) < 2:
        return None
    lead = shingles(lines[ids.index(first)])
    found = [i for i, line in zip(ids, lines, strict=True) if i != first and similar(shingles(line), lead)]
    return {"a": found, "b": [first] * len(found)} if found else None


def _compare_block(t: dict[str, list]) -> dict | None:
    ids, roots, own, lines = (t[c] for c in ("uid", "root", "own", "line"))
    i, j = t["i"][0], t["j"][0]
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, r in zip(ids, roots, strict=True):
        up[root(x)] = root(r)
    left = [k for k, b in enumerate(own) if b == i]
    right = np.array([k for k, b in enumerate(own) if b == j])
    if len({root(x) for x in ids}) == 1 or not len(right):
        return None
    sets = [shingles(line) for line in lines]
    sizes = np.array([len(x) for x in sets])
    # shingles counted by 512 hash classes: no two sets can share more than the classes' smaller counts
    counts = np.stack([np.bincount(np.fromiter(map(hash, x), np.int64, len(x)) & 511, minlength=512) for x in sets]).astype(np.uint16)
    rights = counts[right]
    found = []
    for p in left:
        most = np.minimum(counts[p], rights).sum(axis=1, dtype=np.int64)
        for q in right[most >= THRESHOLD * (sizes[p] + sizes[right] - most)].tolist():
            if p != q and root(ids[p]) != root(ids[q]) and similar(sets[p], sets[q]):
                up[root(ids[p])] = root(ids[q])
                found.append((ids[p], ids[q]))
    return {"a": [a for a, _ in found], "b": [b for _, b in found]} if found else None


def _lines(docs: DataFrame, *more: F.Column) -> DataFrame:
    """``doc_id, line_no, line, k1, k2`` of every line; the digests of blank lines are null."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("line_no", "line"))
    digest = {"k1": F.xxhash64("line"), "k2": F.xxhash64(F.concat(F.lit("\u0001"), F.col("line")))}
    return cut.withColumns({k: F.when(F.col("line").rlike(_NOT_BLANK), d) for k, d in digest.items()})


def _mark() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``(first, uid)`` that are similar, ``CHUNK`` lines at once with a first one."""
    sized = pairs.groupBy("first").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(sized, "first").select("first", F.expr("pmod(xxhash64(uid), chunks)").alias("chunk"), "uid")
    leads = sized.select("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("first").alias("uid"))
    return by_group(dealt.unionByName(leads).join(texts, "uid"), ["first", "chunk"], _compare_first, "a long, b long", lists=True)


def _links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Verified pairs ``(a, b)`` of distinct lines that hold the components together."""
    buckets = spread(distinct)
    shared = buckets.groupBy("bucket").agg(F.min("uid").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = Stored(buckets.join(shared, "bucket"), "members").df
    pairs = members.where("uid <> first").select("uid", "first").distinct()
    wanted = members.select("uid").distinct().join(distinct.select("uid", "place", "k1", "k2"), "uid")
    wanted = Stored(wanted.select("uid", F.col("k1").alias("w1"), F.col("k2").alias("w2"), *[c.alias(n) for c, n in zip(_from_place("place"), ("w_id", "w_no"), strict=True)]), "wanted_lines")
    # by place, which no line shares, and by digest, as rows that repeat an id share places
    at = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("line_no") == F.col("w_no"))
    source = _lines(docs).join(wanted.small(), at & (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")))
    texts = Stored(source.select("uid", "line").dropDuplicates(["uid"]), "line_texts").df

    near = _verified(pairs, texts)
    near = Stored(near, "near_first").df

    # buckets whose lines are not all connected by then; of those with the same lines, one
    labels = components(near).withColumnRenamed("node", "uid").withColumnRenamed("component", "root")
    state = members.select("bucket", "uid").join(labels, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    open_ = state.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("mark"), F.sum(F.hash("uid").cast("long")).alias("mark2"))
    open_ = open_.where("low <> high").groupBy("n", "mark", "mark2").agg(F.min("bucket").alias("bucket"))
    # small buckets: their pairs, each once however many buckets share it
    few = state.join(open_.where(F.col("n") <= SMALL).select("bucket"), "bucket")
    pairs = few.select("bucket", F.col("uid").alias("first"), F.col("root").alias("_root")).join(few, "bucket").where("first < uid and root <> _root").select("first", "uid").distinct()
    close = _verified(pairs, texts)
    # large ones: in blocks
    blocks = open_.where(F.col("n") > SMALL).select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rows = state.join(blocks, "bucket").select("bucket", "blocks", "uid", "root", F.expr("pmod(xxhash64(uid, 3), blocks)").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "uid", "root").join(texts, "uid")
    rest = by_group(rows, ["bucket", "i", "j"], _compare_block, "a long, b long", lists=True)
    return near.unionByName(close).unionByName(rest)


#: A line that makes up more than this share of all lines is named from a broadcast list, which has no more entries than that.
HOT_SHARE = 4096


def _named(docs: DataFrame, *more: F.Column) -> DataFrame:
    """``doc_id, line_no, rep_doc_id, rep_line_no, kept`` of every line, and what else is asked for."""
    distinct = sign(docs).withColumn("place", _place()).groupBy("k1", "k2").agg(F.min("place").alias("place"), F.count("*").alias("n"), *[F.first(f"b{b}").alias(f"b{b}") for b in range(BANDS)])
    distinct = Stored(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct_lines").df
    labels = components(_links(docs, distinct))
    classed = labels.withColumnRenamed("node", "uid").join(distinct.select("uid", "k1", "k2", "place"), "uid")
    heads = classed.groupBy("component").agg(F.min(F.struct("place", "k1", "k2")).alias("head"))
    heads = Stored(classed.join(heads, "component").select("k1", "k2", "head"), "line_heads").df
    known = distinct.select("k1", "k2", "place", "n").join(heads, ["k1", "k2"], "left")
    named = known.select("k1", "k2", "n", F.coalesce("head.place", "place").alias("place"), (F.col("head").isNull() | ((F.col("head.k1") == F.col("k1")) & (F.col("head.k2") == F.col("k2")))).alias("heads"))
    named = named.select("k1", "k2", "n", "heads", *[c.alias(n) for c, n in zip(_from_place("place"), ("rep_doc_id", "rep_line_no"), strict=True)])
    named = Stored(named, "named_lines").df
    total = named.agg(F.sum("n")).first()[0] or 0
    # lines with a large share of all do not meet in one task: they and blank ones are dealt by their place
    hot = F.broadcast(named.where(F.col("n") * HOT_SHARE > total).select("k1", "k2", F.struct("heads", "rep_doc_id", "rep_line_no").alias("hot")))
    lines = _lines(docs, *more).drop("line").join(hot, ["k1", "k2"], "left")
    dealt = F.col("hot").isNotNull() | F.col("k1").isNull()
    lines = lines.withColumns({"j1": F.when(dealt, F.xxhash64("doc_id", "line_no")).otherwise(F.col("k1")), "j2": F.when(~dealt, F.col("k2"))})
    cold = named.where(F.col("n") * HOT_SHARE <= total).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.struct("heads", "rep_doc_id", "rep_line_no").alias("cold"))
    joined = lines.join(cold, ["j1", "j2"], "left").withColumn("rep", F.coalesce("hot", "cold"))
    blank = F.col("k1").isNull()
    joined = joined.withColumns({"rep_doc_id": F.when(blank, F.col("doc_id")).otherwise(F.col("rep.rep_doc_id")), "rep_line_no": F.when(blank, F.col("line_no")).otherwise(F.col("rep.rep_line_no"))})
    kept = blank | (F.col("rep.heads") & F.col("doc_id").eqNullSafe(F.col("rep_doc_id")) & (F.col("line_no") == F.col("rep_line_no")))
    return joined.withColumn("kept", kept)


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, rep_doc_id, rep_line_no, kept`` of every line; blank lines represent themselves."""
    return _named(docs).select("doc_id", "line_no", "rep_doc_id", "rep_line_no", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; rows that lose all their lines go."""
    # a row is known by its id and its text
    gone = _named(docs, _mark().alias("mark")).where("not kept").groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set("line_no").alias("_gone"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc_id"), _mark().alias("_text_mark"))
    joined = rows.join(gone, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_mark") == F.col("_mark")), "left")
    whole, names = F.col("_row.text"), docs.columns
    left = F.filter(F.split(whole, "\n"), lambda line, i: ~F.array_contains("_gone", i))
    out = joined.withColumn("_text", F.when(F.col("_gone").isNull(), whole).otherwise(F.array_join(left, "\n")))
    out = out.where(F.col("_gone").isNull() | F.col("_text").rlike(_NOT_BLANK.replace("\\t", "\\t\\n")))

    def column(c: str) -> F.Column:
        old = F.col(f"_row.`{c}`")
        if c == "text":
            return F.col("_text").cast(docs.schema[c].dataType).alias(c)
        return F.when(F.col("_gone").isNull(), old).otherwise(F.length("_text").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else old.alias(c)

    return out.select(*map(column, names))

"""Embedding near-duplicates by NN-descent (operator 6).

Equal vectors are collapsed first. A pass starts with neighbours that fall into one bucket of random
planes (as many planes as leave ``BUCKET`` vectors a bucket, fresh ones in each pass) and with
arbitrary ones. Each round then compares, at every vector whose list changed, those that list it or
that it lists with one another (neighbours of neighbours) and keeps the best ``k`` of each, until few
of the edges at the threshold are new. Every pair compared that reaches the threshold joins two components at once,
whatever the lists keep. After a pass, neighbours within one component leave the lists: a list that
was full of links thus has ``k`` places for vectors beyond them, and another pass fills these, until
no list is full of links or nothing is joined any more.

Recall is audited after each pass, in two ways: ``PROBES`` planted vectors, each just above the
threshold from a vector of the table, take part and must be found, so that sparse tables are measured
too; and the links of ``AUDIT`` sampled vectors, half of them from components, are counted by brute
force. Below ``TARGET`` another pass follows; after ``PASSES`` of them a sweep compares all pairs of a
label in exact blocks instead. Links are counted in full, in exact blocks of each component.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite components, and
rows with a null label, link with nothing (their component is their own id); only vectors of equal
length link; equal vectors of one label are linked to one another; repeated rows are vectors of
their own; rows with a null id stay, link with nothing and are kept; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, by_group, components
from .common import contracted as _contracted

K, TABLES, BUCKET = 6, 6, 32
#: Members of one neighbourhood or bucket that are compared in one block; share of new edges at the threshold that ends the rounds.
CHUNK, FEW = 48, 0.1
PROBES, AUDIT, TARGET, PASSES = 256, 256, 0.98, 4
#: Rounds are held where a neighbour lies within this of the threshold; the audit tells whether that is enough.
REACH = 0.1
#: How far above the threshold a probe lies, as a share of what is left to 1.
PROBE_MARGIN = 0.1
#: Values of an exact block at most, its rows while a group has under SPLIT blocks, and similarities held at once.
BLOCK_VALUES, BLOCK, SPLIT, TILE = 4_000_000, 1024, 6, 4_000_000
#: How the rows that blocks return are told apart from similarities: joins of vectors, and of a probe with a vector.
JOIN, FOUND = 3.0, 4.0


def _matrix(column) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def _unit(column) -> np.ndarray:
    m = _matrix(column)
    top = np.abs(m).max(axis=1, keepdims=True)
    m = m / top  # keeps squares of very large or small components finite
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _usable() -> F.Column:
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda c: c != 0), F.lit(False))


def _probes(reps: DataFrame, threshold: float, seed: int) -> DataFrame:
    """Planted vectors: ``rep`` is negative and names the vector (``-1 - rep``) that it lies close to."""
    cosine = threshold + PROBE_MARGIN * (1 - threshold)

    def turn(batches):
        for batch in batches:
            ids, made = batch.column(0).to_pylist(), []
            for i, x in zip(ids, batch.column(3).to_pylist(), strict=True):
                rng = np.random.default_rng((seed, i))
                x = np.array(x) / np.abs(x).max()
                x /= np.linalg.norm(x)
                y = rng.normal(size=len(x))
                y -= (y @ x) * x
                made.append((cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([-1 - i for i in ids], pa.int64()), batch.column(1), batch.column(2), pa.array(made, pa.list_(pa.float64()))], ["rep", "label", "dims", "embedding"])

    some = reps.where("dims > 1").orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(PROBES)
    return some.select("rep", "label", "dims", "embedding").mapInArrow(turn, "rep long, label long, dims int, embedding array<double>")


def _arrays(t: pa.Table) -> dict[str, np.ndarray]:
    """Numbers and unit vectors of many groups; shorter vectors are filled with zeros, which changes no product."""
    x = t["embedding"].combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    dims = np.diff(x.offsets.to_numpy())
    unit = np.zeros((len(x), int(dims.max())))
    for d in np.unique(dims):
        unit[dims == d, :d] = _unit(x.filter(pa.array(dims == d)))
    return {"unit": unit} | {c: t[c].to_numpy() for c in ("rep", "part", "bar")}


def _compare(k: int, threshold: float):
    """Of the vectors of one block: the best pairs of each beyond its own component and above its
    ``bar``, and a spanning forest of the pairs at the threshold."""

    def compare(t: dict[str, np.ndarray]) -> dict | None:
        ids, part, bars, unit = t["rep"], t["part"], t["bar"], t["unit"]
        n = len(ids)
        if n < 2:
            return None
        sims = unit @ unit.T
        np.fill_diagonal(sims, -3)
        near, real = sims >= threshold, ids >= 0
        near &= real[None, :]
        root = np.arange(n)
        while near.any():  # of linked vectors the smallest position
            low = np.minimum(root, np.where(near & real[:, None], root[None, :], n).min(axis=1))
            if np.array_equal(low, root):
                break
            root = low
        joined = np.flatnonzero(part != part[root])
        met = np.flatnonzero(~real & near.any(axis=1))
        sims[part[:, None] == part[None, :]] = -3
        best = np.argpartition(-sims, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)]
        a, b = np.repeat(np.arange(n), best.shape[1]), best.ravel()
        good = sims[a, b] > bars[a]
        return {
            "u": np.concatenate([ids[a[good]], ids[joined], ids[met]]),
            "v": np.concatenate([ids[b[good]], ids[root[joined]], ids[near[met].argmax(axis=1)]]),
            "sim": np.concatenate([sims[a[good], b[good]], np.full(len(joined), JOIN), np.full(len(met), FOUND)]),
        }

    return compare


def _blocks(members: DataFrame, nodes: DataFrame, bars: DataFrame | None, k: int, threshold: float, turn: int) -> DataFrame:
    """``members(centre, rep)`` compared in blocks of some ``CHUNK``, however many a centre has."""
    size = members.groupBy("centre").agg(F.count("*").alias("n")).where("n > 1").select("centre", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    dealt = members.join(size, "centre").select("centre", F.expr(f"pmod(xxhash64(rep, {turn}), chunks)").alias("chunk"), "rep")
    vectors = nodes.select("rep", "part", "embedding")
    vectors = vectors.withColumn("bar", F.lit(-2.0)) if bars is None else vectors.join(bars, "rep", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0)))
    return by_group(dealt.join(vectors, "rep"), ["centre", "chunk"], _compare(k, threshold), "u long, v long, sim double", arrays=_arrays)


def _start(nodes: DataFrame, tables: int, turn: int, wanted: DataFrame | None = None) -> DataFrame:
    """First members ``(centre, rep)``: buckets of random planes, and arbitrary groups; only those with a vector of ``wanted``, if given."""
    sizes = nodes.groupBy("label", "dims").agg(F.count("*").alias("n")).withColumn("planes", F.expr(f"cast(greatest(0, ceil(log2(n / {BUCKET}))) as int)"))
    sized = nodes.join(sizes, ["label", "dims"])

    def sign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims, planes = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for d, p in set(zip(dims.tolist(), planes.tolist(), strict=True)):
                part = batch.filter(pa.array((dims == d) & (planes == p)))
                unit = _unit(part.column(4))
                for t in range(tables if p else 1):
                    normal = np.random.default_rng((d, turn, t)).normal(size=(d, p))
                    code = (unit @ normal > 0) @ (1 << np.arange(p, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.full(part.num_rows, t, np.int32)), pa.array(code.astype(np.int64))], ["rep", "label", "dims", "run", "code"])

    signed = sized.select("rep", "label", "dims", "planes", "embedding").mapInArrow(sign, "rep long, label long, dims int, run int, code long")
    arbitrary = sized.where("planes > 0").select("rep", "label", "dims", F.lit(-1).alias("run"), F.expr(f"pmod(xxhash64(rep, {turn}), cast(ceil(n / {BUCKET}) as bigint))").alias("code"))
    members = signed.unionByName(arbitrary).select(F.xxhash64("label", "dims", "run", "code").alias("centre"), "rep")
    if wanted is None:
        return members
    members = Stored(members, "members").df
    return members.join(members.join(wanted, "rep", "left_semi").select("centre").distinct(), "centre", "left_semi")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    once = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("turn").alias("turn"))
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return once.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _round(lists: DataFrame, turn: int, threshold: float) -> DataFrame:
    """Members ``(centre, rep)`` of a round: neighbours and joins at the vectors that met a new one in the last round and have a close one."""
    ends = F.array(*[F.struct(F.col(a).alias("centre"), F.col(b).alias("rep")) for a, b in ("uv", "vu")])
    both = lists.where(f"sim < {FOUND}").select(F.explode(ends).alias("e"), "sim", "turn").select("e.*", "sim", "turn")
    # joins stand above every similarity
    new = both.groupBy("centre").agg(F.max("turn").alias("last"), F.max("sim").alias("top"))
    new = new.where((F.col("last") == turn - 1) & (F.col("top") >= threshold - REACH)).select("centre")
    return both.select("centre", "rep").join(new, "centre", "left_semi").unionByName(new.select("centre", F.col("centre").alias("rep"))).distinct()


def _bars(lists: DataFrame, k: int) -> DataFrame:
    """The least similarity of each full list."""
    return lists.where("sim < 2").groupBy(F.col("u").alias("rep")).agg(F.count("*").alias("n"), F.min("sim").alias("low")).where(F.col("n") >= k).select("rep", F.col("low").alias("bar"))


def _audit(nodes: DataFrame, found: DataFrame, threshold: float, seed: int) -> float:
    """The lesser of the shares found of the probes and of the sampled vectors' links."""
    reps = nodes.where("rep >= 0")
    planted = nodes.where("rep < 0").select("rep", F.expr("-1 - rep").alias("origin"))
    n = planted.count()
    home = reps.select("rep", "part")
    met = found.select(F.col("u").alias("probe"), F.col("v").alias("rep")).join(home, "rep").select("probe", "part").distinct()
    hits = planted.join(home.toDF("origin", "home"), "origin").join(met, F.col("probe") == F.col("rep")).where("part = home").select("probe").distinct().count()
    linked = reps.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
    order = [F.xxhash64("rep", F.lit(seed + 1)), F.col("rep")]
    some = reps.join(linked, "part", "left_semi").orderBy(*order).limit(AUDIT // 2).unionByName(reps.orderBy(*order).limit(AUDIT // 2))
    sample = {r.rep: (r.label, r.dims, r.part, r.embedding) for r in some.select("rep", "label", "dims", "part", "embedding").collect()}
    kinds: dict[tuple, list[int]] = {}
    for i, (label, dims, _, _) in sample.items():
        kinds.setdefault((label, dims), []).append(i)

    def count(batches):
        for batch in batches:
            label, dims, all_, same = batch.column(1).to_numpy(), batch.column(2).to_numpy(), 0, 0
            for (of, d), ids in kinds.items():
                at = np.flatnonzero((label == of) & (dims == d))
                if not len(at):
                    continue
                mine = batch.take(pa.array(at))
                left = _unit(pa.array([sample[i][3] for i in ids], pa.list_(pa.float64())))
                near = left @ _unit(mine.column(4)).T >= threshold
                near &= np.array(ids)[:, None] != mine.column(0).to_numpy()[None, :]
                all_ += int(near.sum())
                same += int((near & (np.array([sample[i][2] for i in ids])[:, None] == mine.column(3).to_numpy()[None, :])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([all_], pa.int64()), pa.array([same], pa.int64())], ["links", "found"])

    seen = reps.select("rep", "label", "dims", "part", "embedding").mapInArrow(count, "links long, found long").agg(F.sum("links"), F.sum("found")).first()
    return min(hits / n if n else 1.0, seen[1] / seen[0] if seen[0] else 1.0)


def _exact(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Every pair of vectors that are equal in ``keys`` and in length, compared in exact blocks.

    ``a, b, linked``: of each vector (``b`` is -1) the copies linked to it, and the pairs of components
    that a link joins, one row a block and pair of components, however many links there are.
    """
    # a block holds a bounded number of values; small groups are cut as well, for parallel work
    sized = rows.groupBy(*keys, "dims").agg(F.count("*").alias("n")).where("n > 1")
    sized = sized.select(*keys, "dims", F.expr(f"greatest(ceil(n * dims / {BLOCK_VALUES}), least(ceil(n / {BLOCK}), {SPLIT}))").alias("blocks"))
    own = rows.join(sized, [*keys, "dims"]).withColumn("own", F.expr("pmod(xxhash64(rep), blocks)"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        *keys, "dims", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", *({"part"} - set(keys)), "copies", "embedding"
    )

    def compare(t: pa.Table) -> dict:
        ids, part, copies, own_ = (t[c].to_numpy() for c in ("rep", "part", "copies", "own"))
        unit = _unit(t["embedding"])
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        a, b = np.flatnonzero(own_ == i), np.flatnonzero(own_ == j)
        linked = np.zeros(len(ids), np.int64)
        joined = [np.zeros((0, 2), np.int64)]
        right = unit[b].T
        step = max(1, TILE // max(1, len(b)))
        for at in range(0, len(a), step):
            rows_ = a[at : at + step]
            near = unit[rows_] @ right >= threshold
            if i == j:
                near[np.arange(len(rows_)), np.arange(at, at + len(rows_))] = False
            linked[rows_] += (near @ copies[b].astype(np.float64)).astype(np.int64)
            if i != j:
                linked[b] += (copies[rows_].astype(np.float64) @ near).astype(np.int64)
            if "part" not in keys:
                x, y = np.nonzero(near & (part[rows_][:, None] != part[b][None, :]))
                joined.append(np.unique(np.stack([part[rows_[x]], part[b[y]]], axis=1), axis=0))
        ends = np.unique(np.concatenate(joined), axis=0)
        some = linked > 0
        return {
            "a": np.concatenate([ids[some], ends[:, 0]]),
            "b": np.concatenate([np.full(some.sum(), -1), ends[:, 1]]),
            "linked": np.concatenate([linked[some], np.zeros(len(ends), np.int64)]),
        }

    return by_group(dealt, [*keys, "dims", "i", "j"], compare, "a long, b long, linked long")


def _named(nodes: DataFrame, joins: DataFrame) -> DataFrame:
    """``nodes`` with the components that ``joins`` of their parts make."""
    ends = joins.select("u", "v").join(nodes.select(F.col("rep").alias("u"), F.col("part").alias("a")), "u").join(nodes.select(F.col("rep").alias("v"), F.col("part").alias("b")), "v")
    whole = components(_contracted(ends.select("a", "b"))).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    return nodes.join(whole, "part", "left").withColumn("part", F.coalesce("whole", "part")).drop("whole")


def joined(reps: DataFrame, threshold: float, k: int = K, tables: int = TABLES, passes: int = PASSES, target: float = TARGET) -> tuple[DataFrame, float]:
    """``reps(rep, label, dims, embedding, ..)`` with their component ``part``, and the recall audited last.

    ``passes`` bounds the passes before the exact sweep takes over; its recall is 1.
    """
    seed, turn, done = 0, 0, 0
    probes = _probes(reps, threshold, seed)
    columns = ["rep", "label", "dims", "embedding"]
    nodes = Stored(reps.select(*columns).unionByName(probes).withColumn("part", F.col("rep")), "nodes")
    lists, found, wanted = None, None, None
    while True:
        done += 1
        first = turn
        while True:
            # stored, as blocks read them twice: to count them and to deal them
            members = Stored(_start(nodes.df, tables, turn, wanted) if turn == first else _round(lists.df, turn, threshold), "members")
            new = _blocks(members.df, nodes.df, None if turn == first else _bars(lists.df, k), k, threshold, turn).withColumn("turn", F.lit(turn))
            pairs = new if lists is None else new.unionByName(lists.df)
            # joins and met probes are few and kept in full; of the others each vector keeps the best
            ends = pairs.where("sim >= 2").groupBy("u", "v", "sim").agg(F.min("turn").alias("turn"))
            after = Stored(_best(pairs.where("sim < 2"), k).unionByName(ends), "lists")
            members.drop()
            if lists is not None:
                lists.drop()
            lists, turn = after, turn + 1
            # of what the lists hold; joins name one component in many ways and say nothing here
            edges, fresh = lists.df.where(f"sim >= {threshold} AND sim < 2").agg(F.count("*"), F.count_if(F.col("turn") == turn - 1)).first()
            if fresh <= FEW * edges:
                break
        met = lists.df.where(f"sim = {FOUND}").select("u", "v")
        found = Stored(met if found is None else met.unionByName(found.df).distinct(), "found")
        full = Stored(lists.df.where("sim < 2").groupBy(F.col("u").alias("rep")).agg(F.count("*").alias("n"), F.min("sim").alias("low")).where((F.col("n") >= k) & (F.col("low") >= threshold)).select("rep"), "full").df
        joins = lists.df.where(f"sim = {JOIN}").select("u", "v")
        some = not joins.isEmpty()
        if some:
            nodes, before = Stored(_named(nodes.df, joins), "nodes"), nodes
            before.drop()
        recall = _audit(nodes.df, found.df, threshold, seed + done)
        if recall >= target and (not some or full.isEmpty()):
            break
        # only full lists need another look, unless too much was missed
        wanted = full if recall >= target else None
        if recall < target and done >= passes:
            ends = Stored(_exact(nodes.df.where("rep >= 0").withColumn("copies", F.lit(1)), ["label"], threshold), "swept").df
            whole = components(_contracted(ends.where("b >= 0").select("a", "b"))).select(F.col("node").alias("part"), F.col("component").alias("whole"))
            named = nodes.df.join(whole, "part", "left").withColumn("part", F.coalesce("whole", "part"))
            return reps.join(named.select("rep", "part"), "rep"), 1.0
        # neighbours of one component leave the lists
        part = nodes.df.select("rep", "part")
        apart = lists.df.where("sim < 2").join(part.toDF("u", "p"), "u").join(part.toDF("v", "q"), "v").where("p <> q").select("u", "v", "sim", "turn")
        lists, before = Stored(apart, "lists"), lists
        before.drop()
    return reps.join(nodes.df.select("rep", "part"), "rep"), recall


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, k: int = K, tables: int = TABLES, passes: int = PASSES, target: float = TARGET) -> DataFrame:
    """One row per row of ``embeddings``: ``vec_id, n_links, component_id, kept``."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = Stored(rows.withColumn("usable", _usable()), "vectors").df
    usable = rows.where("usable")
    reps = Stored(
        usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
        # one vec_id may name different vectors: nodes have numbers of their own
        .select(F.monotonically_increasing_id().alias("rep"), "first", "label", F.size("embedding").alias("dims"), "copies", "embedding"),
        "distinct_vectors",
    ).df
    parts = Stored(joined(reps, threshold, k, tables, passes, target)[0], "parts").df
    counts = Stored(_exact(parts, ["part"], threshold), "links").df.select(F.col("a").alias("rep"), "linked").groupBy("rep").agg(F.sum("linked").alias("linked"))
    first = parts.groupBy("part").agg(F.min("first").alias("component_id"))
    known = parts.join(first, "part").join(counts, "rep", "left").select("label", "embedding", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = usable.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

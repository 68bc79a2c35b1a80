"""What the corpus operators share: table access, shared storage, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte bound under which a side counts as small enough to broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of a batch that goes to a Python worker; Spark's own bound is rows alone, whatever their texts hold.
BATCH_BYTES = 4 << 20
#: Edges whose components one task finds, in some 100 MB; more are rewritten by all tasks.
LOCAL_EDGES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of the scale folder, pruned to ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def bounded(df: DataFrame) -> DataFrame:
    """``df``, for Arrow functions over whole texts: bounds the bytes of the session's batches, unless the user did.

    Rows are not cut: a batch ends with the row that reaches the bound.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


# --- shared storage ----------------------------------------------------------

_roots: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shared_root(spark: SparkSession) -> str:
    """A folder of this application on the storage that all machines share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset on one machine
    (tests) a temporary folder is taken; on a cluster that is an error, as its machines would each
    write to a folder of their own. It is removed when the interpreter ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            base = tempfile.mkdtemp(prefix="panelflow-")
        _roots[app] = f"{base.rstrip('/')}/panelflow-{uuid.uuid4().hex}"
        atexit.register(_quietly_delete, spark, _roots[app])
    return _roots[app]


def _quietly_delete(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may be gone at interpreter exit
        pass


class Stored:
    """A frame written to shared storage: lineage ends here, and its bytes are known."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_root(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def bytes(self) -> int:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(p).getLength()

    def drop(self) -> None:
        _delete(self.spark, self.path)

    def small(self, bound: int = BROADCAST_BYTES) -> DataFrame:
        """The frame, with a broadcast hint only when its stored size is within ``bound``."""
        return F.broadcast(self.df) if self.bytes() <= bound // 8 else self.df


def stored(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


# --- connected components ----------------------------------------------------


def contracted(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of each partition as stars around their smallest node: the same components, and few steps to them."""

    import numpy as np
    import pyarrow as pa

    def run(batches):
        got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if not got:
            return
        ids, at = np.unique(np.concatenate(got, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(ids))
        while True:
            before = root
            low = np.minimum(root[a], root[b])
            root = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if np.array_equal(root, before):
                break
        some = np.flatnonzero(root != np.arange(len(ids)))
        for part in range(0, len(some), 1 << 16):
            rows = some[part : part + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(ids[root[rows]])], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, local: int | None = None) -> DataFrame:
    """Distributed union-find: ``edges(a long, b long)`` to ``(node, component)``.

    ``component`` is the smallest node that can be reached. Alternates large-star and small-star
    (Kiveris et al., "Connected Components in MapReduce and Beyond"), which keeps every rewrite a
    pre-aggregated minimum plus an equi-join, so a hub's edges are split by the skew join. Each
    round is written to shared storage, so a lost executor repeats one round at most. As soon as no
    more than ``local`` edges (``LOCAL_EDGES``) are left, one task ends the work, which gives the same
    stars. Null ends and self-loops are ignored; nodes without another end do not appear.
    """
    local = LOCAL_EDGES if local is None else local
    now = Stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    mark = None
    while True:
        seen = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(seen) or not seen[0]:
            break
        if seen[0] <= local:
            stars = Stored(contracted(now.df.coalesce(1)).toDF("u", "v"), "edges")
            now.drop()
            now = stars
            break
        mark = tuple(seen)
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        foot = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(foot, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        after = Stored(small, "edges")
        now.drop()
        now = after
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


# --- groups in Arrow ---------------------------------------------------------


def by_group(df: DataFrame, keys: list[str], fn, schema: str, lists: bool = False, arrays=None) -> DataFrame:
    """Applies ``fn(table) -> dict of columns`` to each group of rows equal in ``keys``.

    The rows are dealt and sorted by the keys and streamed, so many small groups share a batch;
    callers keep each group within a bound of their own. With ``lists`` a group is a dict of lists,
    which is cheaper for groups of a few rows; with ``arrays(table) -> dict of arrays`` it is slices
    of arrays that are made for many groups at once.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        rest: list = []

        def emit(t: pa.Table):
            if t.num_rows == 0:
                return
            change = np.zeros(t.num_rows, bool)
            change[0] = True
            for k in keys:
                v = t[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            at = [*np.flatnonzero(change).tolist(), t.num_rows]
            if lists or arrays:
                whole = arrays(t) if arrays else {c: t[c].to_pylist() for c in t.column_names}
                made = [fn({c: v[a:b] for c, v in whole.items()}) for a, b in zip(at, at[1:])]
            else:
                made = [fn(t.slice(a, b - a)) for a, b in zip(at, at[1:])]
            made = [m for m in made if m is not None]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(m[f.name]) for m in made]), f.type) for f in out], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(batch.schema.get_field_index(k))[-1] for k in keys]
            same = np.ones(batch.num_rows, bool)
            for k, v in zip(keys, last):
                same &= batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) == v.as_py()
            first = int(np.argmax(same))  # rows from here on belong to the last group, which may go on
            if first:
                yield from emit(pa.Table.from_batches([*rest, batch.slice(0, first)]).combine_chunks())
                rest = []
            elif rest and any(rest[0].column(rest[0].schema.get_field_index(k))[0].as_py() != v.as_py() for k, v in zip(keys, last)):
                yield from emit(pa.Table.from_batches(rest).combine_chunks())
                rest = []
            rest.append(batch.slice(first))
        if rest:
            yield from emit(pa.Table.from_batches(rest).combine_chunks())

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)

"""Token ids in ORC files (operator 3).

Texts are dealt by ranges of doc_id and a hash of the text, sorted within each range, encoded, and
written as one ORC file a range: integer run-length encoding (version 2) for the ids, a row index
every ``ROW_INDEX_STRIDE`` rows, and a Bloom filter on ``doc_id``. Each row has its number in the file. The stripe size lets readers take
single stripes in parallel; the index and the filter let them skip all others for a given id.

Each distinct chunk without white space that a worker meets goes through the tokenizers library once: the
vocabulary's normaliser and pre-tokeniser never look across white space, so the ids of a text are
those of its chunks in turn.

Defined cases: a null text counts as empty and has the end id only; rows that repeat a doc_id
follow one another, ordered by a hash of their text, and may fill several files; a null doc_id comes first; other columns are not read; an
empty table writes no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, bounded, shared_root

END_ID = 1
STRIPE_BYTES, ROW_INDEX_STRIDE, BLOOM_FPP = 64 << 20, 1000, 0.01
#: Chunks remembered by a worker, and the longest one that is remembered.
REMEMBERED, REMEMBERED_CHARS = 600_000, 40
#: Bytes of text that are encoded at once.
PIECE_BYTES = 4 << 20


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and the offsets of each text in them; a null text is empty.

        Arrow cuts the texts at ASCII white space and numbers the distinct chunks, and numpy puts
        their ids in place.
        """
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        blobs = self._chunks(_strings(coded.dictionary))
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        at = coded.indices.to_numpy()
        lengths = sizes[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat(starts[at] - ends[:-1], lengths) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(blobs), np.uint32)[places]
        cuts = lists.offsets.to_numpy()
        return ids, ends[cuts - cuts[0]]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each distinct chunk."""
        if len(self.known) > REMEMBERED // 2:  # the older half goes; what is still in use moves over
            self.old, self.known = self.known, {"": b""}
        row = list(map(self.known.get, chunks))
        holes = [k for k, ids in enumerate(row) if ids is None]
        if holes:
            fresh = [chunks[k] for k in holes]
            ids = list(map(self.old.get, fresh))
            new = [k for k, x in enumerate(ids) if x is None]
            for k, x in zip(new, self._new([fresh[k] for k in new]), strict=True):
                ids[k] = x
            for k, x in zip(holes, ids, strict=True):
                row[k] = x
            self.known.update(zip(fresh, ids, strict=True))
            for c in fresh:
                if len(c) > REMEMBERED_CHARS:
                    del self.known[c]
        return row

    def _new(self, chunks: list[str]) -> list[bytes]:
        """A plain word with points or commas after it is that word, lower-cased, and then those: the
        vocabulary lower-cases, and its pre-tokeniser cuts between letters and points. All other
        chunks are encoded as they are."""
        every = pa.array(chunks, pa.string())
        plain = pc.match_substring_regex(every, "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]*$")
        out: list = [None] * len(chunks)
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist()
        for k, x in zip(other, self._each([chunks[k] for k in other]), strict=True):
            out[k] = x
        words = every.filter(plain)
        bare = pc.ascii_rtrim(words, ".,")
        cut = pc.utf8_length(bare).to_numpy().tolist()
        stems = pc.utf8_lower(bare).dictionary_encode()
        names = _strings(stems.dictionary)
        ids = list(map(self.stems.get, names))
        new = [k for k, x in enumerate(ids) if x is None]
        if new:
            if len(self.stems) > REMEMBERED // 2:
                self.stems = {}
            got = self._words([names[k] for k in new])
            for k, x in zip(new, got, strict=True):
                ids[k] = x
            self.stems.update(zip([names[k] for k in new], got, strict=True))
        tails: dict[str, bytes] = {"": b""}
        for k, stem, n in zip(np.flatnonzero(plain.to_numpy(zero_copy_only=False)).tolist(), stems.indices.to_pylist(), cut, strict=True):
            tail = chunks[k][n:]
            if tail not in tails:
                tails[tail] = self._each([tail])[0]
            out[k] = ids[stem] + tails[tail]
        return out

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of small letters: many in one text, cut where a token ends its word."""
        out: list[bytes] = []
        lots = [words[at : at + 100] for at in range(0, len(words), 100)]
        for lot, enc in zip(lots, self.tokenizer.encode_batch_fast([" ".join(lot) for lot in lots], add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, np.uint32)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            blob = ids.tobytes()
            # a vocabulary without marked word ends, or one that cuts words, is asked word by word
            out += [blob[a:b] for a, b in zip([0, *ends], ends)] if len(ends) == len(lot) else self._each(lot)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes ``(doc_id, shard, row, ids)`` to ORC files in ``folder``, ascending by doc_id over the files."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        row = 0
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            at = 0
            while at < batch.num_rows:  # pieces of bounded size
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE_BYTES, side="right")))
                part = batch.slice(at, to - at)
                ids, ends = e.encode(part.column(1))
                ids = np.insert(ids, ends[1:], end_id).astype(np.int32)
                ends = (ends + np.arange(len(ends))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arange(row, row + to - at)), pa.ListArray.from_arrays(ends, pa.array(ids))], ["doc_id", "row", "ids"])
                row, at = row + to - at, to

    (
        bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .withColumn("mark", F.xxhash64("text"))
        .repartitionByRange("doc_id", "mark")
        .sortWithinPartitions("doc_id", "mark")
        .mapInArrow(run, "doc_id long, row long, ids array<int>")
        .select("doc_id", F.spark_partition_id().alias("shard"), "row", "ids")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.create.index", "true")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.compress", "ZSTD")
        .orc(folder)
    )


def read(spark: SparkSession, folder: str, doc_id: int | None = None) -> DataFrame:
    """The rows of the files; with ``doc_id``, only stripes and row groups that may hold it."""
    df = spark.read.schema("doc_id long, shard int, row long, ids array<int>").orc(folder)
    return df if doc_id is None else df.where(F.col("doc_id") == doc_id)


def index(tokens: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each row read.

    The running start is taken in two levels: the totals of the files, of which there are few, and
    the rows of each file, which one writer made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            n = np.diff(ends)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "shard", "row", "n_tokens", "ids_crc32"])

    rows = tokens.select("doc_id", "shard", "row", "ids").mapInArrow(run, "doc_id long, shard int, row long, n_tokens long, ids_crc32 long")
    rows = Stored(rows, "token_rows").df
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total")).select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
        .join(totals, "shard")
        .select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
    )


def round_trip(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files and indexes what is read back from them."""
    spark = docs.sparkSession
    folder = folder or f"{shared_root(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write(docs, folder, path, end_id)
    return index(read(spark, folder))

"""Byte-level BPE by backtracking over Aho-Corasick matches, and decoding by offsets (operator 8).

Encoding a pre-token walks left to right and takes the longest token that starts at each place
(one Aho-Corasick pass finds them all). A choice stands only if the tokens on both sides of the
new boundary are compatible, which a table of merges tells: the merges that built the two tokens
must not have been pre-empted by a merge across the boundary. Otherwise the next shorter prefix
is tried, and when none is left, the last token is taken back. Places found to be dead ends are
marked, so the walk is linear and its result is that of applying the merges in order.

Decoding gathers token bytes through an offset table, without a loop over tokens.

Defined cases: a null text counts as empty (no ids, empty text); any text length works in memory
proportional to it; repeated rows are rows of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

#: Fixed pattern of byte-level pre-tokenisation.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered by a worker, and the longest one that is remembered.
REMEMBERED, REMEMBERED_CHARS = 600_000, 40


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: "".join(chr(alphabet[c]) for c in token)
        vocab: dict[str, int] = spec["model"]["vocab"]
        by_bytes = {raw(t): i for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.length = [0] * size
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.joined: dict[tuple[int, int], int] = {}
        self.rank = list(range(size))
        self.shorter = [-1] * size
        order = 0
        merged = set()
        for order, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.joined[a, b] = c
            if c not in merged:
                merged.add(c)
                self.halves[c] = (a, b)
                self.rank[c] = size + order
        self.automaton = ahocorasick.Automaton()
        for text, i in by_bytes.items():
            self.length[i] = len(text)
            self.automaton.add_word(text, (i, len(text)))
            self.shorter[i] = next((by_bytes[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in by_bytes), -1)
        self.automaton.make_automaton()
        blobs = [b""] * size
        for text, i in by_bytes.items():
            blobs[i] = text.encode("latin-1")
        for text, i in self.added.items():
            blobs[i] = text.encode()
        self.lengths = np.array([len(b) for b in blobs], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.names = [str(i) for i in range(size)]
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.known: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge across the boundary would have come before those inside a and b."""
        rank, halves, joined = self.rank, self.halves, self.joined
        bound = None  # rank of the merge that was undone last; a crossing merge must not precede it
        while True:
            c = joined.get((a, b))
            if c is not None and (bound is None or rank[c] < bound):
                return False
            # undo the later of the two merges that made the ends; on a tie the right one
            if rank[a] > rank[b]:
                whole, (_, half) = a, halves[a]
                if half != whole:
                    bound, a = rank[whole], half
                    continue
                whole, (half, _) = b, halves[b]
                if half == whole:
                    return True
                bound, b = rank[whole] + 1, half
            else:
                whole, (half, _) = b, halves[b]
                if half != whole:
                    bound, b = rank[whole] + 1, half
                    continue
                whole, (_, half) = a, halves[a]
                if half == whole:
                    return True
                bound, a = rank[whole], half

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token given as one character a byte."""
        n = len(word)
        best = [-1] * n
        reach = [0] * n
        for end, (token, size) in self.automaton.iter(word):
            at = end - size + 1
            if size > reach[at]:
                best[at], reach[at] = token, size
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)
        at, token = 0, best[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + self.length[token]
                if open_[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = best[at] if at < n else -1
                    break
                token = self.shorter[token]
                if token < 0:
                    open_[at] = 0
                    token = out.pop()
                    at -= self.length[token]
                    break
        return out

    def _piece(self, piece: str) -> bytes:
        ids = array("I", self.encode_word(piece.encode().decode("latin-1"))).tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        parts = self.cut(text) if self.cut else [text]
        known, piece, out = self.known, self._piece, []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(array("I", [self.added[part]]).tobytes())
            else:
                get = known.get
                out += [get(w) or piece(w) for w in self.find(part)]
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        at = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(total)
        return self.blob[at].tobytes().decode("utf-8", errors="replace")

    def listed(self, ids: np.ndarray) -> str:
        return ",".join(map(self.names.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _texts(docs: DataFrame) -> DataFrame:
    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` for each row of ``docs``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [pa.array(c.encode(t.as_py() or "").astype(np.int32)) for t in batch.column(1)]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), pa.concat_arrays(ids) if ids else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` for rows of ``(doc_id, ids)``; null ids give an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes, then decodes what was encoded; returns digests of both, in one pass over the texts."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, sha, back = [], [], []
            for t in batch.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids))
                sha.append(hashlib.sha256(c.listed(ids).encode()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

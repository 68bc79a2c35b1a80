"""Quality classifier of learned subword vectors (operator 10).

A document is the average of the vectors of its features: every word, every character n-gram of
the word (with word-boundary marks), and every pair of neighbouring words, each hashed to a row of
one learned table. A softmax over the classes follows the average; table and softmax are trained
together by numpy stochastic gradient descent on a bounded sample of labelled rows
(``sample_rows``). Pairs are hashed by their words' shapes (first character class, case, last
character, and whether both words are the same), which lets a pair mean the same in any language.

Because only the average of vectors meets the softmax, each table row contributes a fixed amount
to the log-odds; scoring therefore adds up one number a feature, with words remembered.

Defined cases: a null text counts as empty; a text without features gets the score of the
intercept; labels that are null or other than 0 and 1 are not learned from; with one class only
(or none) in the sample every score is that class' smoothed share; repeated rows are rows of their
own (and of the sample, while it has room) and the same text always gets the same score; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

BUCKETS, DIM, NGRAMS = 1 << 18, 8, (3, 4)
#: Bound on the labelled rows that are learned from.
SAMPLE_ROWS = 1600
EPOCHS, RATE, SEED = 5, 0.5, 7
THRESHOLD = 0.7
#: Features without any weight that every text has besides its own, so that short texts stay near the classes' shares.
NEUTRAL = 10
#: Words that a worker remembers, and the longest one; a word is remembered when it comes again, by a mark of its hash among so many.
REMEMBERED, REMEMBERED_CHARS, MARKS = 200_000, 40, 1 << 22


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams; very long words are cut into n-grams in full."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)]
    return [_bucket("w" + word), *(_bucket("c" + g) for g in grams)]


def shape(word: str) -> str:
    """First character's class, whether the word is in capitals, and its last character's class."""

    def kind(c: str) -> str:
        return "a" if c.isalpha() else "0" if c.isdigit() else c if ord(c) < 128 else "?"

    return kind(word[0]) + ("U" if len(word) > 1 and word.isupper() else "l") + kind(word[-1])


@dataclass
class Model:
    """Contribution of each bucket to the log-odds of class 1, and the intercept."""

    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[float, int, str]] = {}
        self.met = bytearray(MARKS)
        self.pairs: dict[tuple[str, str], float] = {}
        self.same = float(self.weights[_bucket("p=")])

    def __getstate__(self):
        return self.weights, self.intercept

    def __setstate__(self, state) -> None:
        self.weights, self.intercept = state
        self.__post_init__()

    def _word(self, word: str) -> tuple[float, int, str]:
        ids = word_features(word)
        got = float(self.weights[ids].sum(dtype=np.float64)), len(ids), intern(shape(word))
        mark = hash(word) % MARKS
        if len(word) <= REMEMBERED_CHARS and self.met[mark]:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = got
        self.met[mark] = 1
        return got

    def _pair(self, a: str, b: str) -> float:
        if (a, b) not in self.pairs:
            self.pairs[a, b] = float(self.weights[_bucket(f"p{a} {b}")])
        return self.pairs[a, b]

    def log_odds(self, text: str) -> float:
        words = text.split()
        if not words:
            return self.intercept
        known, look = self.known.get, self._word
        parts = [known(w) or look(w) for w in words]
        total, count, shapes = map(list, zip(*parts, strict=True))
        pair = self.pairs
        forms = list(zip(shapes, shapes[1:]))
        for form in set(forms) - pair.keys():
            self._pair(*form)
        same = sum(map(str.__eq__, words, words[1:]))
        value = sum(total) + sum(map(pair.__getitem__, forms)) + PAIR_WEIGHT * same * self.same
        return value / (NEUTRAL + sum(count) + len(forms) + PAIR_WEIGHT * same) + self.intercept

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.log_odds(text), -50, 50))))


#: How many features a repeated word counts for.
PAIR_WEIGHT = 10


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's features with their counts."""
    words = text.split()
    ids: list[int] = []
    remembered: dict[str, list[int]] = {}
    for w in words:
        if w not in remembered:
            remembered[w] = word_features(w)
        ids += remembered[w]
    forms = [shape(w) for w in words]
    ids += [_bucket(f"p{a} {b}") for a, b in zip(forms, forms[1:])]
    ids += [_bucket("p=")] * (PAIR_WEIGHT * sum(map(str.__eq__, words, words[1:])))
    return np.unique(np.array(ids, np.int64), return_counts=True)


def vectors(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic gradient descent, classes weighted to equal shares: the vectors, the softmax' weights and its biases."""
    ones = int(y.sum())
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    out[1] = rng.normal(0, 1, dim)
    out[0] = -out[1]
    bias = np.zeros(2, np.float32)
    weight = np.array([len(y) / (2 * (len(y) - ones)), len(y) / (2 * ones)], np.float32)
    steps, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids, n = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            total = NEUTRAL + int(n.sum())
            part = (n / total).astype(np.float32)
            mean = part @ table[ids] if len(ids) else np.zeros(dim, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = p * min(4.0, weight[y[i]])
            back = g @ out
            out -= lr * np.outer(g, mean)
            bias -= lr * g
            if len(ids):
                table[ids] -= (lr * 20 * part)[:, None] * back
    return table, out, bias


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], shares: tuple[int, int] | None = None, **options) -> Model:
    """The model of counted rows. ``shares``: rows of class 0 and 1 among all that could be learned
    from; they set the intercept."""
    y = np.array(labels, np.int64)
    ones = int(y.sum())
    if not 0 < ones < len(y):
        share = (ones + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    table, out, bias = vectors(rows, y, **options)
    # classes were weighted: put the true share back
    zeros, ones = shares or (len(y) - ones, ones)
    return Model((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0] + np.log((ones + 1) / (zeros + 1))))


def fit(texts: list[str], labels: list[int], **options) -> Model:
    return learn([counted(t) for t in texts], labels, **options)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``sample_rows`` labelled documents that are not held out, chosen by a hash."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(~held_out())
    # the smaller class is kept in full as far as the bound allows: half of the rows for each class
    picked = None
    for q in (0, 1):
        part = marked.where(F.col("quality") == q).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    picked = [(r.doc_id, r.quality) for r in picked.collect()]
    shares = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    spark = docs.sparkSession
    # as an Arrow table: a list of rows would start a second set of Python workers, only to read it
    ids, marks = zip(*picked or [(None, 0)], strict=True)
    chosen = F.broadcast(spark.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array(marks, pa.int32())})))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n = counted(batch.column(3)[i].as_py())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(3)), pa.array([ids.astype(np.int32)]), pa.array([n.astype(np.int32)])], ["doc_id", "mark", "quality", "ids", "n"])

    # features are counted where the texts are; rows that repeat an id take places of their own
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).join(chosen, "doc_id").select("doc_id", "mark", "quality", "text")
    rows = rows.mapInArrow(count, "doc_id long, mark long, quality int, ids array<int>, n array<int>").orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id", "mark").limit(sample_rows)
    got = [(np.array(r.ids, np.int64), np.array(r.n, np.int64), r.quality) for r in rows.toLocalIterator()]
    return learn([(ids, n) for ids, n, _ in got], [q for _, _, q in got], (shares.get(0, 0), shares.get(1, 0)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for each row: the score looks at the text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t.as_py() or "") for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    scored = score(docs, train(docs, labels, sample_rows))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            good = pa.array([m.score(t.as_py() or "") >= threshold for t in batch.column(at)], pa.bool_())
            yield batch.filter(good)

    return bounded(docs).mapInArrow(run, docs.schema)

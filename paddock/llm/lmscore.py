"""Language-model scores: masked pseudo-likelihood from a bidirectional window network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, flat, mix, runs, shared, text_slices
from .decontam import LOWERED
from .quality import IS_SPACE

OWN, ENDINGS, WITHIN = 96, 96, 2048
CLASSES, BUCKETS, HIDDEN, SIDE = OWN + ENDINGS, ENDINGS * WITHIN, 32, 2
PAD = CLASSES
BATCH = 1024
ONES = np.ones(CLASSES, np.float32)


def buckets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each lower-cased word, cuts by text). A bucket is a word's last two bytes, hashed, and the word, hashed."""
    data, offsets = flat(part.column("text"))
    starts, ends = runs(~IS_SPACE[data], offsets)
    data = LOWERED[data]
    hashed = RangeHash(data)(starts, ends)
    tail = data[ends - 1].astype(np.uint64) << np.uint64(8) | data[np.maximum(ends - 2, starts)] if len(ends) else np.zeros(0, np.uint64)
    ending = mix(tail) % np.uint64(ENDINGS)
    return (ending * np.uint64(WITHIN) + hashed % np.uint64(WITHIN)).astype(np.int64), np.searchsorted(starts, offsets)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for part in text_slices(batches):
        total += np.bincount(buckets(part)[0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


class Vocabulary:
    """The most frequent buckets are classes of their own, the rest a class by ending."""

    def __init__(self, counts: np.ndarray):
        self.class_of = OWN + np.arange(BUCKETS) // WITHIN
        top = np.lexsort((np.arange(BUCKETS), -counts))[:OWN]
        self.class_of[top[counts[top] > 0]] = np.arange(int((counts[top] > 0).sum()))
        self.class_of = self.class_of.astype(np.int64)
        total, kinds = np.bincount(self.class_of, counts, CLASSES), np.bincount(self.class_of, minlength=CLASSES)
        self.log_within = np.log((counts + 1) / (total + kinds)[self.class_of]).astype(np.float32)
        self.log_class = np.log((total + 1) / (total.sum() + CLASSES)).astype(np.float32)


def windows(classes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The classes at SIDE places before and after every word; PAD beyond the text."""
    n = len(classes)
    begin, end = np.repeat(cuts[:-1], np.diff(cuts)), np.repeat(cuts[1:], np.diff(cuts))
    out = np.full((n, 2 * SIDE), PAD, np.int64)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        at = np.arange(n) + d
        inside = (at >= begin) & (at < end)
        out[inside, k] = classes[at[inside]]
    return out


def training_rows(part: pa.RecordBatch, vocabulary: Vocabulary, rate: int) -> np.ndarray:
    """Windows with their middle class, in an order by hash; with a `rate` over 1 one word in `rate`, by hash."""
    found, cuts = buckets(part)
    classes = vocabulary.class_of[found]
    near = windows(classes, cuts)
    key = mix(np.arange(len(found)).astype(np.uint64) + mix(found.astype(np.uint64) + (near @ np.array([1, 211, 44521, 9393931])).astype(np.uint64)))
    pick = np.flatnonzero(key % np.uint64(rate) == 0)
    pick = pick[np.argsort(key[pick] >> np.uint64(24))]
    return np.concatenate([near[pick], classes[pick, None]], axis=1)


class Network:
    """tanh(sum of a table row for each neighbour) times a matrix: log-probabilities of the class in the middle."""

    SHAPES = ((2 * SIDE * (CLASSES + 1), HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))

    def __init__(self, flat: np.ndarray):
        self.flat, at, self.parts = flat, 0, []
        for shape in self.SHAPES:
            self.parts.append(flat[at : at + int(np.prod(shape))].reshape(shape))
            at += int(np.prod(shape))

    @classmethod
    def start(cls, log_class: np.ndarray) -> Network:
        rng = np.random.default_rng(7)
        out = cls(np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES), np.float32))
        out.parts[0][:] = rng.normal(0, 0.1, cls.SHAPES[0])
        out.parts[2][:] = rng.normal(0, 0.1, cls.SHAPES[2])
        out.parts[3][:] = log_class
        return out

    def hidden(self, near: np.ndarray) -> np.ndarray:
        table, bias = self.parts[0], self.parts[1]
        total = bias + table.take(near[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            total += table.take(near[:, k] + k * (CLASSES + 1), axis=0)
        return np.tanh(total, out=total)

    def log_probability(self, near: np.ndarray, middle: np.ndarray) -> np.ndarray:
        out = np.empty(len(middle), np.float32)
        for at in range(0, len(middle), BATCH):
            logits = self.hidden(near[at : at + BATCH]) @ self.parts[2]
            logits += self.parts[3]
            own = logits[np.arange(len(logits)), middle[at : at + BATCH]]
            np.exp(logits, out=logits)
            out[at : at + BATCH] = own - np.log(logits @ ONES)
        return out

    def learn(self, rows: np.ndarray, squares: np.ndarray, rate: float = 0.05, batch: int = BATCH) -> None:
        """One pass of AdaGrad."""
        kept = Network(squares)
        for at in range(0, len(rows), batch):
            near, middle = rows[at : at + batch, :-1], rows[at : at + batch, -1]
            h = self.hidden(near)
            error = h @ self.parts[2]
            error += self.parts[3]
            np.exp(error, out=error)
            error *= (1 / (len(middle) * (error @ ONES)))[:, None]
            error[np.arange(len(middle)), middle] -= np.float32(1 / len(middle))
            back = (error @ self.parts[2].T) * (1 - h * h)
            places = (near + np.arange(2 * SIDE) * (CLASSES + 1)).T.reshape(-1)
            columns = np.concatenate([back.T.astype(np.float64, order="C")] * (2 * SIDE), axis=1)
            table = np.stack([np.bincount(places, column, self.SHAPES[0][0]) for column in columns]).T.astype(np.float32, order="C")
            for mine, seen, g in zip(self.parts, kept.parts, (table, back.sum(0), h.T @ error, error.sum(0)), strict=True):
                seen += g * g
                mine -= rate * g / (np.sqrt(seen) + 1e-6)


def train_batches(start, vocabulary, rate: int):
    """One worker's pass over all windows of its texts from the broadcast parameters, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, squares = start.value
        net, squares, seen = Network(flat.copy()), squares.copy(), 0
        for part in text_slices(batches):  # a slice of 256 KB, or one longer text
            rows = training_rows(part, vocabulary.value, rate)
            net.learn(rows, squares)
            seen += len(rows)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([net.flat.tobytes()], pa.binary()), pa.array([squares.tobytes()], pa.binary())], ["n", "flat", "squares"])

    return run


def score_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = model.value
        net = Network(flat)
        for part in text_slices(batches):
            found, cuts = buckets(part)
            classes = vocabulary.class_of[found]
            each = net.log_probability(windows(classes, cuts), classes) + vocabulary.log_within[found]
            sums = np.diff(np.concatenate([[0.0], np.cumsum(each.astype(np.float64))])[cuts])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(cuts).astype(np.int64)), pa.array(sums)], ["doc_id", "n_words", "log_likelihood"])

    return run


def vocabulary_of(docs: DataFrame) -> Vocabulary:
    """Word counts of all documents by bucket; BUCKETS rows at most reach the driver."""
    found = docs.select("text").mapInArrow(count_batches, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return Vocabulary(counts)


def train(docs: DataFrame, vocabulary: Vocabulary, rate: int = 1, rounds: int = 2, workers: int | None = None, seen: list | None = None) -> np.ndarray:
    """Parameters after `rounds` passes of `workers` copies, averaged by windows seen after each.

    Every word of all documents is a training window in each round (with a `rate` over 1, one in `rate`);
    the windows are made as the texts pass and never stored. There are as many copies as the cluster has
    cores by default. Each copy's texts come in an order by hash, so that a rerun, also of a lost task,
    gives the same sums. What reaches the driver is `workers` parameter vectors of about 130 KB. `seen`
    gets the number of windows of each round.
    """
    spark = docs.sparkSession
    known = shared(spark, vocabulary)
    h = F.xxhash64("text", F.monotonically_increasing_id())
    texts = docs.select("text", h.alias("h")).repartition(workers or spark.sparkContext.defaultParallelism, "h").sortWithinPartitions("h").select("text")
    flat = Network.start(vocabulary.log_class).flat
    squares = np.zeros_like(flat)
    for _ in range(rounds):
        start = shared(spark, (flat, squares))
        got = texts.mapInArrow(train_batches(start, known, rate), "n bigint, flat binary, squares binary").collect()
        start.unpersist()
        if seen is not None:
            seen.append(sum(r["n"] for r in got))
        if not got:
            return flat
        got.sort(key=lambda r: (r["n"], r["flat"]))
        n = np.array([r["n"] for r in got], np.float64)
        mean = lambda c: (np.stack([np.frombuffer(r[c], np.float32) for r in got]) * (n / n.sum())[:, None]).sum(0).astype(np.float32)  # noqa: E731,B023
        flat, squares = mean("flat"), mean("squares")
    return flat


def pseudo_likelihood(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_likelihood, perplexity for every row of `docs`.

    Every word is predicted from two words on both sides; its log-probability is that of its class, from
    the network, plus that of its bucket within the class, from counts over all documents. Words are
    lower-cased (A-Z). A text without words, NULL included, has log_likelihood 0 and NULL for the mean
    and the perplexity. Repeated rows are scored each; an empty table gives an empty result. Other
    columns are ignored.
    """
    vocabulary = vocabulary_of(docs)
    model = shared(docs.sparkSession, (vocabulary, train(docs, vocabulary, **how)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(score_batches(model), f"doc_id {kind}, n_words bigint, log_likelihood double")
    mean = F.try_divide(F.col("log_likelihood"), F.col("n_words"))
    return scored.select("*", mean.alias("mean_log_likelihood"), F.exp(-mean).alias("perplexity"))

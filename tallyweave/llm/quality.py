"""Quality scores by a factorisation machine.

Features of a text: hashed words (L2-normalised counts in `buckets` bins), structure statistics, and metadata (the length
that the table states). Pairs of features interact through factors of low rank; with the identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2 a text is scored in time linear in its words.
The machine learns by AdaGrad on the logistic loss, on the driver, from at most `train_rows` labelled rows (chosen by a hash
of the id); the features of those rows, at most `buckets` bins each, are all that reaches the driver.

Edge cases: a null text counts as empty; an empty text has statistics of 0 and a score like any other. A null stated
length counts as the text's own; the column must be there, and be a number. Of several labels of an id the best counts; null labels count as none. Without labelled rows
every score is 0.5. Repeated rows are scored each; columns beyond the named ones are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GenerationCache, ids_schema, slices, split_words

SLICE_BYTES = 2 << 20
CACHE = 200_000
#: Kinds of bytes whose shares of a text are statistics.
KINDS = ("upper", "lower", "digit", "space", "newline", "stop", "mark", "pipe", "beyond ASCII")
N_STATS = len(KINDS) + 9


def _kinds() -> np.ndarray:
    table = np.full(256, KINDS.index("mark"), np.uint8)
    for k, members in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t", b"\n\r", b".,;:?'-", (), b"|", range(128, 256))):
        table[list(members)] = k
    return table


class Features:
    """Words' bins and structure statistics of texts."""

    def __init__(self, buckets: int):
        self.buckets, self.kinds = buckets, _kinds()
        self.bins = GenerationCache(lambda w: xxhash.xxh32_intdigest(w.lower()) % buckets, CACHE)

    def of(self, texts: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, bin, value) of the hashed words, and the statistics by row. `lengths`: stated ones, NaN where there is none."""
        n = len(texts)
        words = [split_words(t) for t in texts]
        count = np.fromiter(map(len, words), np.int64, n)
        bins = np.fromiter(map(self.bins.__getitem__, chain.from_iterable(words)), np.int64, int(count.sum()))
        row = np.repeat(np.arange(n), count)
        key, times = np.unique(row * self.buckets + bins, return_counts=True)
        owner, where = key // self.buckets, key % self.buckets
        values = times / np.sqrt(np.bincount(owner, times.astype(float) ** 2, n))[owner]

        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, n)
        kind = self.kinds[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.concatenate([[0], np.cumsum(size)])
        shares = np.empty((n, len(KINDS)))
        for k in range(len(KINDS)):
            upto = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
            shares[:, k] = (upto[ends[1:]] - upto[ends[:-1]]) / np.maximum(size, 1)
        again = np.bincount(row[1:][(bins[1:] == bins[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(row) else np.zeros(n)
        most = np.zeros(n)
        np.maximum.at(most, owner, times)
        points = np.fromiter(map(len, texts), np.int64, n)
        stated = np.where(np.isfinite(lengths), lengths, points)
        at_least = np.maximum(count, 1)
        more = [
            np.bincount(owner, minlength=n) / at_least,  # distinct words
            again / at_least,  # words like the one before
            most / at_least,
            np.minimum(size / at_least, 20) / 10,  # bytes a word
            np.log1p(count) / 8,
            np.log1p(points) / 10,
            np.log1p(np.maximum(stated, 0)) / 10,
            np.log1p(shares[:, KINDS.index("newline")] * size) / 5,
            np.sqrt(shares[:, KINDS.index("mark")]),
        ]
        return owner, where, values, np.column_stack([shares, *more])


@dataclass
class Machine:
    buckets: int
    bias: float
    weights: np.ndarray  # (buckets + statistics,)
    factors: np.ndarray  # (buckets + statistics, rank)

    def scores(self, row: np.ndarray, where: np.ndarray, values: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n, b = len(stats), self.buckets
        total = np.column_stack([np.bincount(row, self.factors[where, f] * values, n) for f in range(self.factors.shape[1])]) + stats @ self.factors[b:]
        squares = np.bincount(row, (self.factors[where] ** 2).sum(1) * values**2, n) + stats**2 @ (self.factors[b:] ** 2).sum(1)
        raw = self.bias + np.bincount(row, self.weights[where] * values, n) + stats @ self.weights[b:] + ((total**2).sum(1) - squares) / 2
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, labels: np.ndarray, buckets: int, rank: int = 8, epochs: int = 12, rate: float = 0.1, batch: int = 64, seed: int = 7) -> Machine:
    """AdaGrad over (bins, values), statistics and labels of the training rows."""
    random = np.random.default_rng(seed)
    width = buckets + stats.shape[1]
    machine = Machine(buckets, 0.0, np.zeros(width), random.normal(0, 0.05, (width, rank)))
    if not len(labels):
        return Machine(buckets, 0.0, np.zeros(width), np.zeros((width, rank)))
    seen_w, seen_v, seen_b = np.full(width, 1e-6), np.full((width, rank), 1e-6), 1e-6
    own = np.arange(buckets, width)
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            where = np.concatenate([x for k in part for x in (rows[k][0], own)])
            values = np.concatenate([x for k in part for x in (rows[k][1], stats[k])])
            row = np.repeat(np.arange(len(part)), [len(rows[k][0]) + len(own) for k in part])
            v = machine.factors[where]
            total = np.column_stack([np.bincount(row, v[:, f] * values, len(part)) for f in range(rank)])
            raw = machine.bias + np.bincount(row, machine.weights[where] * values + 0.0, len(part)) + ((total**2).sum(1) - np.bincount(row, (v**2).sum(1) * values**2, len(part))) / 2
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) / len(part)
            used, at = np.unique(where, return_inverse=True)
            by_word = slope[row] * values
            grad_w = np.bincount(at, by_word) + 1e-6 * machine.weights[used]
            grad_v = np.column_stack([np.bincount(at, by_word * (total[row, f] - v[:, f] * values)) for f in range(rank)]) + 1e-6 * machine.factors[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            seen_b += slope.sum() ** 2
            machine.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
            machine.factors[used] -= rate / 2 * grad_v / np.sqrt(seen_v[used])
            machine.bias -= rate * slope.sum() / np.sqrt(seen_b)
    return machine


def train(docs: DataFrame, labels: DataFrame, usable: Column, train_rows: int = 6_000, buckets: int = 1 << 13, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars", label_column: str = "quality", **settings) -> Machine:
    """A machine of labelled rows where `usable` (of the id) holds."""
    named = labels.where(usable & F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max(label_column).cast("double").alias("label__"))
    count = max(1, named.count())
    share = int(min(1.0, train_rows / count) * 2**53)
    taken = F.shiftrightunsigned(F.xxhash64(F.col(id_column).cast("string"), F.lit("train")), 11) < share
    # About train_rows ids; the limit bounds what is broadcast.
    chosen = named.where(taken).limit(2 * train_rows)
    rows = docs.join(F.broadcast(chosen), id_column).select(F.col(text_column).alias("text"), F.col(length_column).cast("double").alias("length"), "label__")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            row, where, values, stats = features.of(texts, batch.column(1).to_numpy(zero_copy_only=False).astype(float))
            cut = np.searchsorted(row, np.arange(1, len(texts)))
            limits = pa.array(np.concatenate([[0], cut, [len(row)]]), pa.int32())
            bins, held = (pa.ListArray.from_arrays(limits, pa.array(x)) for x in (where.astype(np.int32), values.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([bins, held, pa.array(list(stats), pa.list_(pa.float64())), batch.column(2)], ["bins", "values", "stats", "label"])

    found = rows.mapInArrow(run, "bins array<int>, values array<float>, stats array<double>, label double").toPandas()
    # The outcome must not depend on the order in which partitions arrive.
    order = sorted(range(len(found)), key=lambda k: (found.label[k], tuple(found.stats[k])))
    pairs = [(np.asarray(found.bins[k], np.int64), np.asarray(found["values"][k], float)) for k in order]
    stats = np.array([found.stats[k] for k in order]).reshape(len(order), N_STATS)
    return fit(pairs, stats, found.label.to_numpy(float)[order], buckets, **settings)


def score(docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """For each row its id and `score`. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(shared.value.buckets), shared.value
        for batch in slices(batches, "text__", SLICE_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = own.scores(*features.of(texts, batch.column(2).to_numpy(zero_copy_only=False).astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [id_column, "score"])

    given = docs.select(id_column, F.col(text_column).alias("text__"), F.col(length_column).cast("double").alias("length__"))
    return given.mapInArrow(run, f"{ids_schema(docs, id_column)}, score double")

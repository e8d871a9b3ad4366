"""Benchmark passages in documents, by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of words (lower-cased runs of letters, marks and digits). A document holds an item of n words if some part
of it is at most floor(n * (1 - similarity)) word edits away.

1. Windows of the item's size begin at every word. An item with d edits still shares n - 1 - 2d of its pairs of
   neighbouring words, so windows with fewer pairs of the benchmark cannot match, and are left out (nothing is lost).
2. The others are embedded by random walks (Chakraborty, Goldenberg and Koucky, 2016): at each of 3n steps the current word is
   written and a hash of step and word tells whether to go on to the next. Few edits become few differing places.
3. A hash of `sampled` random places is compared with the items' hashes of the same length, `walks` * `draws` times over;
   any agreement makes a candidate. The number of draws follows from `recall` and the share of places that agree.
4. Candidates are verified by semi-global alignment, which finds the smallest number of edits to any part of the document around.

Items of so few words that no edit is allowed (one to four, at 0.8) are compared exactly, word by word from every place.

The benchmark is read in blocks of at most `block_items` items and `BLOCK_BYTES` bytes, each broadcast; a larger benchmark means more passes.

Edge cases: null and empty texts, and those without words, hold nothing and match nothing. Of equally good places the first is told. An empty benchmark matches nothing. Repeated rows are judged each; ids may be null. Other columns are left out by
find_leaks() and kept by drop_leaks().
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_schema, slices, split_words, worker_state

SLICE_BYTES = 2 << 20
#: Bytes of the items of a block.
BLOCK_BYTES = 32 << 20
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def draws_needed(recall: float, agreeing: float, sampled: int) -> int:
    """Repetitions after which a pair with this share of agreeing places is found with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreeing**sampled))


class Embedding:
    """Signatures of sequences of words: (draws, sequences)."""

    def __init__(self, longest: int, walks: int, draws: int, sampled: int, seed: int = 5):
        random = np.random.default_rng(seed)
        self.steps = random.integers(0, 2**63, (walks, 3 * longest), dtype=np.uint64)
        self.places = random.random((walks, draws, sampled))

    def signatures(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """x: a sequence in each row, n words long and filled up with -1."""
        m = len(x)
        padded = np.column_stack([x, np.full(m, -1)]).astype(np.int64).view(np.uint64)
        rows, out = np.arange(m), []
        for steps, places in zip(self.steps, self.places, strict=True):
            at, written = np.zeros(m, np.int64), np.empty((3 * x.shape[1], m), np.uint64)
            for j in range(len(written)):
                word = padded[rows, at]
                written[j] = word
                at = np.minimum(at + (_mixed(word * _MIX + steps[j]) & np.uint64(1)).astype(np.int64), n)
            for chosen in places:
                h = n.astype(np.uint64)
                for place in chosen:
                    h = _mixed(h * _MIX + written[(place * 3 * n).astype(np.int64), rows] + np.uint64(1))
                out.append(h)
        return np.array(out)


def best_alignment(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """(fewest edits between the item and any stretch of `part`, where that stretch ends)."""
    steps = np.arange(len(item) + 1)
    column = steps.copy()
    best, end = int(column[-1]), 0
    for k, word in enumerate(part.tolist()):
        new = np.empty_like(column)
        new[0] = 0
        np.minimum(column[1:] + 1, column[:-1] + (item != word), out=new[1:])
        column = np.minimum.accumulate(new - steps) + steps
        if column[-1] < best:
            best, end = int(column[-1]), k + 1
    return best, end


class _Chunks(dict):
    """Ids of the words of a run without white space, as bytes. Holds the vocabulary; what it lacks is 0 and not kept."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__((w, np.int32(k).tobytes()) for w, k in vocabulary.items())

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return b"\0\0\0\0"
        bare = chunk.strip(".,;:!?\"'()")
        if bare.isalpha():
            return self.get(bare, b"\0\0\0\0")
        return b"".join([self.get(w, b"\0\0\0\0") for w in _WORDS.findall(chunk)])


class _Exact:
    """Short items as a tree of words, walked from all places at once."""

    def __init__(self, items: dict[tuple[int, ...], list], width: int):
        nodes: dict[tuple[int, int], int] = {}
        self.items, self.width = {}, width
        for numbers, ids in items.items():
            at = 0
            for word in numbers:
                at = nodes.setdefault((at, word), len(nodes) + 1)
            self.items[at] = ids
        keys = np.array([a * width + w for a, w in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.fromiter(nodes.values(), np.int64)[order]
        self.longest = max(map(len, items))
        self.is_item = np.zeros(len(nodes) + 1, bool)
        self.is_item[list(self.items)] = True

    def matches(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """As Benchmark.matches(): the first place of each item in each text. A gap between texts is no word."""
        place, at = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for n in range(1, self.longest + 1):
            place, at = place[place + n <= len(ids)], at[place + n <= len(ids)]
            word = ids[place + n - 1]
            want = at * self.width + word
            where = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = (word > 0) & (self.keys[where] == want)
            place, at = place[ok], self.targets[where[ok]]
            hit = np.flatnonzero(self.is_item[at])
            text = np.searchsorted(ends, place[hit], "right")
            _, first = np.unique(text * len(self.is_item) + at[hit], return_index=True)
            for k in first.tolist():
                t, p = int(text[k]), int(place[hit[k]])
                for item in self.items[int(at[hit[k]])]:
                    yield t, item, n, 0, p + n - (int(ends[t - 1]) if t else 0)


class Benchmark:
    """A block of items, ready for the search."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, walks: int, draws: int, sampled: int):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words, short = [], [], {}
        for item_id, text in items:
            words = words_of(text or "")
            numbers = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
            if int(len(words) * (1 - similarity) + 1e-9):
                self.ids.append(item_id)
                self.words.append(np.array(numbers, np.int64))
            elif words:
                short.setdefault(numbers, []).append(item_id)
        self.width = len(self.vocabulary) + 1
        self.chunks = _Chunks(self.vocabulary)
        self.short = _Exact(short, self.width) if short else None
        if not self.ids:
            return
        self.size = np.array([len(w) for w in self.words])
        # The small term guards against rounding: 0.2 of 15 words are 3 edits.
        self.edits = (self.size * (1 - similarity) + 1e-9).astype(np.int64)
        self.shared = np.maximum(1, self.size - 1 - 2 * self.edits)
        # Pairs of neighbouring words, the items that have each, and how often one item has it at most.
        pair = np.concatenate([w[:-1] * self.width + w[1:] for w in self.words])
        both, times = np.unique(np.column_stack([pair, np.repeat(np.arange(len(self.ids)), self.size - 1)]), axis=0, return_counts=True)
        self.pairs, first = np.unique(both[:, 0], return_index=True)
        self.owners, self.owner_bounds = both[:, 1], np.append(first, len(both))
        self.most = np.maximum.reduceat(times, first)
        self.embedding = Embedding(int(self.size.max()), walks, draws, sampled)
        signatures = self.embedding.signatures(self._rows(self.words), self.size)
        self.tables = [(s[o], o) for s in signatures for o in [np.argsort(s, kind="stable")]]
        # A window with `shared` pairs has a stretch of the shortest size with so many of them.
        self.shortest = int(self.size.min()) - 1
        self.fewest = int((-(-self.shared // -(-(self.size - 1) // self.shortest))).min())

    def _rows(self, sequences: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(sequences), int(self.size.max())), -1, np.int64)
        for row, sequence in zip(out, sequences, strict=True):
            row[: len(sequence)] = sequence
        return out

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, words of the item, edits, place of the word behind the match): the best match of each text and item."""
        if not texts or not self.vocabulary:
            return
        known, gap = self.chunks.__getitem__, b"\0\0\0\0"
        parts = [b"".join(map(known, split_words(t.lower()))) for t in texts]
        ids = np.frombuffer(gap.join([*parts, b""]), np.int32).astype(np.int64)
        ends = np.cumsum([len(p) // 4 + 1 for p in parts])
        if self.short:
            yield from self.short.matches(ids, ends)
        if not self.ids:
            return
        # Places of the benchmark's pairs. Of a pair that follows itself (a word again and again) both ends of the run stay, each as
        # long as an item has the pair and can be shifted by edits. A window that lies inside equals one at the run's beginning.
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        pair = ids[at] * self.width + ids[at + 1]
        where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        ok = self.pairs[where] == pair
        at, where = at[ok], where[ok]
        again = np.zeros(len(at), bool)
        again[1:] = (where[1:] == where[:-1]) & (at[1:] == at[:-1] + 1)
        heads = np.maximum.accumulate(np.where(again, 0, np.arange(len(at)))) if len(at) else at
        tails = np.append(np.flatnonzero(~again)[1:], len(at))[np.cumsum(~again) - 1] if len(at) else at
        kept = self.most[where] + int(self.edits.max())
        ok = (np.arange(len(at)) - heads < kept) | (tails - np.arange(len(at)) <= kept)
        at, where = at[ok], where[ok]
        # Texts with a stretch that has enough of them.
        dense = np.flatnonzero(np.searchsorted(at, at + self.shortest) - np.arange(len(at)) >= self.fewest)
        windows: list[tuple[int, int, int]] = []
        for k in np.unique(np.searchsorted(ends, at[dense], "right")).tolist():
            first = int(ends[k - 1]) if k else 0
            low, high = np.searchsorted(at, [first, ends[k]])
            windows += self._windows(k, first, int(ends[k]) - 1, at[low:high], where[low:high])
        found: dict[tuple[int, int], set[int]] = {}
        windows = sorted(set(windows))
        for low in range(0, len(windows), 8192):
            part = windows[low : low + 8192]
            n = np.array([w[2] for w in part])
            x = self._rows([ids[s : min(s + m, int(ends[k]) - 1)] for k, s, m in part])
            x[(x < 0) & (np.arange(x.shape[1]) < n[:, None])] = 0  # a window may reach beyond its text
            for s, (table, owner) in zip(self.embedding.signatures(x, n), self.tables, strict=True):
                a, b = np.searchsorted(table, s, "left"), np.searchsorted(table, s, "right")
                for w in np.flatnonzero(b > a).tolist():
                    for item in owner[a[w] : b[w]].tolist():
                        found.setdefault((part[w][0], item), set()).add(part[w][1])
        for (k, item), places in sorted(found.items()):
            first, end, n, d = int(ends[k - 1]) if k else 0, int(ends[k]) - 1, int(self.size[item]), int(self.edits[item])
            best, order, i = (d + 1, 0), sorted(places), 0
            while i < len(order):  # places close to one another are verified together
                j = i
                while j + 1 < len(order) and order[j + 1] <= order[j] + d + 1:
                    j += 1
                low = max(first, order[i] - d)
                edits, upto = best_alignment(self.words[item], ids[low : min(end, order[j] + n + d)])
                best = min(best, (edits, low + upto - first))
                i = j + 1
            if best[0] <= d:
                yield k, self.ids[item], n, *best

    def _windows(self, k: int, first: int, end: int, at: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word, size) of the windows that share enough pairs with one item of their size."""
        count = self.owner_bounds[where + 1] - self.owner_bounds[where]
        flat = np.repeat(self.owner_bounds[where] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, place = self.owners[flat], np.repeat(at, count)
        for i in np.flatnonzero(np.bincount(item, minlength=len(self.ids)) >= self.shared).tolist():
            n, hits = int(self.size[i]), place[item == i]
            # Windows that hold a hit.
            starts = np.unique(np.concatenate([np.arange(max(first, a - n + 2), a + 1) for a in hits.tolist()]))
            starts = starts[(starts <= end - n + self.edits[i]) & (np.searchsorted(hits, starts + n - 1) - np.searchsorted(hits, starts) >= self.shared[i])]
            for start in starts.tolist():
                yield k, start, n


def _blocks(items: DataFrame, item_id: str, item_text: str, size: int) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    total = 0
    for row in items.select(item_id, item_text).where(F.col(item_text).isNotNull()).distinct().toLocalIterator():
        block.append((row[0], row[1]))
        total += len(row[1].encode())
        if len(block) == size or total >= BLOCK_BYTES:
            yield block
            block, total = [], 0
    if block:
        yield block


def _settings(similarity: float, recall: float, agreeing: float, walks: int, sampled: int) -> tuple:
    return similarity, walks, math.ceil(draws_needed(recall, agreeing, sampled) / walks), sampled


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, recall: float = 0.999, agreeing: float = 0.4, walks: int = 8, sampled: int = 2, block_items: int = 20_000, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, item_words, edits, end_word) of each document and item that it holds: its best match. No shuffle."""
    settings = _settings(similarity, recall, agreeing, walks, sampled)
    spark, out = docs.sparkSession, None
    kind = dict(items.dtypes)[item_id]
    schema = f"{ids_schema(docs, id_column)}, item_id {kind}, item_words int, edits int, end_word int"
    given = docs.select(id_column, F.col(text_column).alias("text__"))
    for block in _blocks(items, item_id, item_text, block_items):
        shared = spark.sparkContext.broadcast((block, *settings))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            benchmark = worker_state(("benchmark", key), lambda: Benchmark(*shared.value))
            for batch in slices(batches, "text__", SLICE_BYTES):
                rows = list(benchmark.matches([t or "" for t in batch.column(1).to_pylist()]))
                if rows:
                    text, item, *more = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text, pa.int64())), pa.array(item), *(pa.array(x, pa.int32()) for x in more)], [id_column, "item_id", "item_words", "edits", "end_word"])

        part = given.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, recall: float = 0.999, agreeing: float = 0.4, walks: int = 8, sampled: int = 2, block_items: int = 20_000, text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no item. No shuffle."""
    settings = _settings(similarity, recall, agreeing, walks, sampled)
    place = docs.columns.index(text_column)
    for block in _blocks(items, item_id, item_text, block_items):
        shared = docs.sparkSession.sparkContext.broadcast((block, *settings))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            benchmark = worker_state(("benchmark", key), lambda: Benchmark(*shared.value))
            for batch in slices(batches, text_column, SLICE_BYTES):
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in benchmark.matches([t or "" for t in batch.column(place).to_pylist()])]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Texts are sequences of words (lower-cased runs of letters, marks and digits). Two texts are linked if they share a sketch and
their edit similarity, 1 - edits / words of the longer, is at least `similarity`. Classes are the connected components.

1. Equal texts (by MD5) become one node with a number, combined before the shuffle.
2. A sketch hashes the `kept` smallest of a node's occurrence-labelled `size`-mers of words, in the order of the text, so it
   depends on order and repetition as the edit distance does (Marçais and others, 2019). Each node has `sketches` of them: at a
   similarity of just 0.8, with edits strewn over the text, five-mers agree only to about a fifth, and two nodes share a sketch
   with a chance of 0.036 each.
3. Nodes that share a sketch form a bucket. Each is paired with the bucket's smallest and largest node, so a bucket of b nodes
   has at most 2b pairs, whatever its size. Then classes are formed, and in buckets that still hold several of them every pair of
   different classes in a bucket is verified or ruled out: texts within the similarity share so many pairs of neighbouring words that they have one in
   common among the rarest of each (prefix filter), and rare is counted in the bucket, so that a passage which all its texts
   hold makes no pairs. A pair that several buckets hold is verified in one of them. Buckets of over `BLOCK_WORDS` words are split into blocks, and each two blocks are compared.
4. A pair is verified by edit distance along diagonals within the band that the similarity allows, many pairs at a time. Words
   are compared by 32-bit hashes. Pairs whose longest common subsequence is too short are given up early; a task hands on a spanning
   forest of its links.

Sides of joins that bring a hot key together are written first, so that adaptive execution can split the other side.

Edge cases: a null text is in no class but its own, and its class is its own id. Empty texts are equal texts. A text without words is only equal to itself; one with fewer
than `size` has one k-mer of all it has. Repeated rows are copies. Ids may be null; a class's id is its
smallest, and so is the id that keep_one() keeps (of rows with the same id and text, any one). Other columns, whatever their names, are left out by
classes() and kept by keep_one(). An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import GenerationCache, drop, slices, split_words, worker_state, written

SLICE_BYTES = 2 << 20
#: Words of a block, the unit in which large buckets are compared.
BLOCK_WORDS = 1_000_000
#: Pairs that are held at once while blocks are compared.
PAIRS = 1 << 20
CACHE = 150_000
#: Places of the bands of pairs that are verified together.
BAND = 1 << 20
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_M = np.uint64(0x9E3779B97F4A7C15)
_MOST = np.iinfo(np.uint64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """Texts as arrays of 32-bit word hashes."""

    def __init__(self):
        self.chunks = GenerationCache(self._chunk, CACHE)

    def _chunk(self, chunk: str) -> bytes:
        bare = chunk.strip(".,;:!?\"'()")
        if bare.isalpha():
            return xxhash.xxh32_digest(bare)
        return b"".join([xxhash.xxh32_digest(w) for w in _WORDS.findall(chunk)])

    def of(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, split_words(text.lower())))


class OrderMinHash:
    def __init__(self, size: int, kept: int, sketches: int, seed: int = 3):
        self.size, self.kept = size, kept
        self.seeds = np.random.default_rng(seed).integers(1, 2**63, sketches, dtype=np.uint64)

    def of(self, words: list[np.ndarray]) -> np.ndarray:
        """(texts, sketches)."""
        count = np.array([len(w) for w in words], np.int64)
        longest = np.maximum(count, self.size)  # short texts are filled up to one k-mer
        flat = np.zeros(int(longest.sum()), np.uint64)
        starts = np.cumsum(longest) - longest
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
        flat[inside] = _mixed(np.concatenate(words).astype(np.uint64) * _M + np.uint64(1)) if len(inside) else 0
        mers = longest - self.size + 1
        place = np.arange(mers.sum()) - np.repeat(np.cumsum(mers) - mers, mers) + np.repeat(starts, mers)
        h = np.zeros(len(place), np.uint64)
        for k in range(self.size):
            h = h * _M + flat[place + k]
        text = np.repeat(np.arange(len(words)), mers)
        # Label each k-mer with how often it came before in its text.
        key = _mixed(h + _mixed(text.astype(np.uint64) * _M))
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        at = np.arange(len(key))
        occurrence = np.empty(len(key), np.int64)
        occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0)) if len(key) else 0
        h = _mixed(h + occurrence.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        first = np.cumsum(mers) - mers
        out = np.empty((len(words), len(self.seeds)), np.uint64)
        bits = np.uint64(max(1, int(len(h)).bit_length()))
        place, low = np.arange(len(h), dtype=np.uint64), (np.uint64(1) << bits) - np.uint64(1)
        for j, seed in enumerate(self.seeds):
            # The hash in the high bits, the place in the low ones, so that a minimum tells where it is.
            v = (h * (seed | np.uint64(1))) & ~low | place
            least = np.full((len(words), self.kept), len(h), np.int64)
            for k in range(self.kept):
                found = np.minimum.reduceat(v, first) if len(v) else np.zeros(0, np.uint64)
                some = mers > k
                least[some, k] = (found[some] & low).astype(np.int64)
                v[least[some, k]] = _MOST
            sketch = np.full(len(words), seed, np.uint64)
            held = np.append(h, np.uint64(0))
            for p in np.sort(least, axis=1).T:
                sketch = _mixed(sketch * _M + held[p])
            out[:, j] = sketch
        return out


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edits between two sequences, or limit + 1 if there are more. Keeps for each diagonal of the band the furthest place reached
    with so many edits, and goes on along equal words."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > limit:
        return limit + 1
    if not n:
        return m
    if n == m and (d := int((a != b).sum())) <= 1:
        return d
    # At most this many words are in both, however they are aligned.
    both, times = np.unique(np.concatenate([a, b]), return_inverse=True)
    shared = np.minimum(np.bincount(times[:n], minlength=len(both)), np.bincount(times[n:], minlength=len(both))).sum()
    if m - shared > limit:
        return limit + 1
    x = np.concatenate([a.astype(np.int64), [-1]])
    y = np.concatenate([b.astype(np.int64), [-2]])
    width = 2 * limit + 3
    diagonal = np.arange(width) - limit - 1  # place in b less place in a
    reach = np.full(width, -(1 << 30))
    reach[limit + 1] = 0
    goal = m - n + limit + 1
    for edits in range(limit + 1):
        if edits:
            new = reach + 1  # replaced
            np.maximum(new[1:], reach[:-1], out=new[1:])  # one more of b
            np.maximum(new[:-1], reach[1:] + 1, out=new[:-1])  # one more of a
            reach = np.minimum(new, np.minimum(n, m - diagonal))
        low, high = limit + 1 - edits, limit + 2 + edits
        part = reach[low:high]
        live = np.flatnonzero((part >= 0) & (part + diagonal[low:high] >= 0))
        while len(live):
            at = part[live]
            other = at + diagonal[low:high][live]
            live = live[(x[np.minimum(at, n)] == y[np.minimum(other, m)])]
            part[live] += 1
        if reach[goal] >= n:
            return edits
    return limit + 1


def _limit(n: np.ndarray, similarity: float) -> np.ndarray:
    """Edits that are allowed if the longer text has n words."""
    return (n * (1 - similarity) + 1e-9).astype(np.int64)


def within(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """Whether each two sequences are as similar as that. As banded_distance(), for pairs together."""
    if not pairs:
        return np.zeros(0, bool)
    a, b = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in pairs), strict=True)
    n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    limit = _limit(m, similarity)
    # At most the words that are in both, as often as in each, are left as they are.
    text = np.repeat(np.arange(2 * len(a)), np.concatenate([n, m]))
    flat = np.concatenate([*a, *b]).astype(np.int64)
    key = np.sort((text % len(a)) << 33 | flat << 1 | (text >= len(a)))
    new = np.flatnonzero(np.diff(key, prepend=-1) != 0)
    times, key = np.diff(np.append(new, len(key))), key[new]
    both = np.flatnonzero(key[1:] == key[:-1] + 1) if len(key) else new
    both = both[key[both] & 1 == 0]
    shared = np.bincount(key[both] >> 33, np.minimum(times[both], times[both + 1]), len(a))
    ok = np.zeros(len(a), bool)
    left = np.flatnonzero(m - shared <= limit)
    left = left[np.argsort(limit[left], kind="stable")]
    low = 0
    while low < len(left):
        # As many as fit, of similar band.
        size = np.maximum.accumulate(2 * limit[left[low:]] + 3) * np.arange(1, len(left) - low + 1)
        high = low + max(1, int(np.searchsorted(size, BAND, side="right")))
        part = left[low:high]
        ok[part] = _aligned([a[k] for k in part.tolist()], [b[k] for k in part.tolist()], limit[part])
        low = high
    return ok


def in_order(a: list[int], b: list[int]) -> int:
    """Words of the longest common subsequence: a bit for each place of `a`, in whole numbers (Hyyrö, 2004)."""
    places: dict[int, int] = {}
    bit = 1
    for w in a:
        places[w] = places.get(w, 0) | bit
        bit <<= 1
    free = bit - 1
    for at in filter(None, map(places.get, b)):
        used = free & at
        free = (free + used) | (free - used)
    return len(a) - (free & (bit - 1)).bit_count()


def _aligned(a: list[np.ndarray], b: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    n, m = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    ends = [np.array([-1]), np.array([-2])]
    x = np.concatenate([p for w in a for p in (w.astype(np.int64), ends[0])])
    y = np.concatenate([p for w in b for p in (w.astype(np.int64), ends[1])])
    x_at, y_at = np.cumsum(n + 1) - n - 1, np.cumsum(m + 1) - m - 1
    most = int(limit.max())
    middle = most + 1
    diagonal = np.arange(2 * most + 3) - middle  # place in b less place in a
    reach = np.full((len(a), len(diagonal)), -(1 << 30))
    reach[:, middle] = 0
    ok, pair = np.zeros(len(a), bool), np.arange(len(a))
    for edits in range(most + 1):
        if edits:
            new = reach + 1  # replaced
            np.maximum(new[:, 1:], reach[:, :-1], out=new[:, 1:])  # one more of b
            np.maximum(new[:, :-1], reach[:, 1:] + 1, out=new[:, :-1])  # one more of a
            reach = np.minimum(new, np.minimum(n[:, None], m[:, None] - diagonal))
        # Diagonals from which the end can still be reached.
        hopeful = np.abs(diagonal - (m - n)[:, None]) <= (limit - edits)[:, None]
        row, place = np.nonzero(hopeful & (reach >= 0) & (reach + diagonal >= 0))
        at = reach[row, place]
        here, there = x_at[row] + at, y_at[row] + at + diagonal[place]
        going, far = np.arange(len(at)), at.copy()
        while len(going):
            going = going[x[here[going]] == y[there[going]]]
            far[going] += 1
            here[going] += 1
            there[going] += 1
        reach[row, place] = far
        arrived = reach[np.arange(len(n)), middle + m - n] >= n
        ok[pair[arrived]] = True
        going_on = ~arrived & (limit > edits)
        # What is left as it is, is in order in both. That bound costs a small part of what the edits that are left do, and most pairs that aren't within the limit end there.
        for k in np.flatnonzero(going_on & (limit >= 16) & (limit // 16 == edits)).tolist():
            going_on[k] = m[k] - in_order(a[pair[k]].tolist(), b[pair[k]].tolist()) <= limit[k]
        stay = np.flatnonzero(going_on)
        if len(stay) < len(pair):
            pair, n, m, limit, x_at, y_at, reach = (z[stay] for z in (pair, n, m, limit, x_at, y_at, reach))
            if not len(pair):
                break
    return ok


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and their words' hashes; equal texts of a slice once."""
    words = worker_state("words", Words)
    for batch in slices(batches, "text", SLICE_BYTES):
        node = batch.column(0).to_pylist()
        lead = dict(zip(reversed(node), range(len(node) - 1, -1, -1), strict=True))
        batch = batch.take(pa.array(sorted(lead.values())))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words.of(t) for t in batch.column(1).to_pylist()], pa.binary())], ["node", "words"])


def _sketched(method: tuple[int, int, int]):
    """Rows (id, n, words) to (id, n, key), one for each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = worker_state(("sketches", method), lambda: OrderMinHash(*method))
        for batch in slices(batches, "words", SLICE_BYTES):
            sketches = sketcher.of([np.frombuffer(w, np.uint32) for w in batch.column(2).to_pylist()]).view(np.int64)
            ids, n = (np.repeat(batch.column(k).to_numpy(), sketches.shape[1]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n, pa.int32()), pa.array(sketches.ravel())], ["id", "n", "key"])

    return run


class Forest:
    """What links join so far; each node hangs below a smaller one."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        """False if they were joined before."""
        low, high = sorted((self.root(a), self.root(b)))
        if low != high:
            self.above[high] = low
        return low != high


def _verified(similarity: float):
    """Rows (a, b, x, y) to the links that join what all links of the task join. Pairs that are joined already are not aligned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("verify", dict)
        forest = Forest()
        for batch in slices(batches, "x", SLICE_BYTES):
            a, b, x, y = (column.to_pylist() for column in batch.columns)
            found, left = [], list(range(len(a)))
            for last in (False, False, True):
                left = [k for k in left if forest.root(a[k]) != forest.root(b[k])]
                # Those first that would join most, as their links may make the others needless.
                would, first = Forest(), set()
                if not last:
                    first = {k for k in left if would.join(forest.root(a[k]), forest.root(b[k]))}
                part = left if last else [k for k in left if k in first]
                ok = within([(np.frombuffer(x[k], np.uint32), np.frombuffer(y[k], np.uint32)) for k in part], similarity)
                found += [k for k, linked in zip(part, ok.tolist(), strict=True) if linked and forest.join(a[k], b[k])]
                left = [k for k in left if k not in first]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).take(pa.array(found, pa.int64()))
            if len(forest.above) > PAIRS:
                forest = Forest()

    return run


@dataclass
class Grams:
    """Runs of `size` words of several texts, labelled by how often they came before in their text and by the text's group."""

    start: np.ndarray  # of each text in `token`
    count: np.ndarray
    token: np.ndarray  # numbers, text by text
    prefix: np.ndarray  # (text, token, begin, end): texts at places `begin` to `end` have the same token in their prefix and another label
    who: np.ndarray

    def pairs(self) -> int:
        return int((self.prefix[3] - self.prefix[2]).sum())


def grams_of(words: list[np.ndarray], size: int, group: np.ndarray, label: np.ndarray, similarity: float) -> Grams:
    """An edit changes at most `size` runs, so of two texts within the similarity at least one shares a run with the other among
    its `size` * (1 - similarity) * words + 1 rarest ones. A text of fewer than `size` words is one run."""
    least = [w if len(w) >= size else np.append(w, np.full(size - len(w), _MOST >> np.uint64(1), np.uint64)) for w in words]
    flat = _mixed(np.concatenate(least).astype(np.uint64) * _M + np.uint64(1))
    length = np.array([len(w) for w in least], np.int64)
    count = length - size + 1
    text, start = np.repeat(np.arange(len(words)), count), np.cumsum(count) - count
    place = np.arange(len(text)) - start[text] + (np.cumsum(length) - length)[text]
    run = flat[place]
    for k in range(1, size):
        run = run * _M + flat[place + k]
    # Were two runs to get one hash, that could add a pair but lose none.
    key = _mixed(run + _mixed(text.astype(np.uint64) * _M))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    at = np.arange(len(key))
    occurrence = np.empty(len(key), np.int64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    labelled = _mixed(_mixed(run + occurrence.astype(np.uint64) * _M) + _mixed(group[text].astype(np.uint64) * _M + np.uint64(1)))
    _, token, frequency = np.unique(labelled, return_inverse=True, return_counts=True)
    order = np.lexsort((token, frequency[token], text))
    rank = at - start[text]  # place among the text's runs from the rarest on
    allowed = (np.array([len(w) for w in words]) * size * (1 - similarity) + 1e-9).astype(np.int64)
    prefix = order[(rank <= allowed[text]) & (frequency[token[order]] > 1)]
    prefix = prefix[np.lexsort((label[text[prefix]], token[prefix]))]
    who, what = text[prefix], token[prefix]
    # Behind each entry, the entries of the same run and another label.
    ends = np.searchsorted(what, what, side="right")
    change = np.ones(len(who), bool)
    change[1:] = (what[1:] != what[:-1]) | (label[who][1:] != label[who][:-1])
    begins = np.append(np.flatnonzero(change)[1:], len(who))[np.cumsum(change) - 1] if len(who) else ends
    return Grams(start, count, token, np.stack([who, what, begins, ends]), who)


def close_pairs(words: list[np.ndarray], group: np.ndarray, side: np.ndarray, label: np.ndarray, similarity: float, nodes: np.ndarray | None = None, failed: GenerationCache | None = None, elsewhere: Callable[[int, int], bool] = lambda a, b: False) -> list[tuple[int, int]]:
    """Pairs of texts of one group (on different sides, if the group has two) that join all the labels which verified pairs join.
    Words are 32-bit hashes; groups, sides and labels are numbers. No pair is left out but those that a bound rules out or whose
    labels are joined already. Pairs of neighbouring words serve as runs, or single words if they bring fewer pairs together. `failed` holds pairs of `nodes` that
    were verified before in vain, as many buckets hold the same pair, and `elsewhere` tells pairs of places that are left to another call."""
    nodes, failed = np.arange(len(words)) if nodes is None else nodes, GenerationCache(lambda pair: False, PAIRS) if failed is None else failed
    count = np.array([len(w) for w in words], np.int64)
    grams, size = grams_of(words, 2, group, label, similarity), 2
    if 2 * (1 - similarity) >= 1 or grams.pairs() > 4 * len(words):
        single = grams_of(words, 1, group, label, similarity)
        if 2 * (1 - similarity) >= 1 or single.pairs() < grams.pairs():
            grams, size = single, 1
    who, _, begins, ends = grams.prefix
    start, token, partners = grams.start, grams.token, ends - begins
    two = np.zeros(int(group.max()) + 1, bool)
    two[group[side == 1]] = True
    joined = label.copy()  # what links join so far
    out: list[tuple[int, int]] = []
    mark = np.zeros(int(token.max()) + 1 if len(token) else 1, bool)
    total = np.cumsum(partners)
    done, last = 0, 0
    while done < len(who):
        upto = max(done + 1, int(np.searchsorted(total, last + PAIRS, side="right")))
        times = partners[done:upto]
        left = np.repeat(who[done:upto], times)
        inner = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        right = who[np.repeat(begins[done:upto], times) + inner]
        last, done = int(total[upto - 1]), upto
        small, large = np.minimum(count[left], count[right]), np.maximum(count[left], count[right])
        ok = (small >= large * similarity - 1e-9) & ((side[left] != side[right]) | ~two[group[left]]) & (joined[left] != joined[right])
        pairs = np.unique(np.minimum(left, right)[ok] * len(words) + np.maximum(left, right)[ok])
        first, second = pairs // len(words), pairs % len(words)
        cuts = np.flatnonzero(np.diff(first, prepend=-1))
        for begin, end in zip(cuts.tolist(), np.append(cuts, len(pairs))[1:].tolist(), strict=True):
            a = int(first[begin])
            others = second[begin:end]
            others = others[joined[others] != joined[a]]
            if not len(others):
                continue
            tokens = token[start[a] : start[a] + grams.count[a]]
            mark[tokens] = True
            n = grams.count[others]
            before = np.cumsum(n) - n
            shared = np.add.reduceat(mark[token[np.arange(n.sum()) + np.repeat(start[others] - before, n)]].astype(np.int64), before)
            mark[tokens] = False
            most = np.maximum(count[a], count[others])
            limit = _limit(most, similarity)
            missing = np.maximum(most - size + 1, 1) - shared
            # The likeliest first, as a link to one text of a class makes the others needless.
            likely = np.argsort(missing / most, kind="stable")
            others = others[likely[(missing <= size * limit)[likely]]]
            others = others[[not elsewhere(a, b) for b in others.tolist()]]
            pairs_of_a = [(min(x, y), max(x, y)) for x in (int(nodes[a]),) for y in nodes[others].tolist()]
            others = others[[not failed[p] for p in pairs_of_a]]
            together = 1  # more and more, as the first link may make the others needless
            while len(others):
                part, others = others[:together], others[together:]
                ok = within([(words[a], words[b]) for b in part.tolist()], similarity)
                for b, linked in zip(part.tolist(), ok.tolist(), strict=True):
                    if not linked:
                        failed.put((min(int(nodes[a]), int(nodes[b])), max(int(nodes[a]), int(nodes[b]))), True)
                    elif joined[a] != joined[b]:
                        out.append((a, b))
                        joined[joined == joined[b]] = joined[a]
                others = others[joined[others] != joined[a]]
                together = 64
    return out


def _compared(similarity: float):
    """Rows (key, i, j, own, node, label, keys, words), sorted by key, i and j, to links. `keys` are all buckets of the node. Each pair is
    verified in one of the buckets that both its nodes are in, chosen by a hash, so that large groups, which share many, are not compared in each."""
    run_id = uuid.uuid4().hex  # the nodes' numbers are those of one call

    def links(rows: list[dict], failed: GenerationCache) -> pa.RecordBatch:
        numbers: dict = {}
        number = lambda x: numbers.setdefault(x, len(numbers))
        group = np.array([number((r["key"], r["i"], r["j"])) for r in rows])
        label = np.array([number(r["label"]) for r in rows])
        side = np.array([int(r["own"] != r["i"]) for r in rows])
        keys = [frozenset(r["keys"]) for r in rows]

        def elsewhere(a: int, b: int) -> bool:
            key, both = rows[a]["key"], keys[a] & keys[b]
            if len(both) < 2:
                return False
            mask = hash(tuple(sorted((rows[a]["node"], rows[b]["node"]))))  # of whole numbers, so the same in all workers
            return min(both, key=lambda k: hash((k, mask))) != key

        pairs = close_pairs([np.frombuffer(r["words"], np.uint32) for r in rows], group, side, label, similarity, np.array([r["node"] for r in rows]), failed, elsewhere)
        ends = [sorted((rows[a]["node"], rows[b]["node"])) for a, b in pairs]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = worker_state(("compare", similarity, run_id), lambda: GenerationCache(lambda pair: False, PAIRS // 4))
        held, total, last = [], 0, None
        for batch in slices(batches, "words", SLICE_BYTES):
            for row in batch.to_pylist():
                group = row["key"], row["i"], row["j"]
                if group != last and total >= BLOCK_WORDS:
                    yield links(held, failed)
                    held, total = [], 0
                held.append(row)
                total, last = total + len(row["words"]) // 4, group
        if held:
            yield links(held, failed)

    return run


def _measured(df: DataFrame) -> tuple[DataFrame, int, object]:
    """Links (a, b) written, how many there are and a sum of their hashes, in one pass."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")))
    return table, seen.get["n"], seen.get["s"]


def components(links: DataFrame) -> DataFrame:
    """(id, label) of the nodes of links (a, b): label is the smallest node of the component. Alternates large and small stars
    (Kiveris and others, 2014) until each node hangs on one root; each round is written to the shared folder and the one before dropped. A hub's links are many rows of one
    key: least neighbours are written before they are joined, so that those rows can be split."""
    edges, n, s = _measured(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large, moved, sum_of_moved = _measured(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low, leaves, _ = _measured(large.groupBy("a").agg(F.min("b").alias("b")))
        # Large stars change nothing if no node has both smaller and larger neighbours; small ones neither if each leaf then has one root.
        done = (moved, sum_of_moved, leaves) == (n, s, n)
        if not done:
            small = large.join(low.withColumnRenamed("b", "m"), "a")
            new, n, s = _measured(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
            drop(edges)
            edges = new
        drop(least, large, low)
        if done:
            break
    labels = edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    found = written(labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct()))
    drop(edges)
    return found


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels as components() gives them, after more links: only what these join is looked at."""
    own = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"label_{side}"))
    named = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    above = components(named.where("a != b"))
    moved = labels.join(above.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "left").select("id", F.coalesce("top", "label").alias("label"))
    return written(moved.unionByName(above.join(labels, "id", "left_anti")))


def _node(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def node_classes(docs: DataFrame, similarity: float = 0.8, size: int = 5, kept: int = 2, sketches: int = 80, text_column: str = "text") -> DataFrame:
    """(node, label) of the distinct texts that are linked to another one; a label is a number."""
    text = F.col(text_column)
    texts = docs.where(text.isNotNull()).select(_node(text).alias("node"), text.alias("text"))
    distinct = texts.mapInArrow(_worded, "node binary, words binary").groupBy("node").agg(F.first("words").alias("words"))
    # Written once, so that what numbers the nodes stays.
    nodes = written(distinct.select(F.monotonically_increasing_id().alias("id"), "node", (F.octet_length("words") / 4).cast("int").alias("n"), "words"))
    words = nodes.select("id", "words")
    keys = written(nodes.where("n > 0").select("id", "n", "words").mapInArrow(_sketched((size, kept, sketches)), "id long, n int, key long"))
    # Most sketches are of one node alone.
    several = written(keys.groupBy("key").agg(F.count("*").alias("b")).where("b > 1").select("key"))
    members = written(keys.join(several, "key").select("key", "id", "n"))
    drop(keys, several)
    ends = written(members.groupBy("key").agg(F.min("id").alias("low"), F.min_by("n", "id").alias("low_n"), F.max("id").alias("high"), F.max_by("n", "id").alias("high_n")))
    buckets = written(members.join(ends, "key"))
    drop(members, ends)

    def verified(pairs: DataFrame) -> DataFrame:
        close = F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-9
        pairs = pairs.where(F.col("id") != F.col("other")).where(close).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        left = pairs.join(words.select(F.col("id").alias("a"), F.col("words").alias("x")), "a")
        full = left.join(words.select(F.col("id").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y")
        return full.mapInArrow(_verified(similarity), "a long, b long")

    pairs = buckets.select("id", "n", F.col("low").alias("other"), F.col("low_n").alias("m")).unionByName(buckets.select("id", "n", F.col("high").alias("other"), F.col("high_n").alias("m")))
    links = written(verified(pairs))
    labels = components(links)
    # Buckets of up to three nodes are done: each pair has the smallest or largest node.
    named = written(buckets.join(labels, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label")))
    drop(buckets)
    hashed = F.xxhash64("id").cast("decimal(38,0)")
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("b"), F.sum("n").alias("total"), F.sum(hashed).alias("s"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("t")).where("b > 3 and low != high")
    # Of buckets with the same nodes one is compared.
    mixed = written(mixed.groupBy("b", "s", "t").agg(F.min("key").alias("key"), F.max(F.ceil(F.col("total") / BLOCK_WORDS)).cast("int").alias("blocks")).select("key", "blocks"))
    # The compared buckets of each node, at most one a sketch.
    compared = written(named.join(mixed.select("key"), "key").groupBy("id").agg(F.collect_list("key").alias("keys")).withColumnRenamed("id", "node").join(words.withColumnRenamed("id", "node"), "node"))
    whole = named.join(mixed.where("blocks = 1"), "key").withColumn("own", F.lit(0)).withColumn("other", F.lit(0))
    blocks = named.join(mixed.where("blocks > 1"), "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = whole.unionByName(blocks)
    blocks = blocks.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.col("id").alias("node"), "label").join(compared, "node")
    blocks = blocks.select("key", "i", "j", "own", "node", "label", "keys", "words").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    new = written(blocks.mapInArrow(_compared(similarity), "a long, b long").distinct())
    if not new.isEmpty():
        labels = joined_labels(labels, new)
    found = written(nodes.select("id", "node").join(labels, "id").select("node", "label"))
    drop(named, mixed, compared, new, links, labels, nodes)
    return found


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """(id, class_id, class_size) of every row; class_id is the smallest id of the class."""
    labels = node_classes(docs, text_column=text_column, **settings)
    rows = docs.select(F.col(id_column).alias("id"), _node(F.col(text_column)).alias("node"))
    # One row for each distinct text, however many copies it has.
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("rows")).join(labels, "node", "left")
    linked = nodes.where("label is not null").groupBy("label").agg(F.min("first").alias("class_id"), F.sum("rows").alias("class_size"))
    named = nodes.join(linked, "label", "left").select("node", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("class_size", "rows").alias("class_size"))
    # Written before it meets the rows, so that a text with very many copies can be split among tasks.
    joined = rows.join(written(named), "node", "left")
    return joined.select(F.col("id").alias(id_column), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one of each class stays: that with the smallest id. Which
    stays is settled on ids and hashes; texts move once, by id and hash, so that copies don't meet in one task."""
    labels = node_classes(docs, text_column=text_column, **settings)
    text = F.col(text_column)
    slim = docs.where(text.isNotNull()).select(F.col(id_column).alias("id"), _node(text).alias("node"))
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node")).alias("first")
    nodes = slim.groupBy("node").agg(F.min("id").alias("id")).join(labels, "node", "left")
    alone = nodes.where("label is null").select("id", "node")
    chosen = written(alone.unionByName(nodes.where("label is not null").groupBy("label").agg(least).select("first.id", "first.node")))
    packed = docs.where(text.isNotNull()).select(F.struct(*docs.columns).alias("row"), F.col(id_column).alias("own"), _node(text).alias("hash"))
    kept = packed.join(chosen, F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("node")), "left_semi")
    # Rows with the same id and text.
    return kept.dropDuplicates(["own", "hash"]).select("row.*").unionByName(docs.where(text.isNull()))

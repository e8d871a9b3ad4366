"""Removal of repeated byte windows, by a depth-limited radix sort of suffixes.

A byte goes if it lies in a string of `depth` bytes that also starts anywhere else. To know this, suffixes need only be
ordered through `depth` bytes: those that are then still equal are the repeated windows.

Suffixes are not shuffled one by one. Each window of `depth` bytes has an anchor: the gram of `GRAM` bytes in it with the
smallest hash, the first of equals. It depends on the window's content alone, so equal windows have equal anchors at
equal places. The anchor's hash is the most significant digit: windows are dealt out by it, one row for each run
of windows with the same anchor (about 85 of them).

1. Rows of one digit whose whole runs have the same content (a second hash) are repeated throughout. Within a
   task such rows are combined before the shuffle: two of them at most keep their digit (of contents that are still remembered), so copies in any
   number send few rows to it.
2. A run that is alone with its content, but not with its digit, may share some windows with others: its bytes are fetched,
   and the runs of one digit are sorted from the anchor to the right and to the left by passes of eight bytes,
   most significant first; runs that stand alone drop out. The common prefixes of neighbours give classes for
   each depth, and a window is repeated if another run has both its right and its left class.
   Digits with over `largest` such runs are not sorted in one task but split by further passes: a run is cut by the distance of its windows
   from the anchor into ranges, and the next digit is a hash of the bytes around the anchor that all windows of a range hold. Each pass
   deals the rows out anew, ranges become shorter by `SPLIT`, and digits that are no longer large are sorted. Where ranges of one
   window are still large, the digit is of all its bytes, and windows are counted by it.
3. Spans are joined to the texts again and cut out.

Wherever hashes decide that runs, windows or texts are equal without a look at the bytes, they have 128 bits.

Edge cases: null and empty texts, and those under `depth` bytes, lose nothing and give empty bytes or what they had.
Repeated rows are each other's repeats. Ids may be null or repeated; other columns, whatever their names, are left out by remove_repeats() and kept by cut_repeats(). An empty table gives an empty table. Spans are byte
offsets; `kept` may break a character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GenerationCache, ids_schema, slices, worker_state, written

GRAM = 32
SLICE_BYTES = 2 << 20
#: Windows that are searched for anchors at once; a place within them takes the low bits of a key.
SPAN = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15
_LETTERS = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)
#: Contents of runs that a task remembers to have sent.
SENT = 100_000
#: Ranges that a pass over large digits makes of one.
SPLIT = 4
#: Runs that are sorted together in one pass of numpy calls.
SORT_ROWS = 20_000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, by doubling the length."""
    h, size = _LETTERS[data], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(_MULTIPLIER, size, 1 << 64)) + h[size:]
        size *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` keys, from minima of aligned blocks to the left and right."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchored_runs(data: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor's place, anchor's hash) of all runs of windows with one anchor. `bounds` are
    the texts' limits in `data`; no window crosses one."""
    found: list[tuple] = []
    for low in range(0, max(0, len(data) - depth + 1), SPAN):
        part = data[low : low + SPAN + depth - 1]
        hashes = gram_hashes(part)
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        at = (sliding_minimum(keys, depth - GRAM + 1) & _PLACE).astype(np.int64)
        n = len(at)
        change = np.zeros(n + 1, np.int32)  # windows that lie in one text
        starts, ends = np.clip(bounds[:-1] - low, 0, n), np.clip(bounds[1:] - depth + 1 - low, 0, n)
        ok = ends > starts
        np.add.at(change, starts[ok], 1)
        np.add.at(change, ends[ok], -1)
        valid = np.cumsum(change[:-1]) > 0
        edge = np.zeros(n, bool)  # a text's first window begins a run
        edge[starts[ok]] = True
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
        first = np.flatnonzero((new | edge) & valid)
        stop = np.ones(n, bool)
        stop[:-1] = new[1:] | edge[1:] | ~valid[1:]
        last = np.flatnonzero(stop & valid)
        found.append((first + low, last + low, at[first] + low, hashes[at[first]]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 4))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in a row, and their limits; null counts as empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_binary())
    size = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[size[0] : size[-1]]
    return data, size - size[0]


def radix_classes(groups: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows of big-endian words within their groups by passes over the words, most significant first. Returns the order and, for each
    place in it, how many bytes the row shares with the one before it; -1 where a group begins."""
    order = np.argsort(groups, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = groups[order][1:] == groups[order][:-1]
    common = np.where(same, 8 * words.shape[1], -1)
    for k in range(words.shape[1]):
        busy = same.copy()
        busy[:-1] |= same[1:]
        busy = np.flatnonzero(busy)
        if not len(busy):
            break
        rows, block = order[busy], np.cumsum(~same[busy])
        rows = rows[np.lexsort((words[rows, k], block))]
        order[busy] = rows
        differ = words[rows[1:], k] ^ words[rows[:-1], k]
        split = np.flatnonzero((differ != 0) & same[busy[1:]])
        x = differ[split]
        common[busy[1:][split]] = 8 * k + sum((x < np.uint64(1 << 8 * t)).astype(np.int64) for t in range(1, 8))
        same[busy[1:][split]] = False
    return order, common


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), ">u8").reshape(len(parts), width // 8).astype(np.uint64)


def repeated_windows(groups: np.ndarray, contexts: list[bytes], before: np.ndarray, runs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window within its run) of all windows that another row of the same group holds at the same distance from its anchor.

    contexts: the bytes from each run's first window to the end of its last; before: from there to the anchor; runs: windows less 1."""
    right = radix_classes(groups, _matrix([c[b : b + depth] for c, b in zip(contexts, before.tolist(), strict=True)], depth))
    left = radix_classes(groups, _matrix([c[:b][::-1] for c, b in zip(contexts, before.tolist(), strict=True)], depth - GRAM))
    rows, windows = [], []
    n = len(groups)
    classes = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for back in range(depth - GRAM + 1):  # from the window's first byte to the anchor
        part = np.flatnonzero((before >= back) & (before - runs <= back))
        if len(part) < 2:
            continue
        for own, (order, common), size in zip(classes, (right, left), (depth - back, back), strict=True):
            own[order] = np.cumsum(common < size)
        key = classes[0][part] * (n + 1) + classes[1][part]
        order = np.argsort(key)
        equal = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(part), bool)
        twice[:-1] |= equal
        twice[1:] |= equal
        hit = part[order[twice]]
        rows.append(hit)
        windows.append(before[hit] - back)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(windows)) if rows else (empty, empty)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype != np.int64 else x, pa.int64())


_RUN_SCHEMA = "h long, c long, k long, j long, p long"
#: Bits of a run's place in p: bytes before the anchor, windows less 1, and how often its content occurred (2: at least twice).
_BITS = 12


def _place(column: str = "p") -> tuple[Column, Column, Column, Column]:
    """(first, before, run, n) of a packed place."""
    p, mask = F.col(column), (1 << _BITS) - 1
    return F.shiftright(p, 2 * _BITS + 2).cast("int"), F.shiftright(p, _BITS + 2).bitwiseAND(mask).cast("int"), F.shiftright(p, 2).bitwiseAND(mask).cast("int"), p.bitwiseAND(3).cast("int")


def _runs(depth: int):
    """One row for each run of windows: its digit, a hash of its content, its text, and its place with how often the content occurred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("repeats", dict)
        sent = GenerationCache(lambda content: 0, SENT)  # of this task, so that a lost task loses it too
        for batch in slices(batches, "text", SLICE_BYTES):
            data, bounds = _bytes_of(batch.column(2))
            first, last, at, h = anchored_runs(data, bounds, depth)
            view, digest = memoryview(data), xxhash.xxh3_64_intdigest
            before, more = at - first, last - first
            c = np.fromiter((digest(view[a:b], s) for a, b, s in zip(first.tolist(), (last + depth).tolist(), (before << _BITS | more).tolist(), strict=True)), np.uint64, len(first))
            owner = np.searchsorted(bounds, first, "right") - 1
            k, j = (batch.column(x).to_numpy()[owner] for x in (0, 1))
            place = first - bounds[owner]
            # Of equal runs two at most keep their digit. The others are known to be repeated: they get digits of their own.
            both = np.column_stack([h, c])
            _, lead, inverse, times = np.unique(both.view([("h", np.uint64), ("c", np.uint64)]).ravel(), return_index=True, return_inverse=True, return_counts=True)
            contents = both[lead].tobytes()
            earlier = np.fromiter((sent[contents[x : x + 16]] for x in range(0, len(contents), 16)), np.int64, len(lead))
            total = np.minimum(earlier + times, 2)
            for x in np.flatnonzero(total > earlier).tolist():
                sent.put(contents[16 * x : 16 * x + 16], int(total[x]))
            other = np.ones(len(h), bool)
            other[lead[earlier < 2]] = False
            h = np.where(other, (k.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) + place.astype(np.uint64) * np.uint64(_MULTIPLIER), h)
            p = ((place << _BITS | before) << _BITS | more) << 2 | total[inverse]
            yield pa.RecordBatch.from_arrays([_long(x) for x in (h, c, k, j, p)], ["h", "c", "k", "j", "p"])

    return run


_PIECE_SCHEMA = "g long, k long, j long, first int, before int, run int, bytes binary"
_PIECE_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def _pieces(rows: list[tuple], more: dict[str, pa.DataType] | None = None) -> pa.RecordBatch:
    kinds = dict(zip(["g", "k", "j", "first", "before", "run", "bytes"], _PIECE_KINDS, strict=True)) | (more or {})
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def _fetch(depth: int):
    """The bytes of the runs that a text has to show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            out = []
            for k, j, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                out += [(r["h"], k, j, r["first"], r["before"], r["run"], data[r["first"] : r["first"] + r["run"] + depth]) for r in runs]
            yield _pieces(out)

    return run


def _refined(depth: int, width: int):
    """Pieces of runs whose windows begin within `width` places of one another, under the digit of the bytes that all such windows hold.
    Of equal pieces of a slice one keeps its digit; as they are repeated throughout, each is also given as `done`. Pieces of one window
    have 16 bytes of hashes in place of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("repeats", dict)
        for batch in slices(batches, "bytes", SLICE_BYTES):
            found: dict[tuple[int, int, int, bytes], list[tuple[int, int, int]]] = {}
            for _, k, j, first, before, more, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for q in range((before - more) // width, before // width + 1):
                    furthest, nearest = min(before, (q + 1) * width - 1), max(before - more, q * width)
                    skip, rest = before - furthest, furthest - nearest
                    found.setdefault((q, furthest, rest, data[skip : skip + rest + depth]), []).append((k, j, first + skip))
            out = []
            for (q, before, more, data), places in found.items():
                low, high = q * width, min((q + 1) * width - 1, depth - GRAM)
                digest = xxhash.xxh3_128_digest(data[before - low : before + depth - high], seed=q)
                g = int.from_bytes(digest[:8], "big", signed=True)
                out.append((g, *places[0], before, more, digest if width == 1 else data, False))
                if len(places) > 1:
                    out += [(g, *place, before, more, b"", True) for place in places]
            yield _pieces(out, {"done": pa.bool_()})

    return run


def _sorted_groups(depth: int):
    """Repeated windows of rows that come sorted by digit; whole digits are gathered up to SORT_ROWS rows."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        g, k, j, first, before, run = (np.array([r[x] for r in rows], np.int64) for x in range(6))
        row, window = repeated_windows(g, [r[6] for r in rows], before, run, depth)
        k, j, p = k[row], j[row], first[row] + window
        order = np.lexsort((p, j, k))
        k, j, p = k[order], j[order], p[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (j[1:] != j[:-1]) | (p[1:] > p[:-1] + depth)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(k)) - 1 if len(k) else heads
        return pa.RecordBatch.from_arrays([_long(k[heads]), _long(j[heads]), pa.array(p[heads], pa.int32()), pa.array(p[tails] + depth, pa.int32())], ["k", "j", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= SORT_ROWS and row[0] != held[-1][0]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)

    return run


def _split_large(pieces: DataFrame, depth: int, largest: int) -> tuple[DataFrame, DataFrame]:
    """(pieces of digits that are no longer large, spans) of the pieces of large digits."""
    end = (F.col("first") + F.col("run") + depth).alias("end")
    width, small, spans = depth - GRAM + 1, pieces.where("false"), None
    while True:
        width = -(-width // SPLIT)
        parts = written(pieces.mapInArrow(_refined(depth, width), f"{_PIECE_SCHEMA}, done boolean"))
        done = parts.where("done").select("k", "j", "first", end)
        spans = done if spans is None else spans.unionByName(done)
        parts = parts.where("not done").drop("done")
        if width == 1:
            # What brings a hot window together is written first, so that the join can be sent out or split.
            twice = written(parts.groupBy("bytes").agg(F.count("*").alias("m")).where("m > 1").select("bytes"))
            return small, spans.unionByName(parts.join(twice, "bytes", "left_semi").select("k", "j", "first", end))
        large = written(parts.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > largest).select("g"))
        small = small.unionByName(parts.join(large, "g", "left_anti"))
        if large.isEmpty():
            return small, spans
        pieces = parts.join(large, "g", "left_semi").select(*pieces.columns)


def _merged(spans: list[dict] | None) -> list[dict]:
    merged: list[dict] = []
    for first, end in sorted((r["first"], r["end"]) for r in spans or ()):
        if merged and first <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], end)
        else:
            merged.append({"first": first, "end": end})
    return merged


def _without(data: bytes, spans: list[dict]) -> bytes:
    edges = [0, *(x for m in spans for x in (m["first"], m["end"])), len(data)]
    return b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def _cut(id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            spans = [_merged(x) for x in batch.column(2).to_pylist()]
            kept = [_without((t or "").encode(), x) for t, x in zip(batch.column(1).to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))], [id_column, "kept", "spans"])

    return run


def _cut_texts(place: int, column: str):
    """The last column has the spans; texts with spans are replaced by what is left, as UTF-8 without broken characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, SLICE_BYTES):
            texts = [t if not x else _without(t.encode(), _merged(x)).decode("utf-8", "ignore") for t, x in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def _free(df: DataFrame, name: str) -> str:
    """A name that no column has."""
    while name in df.columns:
        name += "_"
    return name


def _keys(id_column: str, text_column: str) -> tuple[Column, Column]:
    """128 bits for the id and text of a row."""
    own, text = F.col(id_column).cast("string"), F.col(text_column)
    return F.xxhash64(own, text).alias("k"), F.xxhash64(F.lit(7), text, own).alias("j")


def repeated_spans(docs: DataFrame, depth: int, largest: int, id_column: str, text_column: str) -> DataFrame:
    """(k, j, found): the spans to cut of the texts with keys k and j."""
    if depth >> _BITS or depth <= GRAM:
        raise ValueError(f"depth must be over {GRAM} and under {1 << _BITS}")
    text, keys = F.col(text_column), _keys(id_column, text_column)
    runs = docs.where(F.octet_length(text) >= depth).select(*keys, text.alias("text")).mapInArrow(_runs(depth), _RUN_SCHEMA)
    digit, content = Window.partitionBy("h"), Window.partitionBy("h").orderBy("c")
    near = lambda f: F.coalesce(f("c").over(content) == F.col("c"), F.lit(False))
    first, before, run, n = _place()
    judged = (
        runs.withColumn("led", near(F.lag))
        .withColumn("repeated", F.col("led") | near(F.lead) | (n > 1))
        .withColumn("several", F.min("c").over(digit) != F.max("c").over(digit))
        .withColumn("shown", F.col("several") & ~F.col("led"))
        .where(F.col("repeated") | F.col("shown"))
        .select("h", "k", "j", first.alias("first"), before.alias("before"), run.alias("run"), "repeated", "shown")
    )
    judged = written(judged)
    shown = judged.where("shown").select("h", "k", "j", "first", "before", "run")
    # Written, so that the join knows its size: it is sent to all tasks if it is small, and else a large digit's rows can be split.
    large = written(shown.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > largest).select("h"))
    texts = docs.where(F.octet_length(text) >= depth).select(*keys, text.alias("text"))

    def fetched(runs: DataFrame) -> DataFrame:
        # Sets: rows with the same id and text ask for the same, so a list has no more than one text's runs.
        asked = runs.groupBy("k", "j").agg(F.collect_set(F.struct("h", "first", "before", "run")).alias("runs"))
        return texts.join(asked, ["k", "j"]).select("k", "j", "text", "runs").mapInArrow(_fetch(depth), _PIECE_SCHEMA)

    whole = judged.where("repeated").select("k", "j", "first", (F.col("first") + F.col("run") + depth).alias("end"))
    if large.isEmpty():
        pieces = fetched(shown)
    else:
        pieces, spans = _split_large(fetched(shown.join(large, "h", "left_semi")), depth, largest)
        pieces, whole = fetched(shown.join(large, "h", "left_anti")).unionByName(pieces), whole.unionByName(spans)
    partial = pieces.repartition("g").sortWithinPartitions("g").mapInArrow(_sorted_groups(depth), "k long, j long, first int, end int")
    return whole.unionByName(partial).groupBy("k", "j").agg(F.collect_set(F.struct("first", "end")).alias("found"))


def remove_repeats(docs: DataFrame, depth: int = 200, largest: int = 1_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row its id, `kept` binary (the bytes that stay) and `spans` (first, end) of what went."""
    spans = repeated_spans(docs, depth, largest, id_column, text_column)
    given = docs.select(*_keys(id_column, text_column), F.col(id_column).alias("own"), F.col(text_column).alias("text")).join(spans, ["k", "j"], "left")
    return given.select(F.col("own").alias(id_column), "text", "found").mapInArrow(_cut(id_column), f"{ids_schema(docs, id_column)}, kept binary, spans array<struct<first: int, end: int>>")


def cut_repeats(docs: DataFrame, depth: int = 200, largest: int = 1_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, their texts without repeated windows. Rows of which nothing is left go."""
    spans = repeated_spans(docs, depth, largest, id_column, text_column)
    given = docs.select(*_keys(id_column, text_column), F.struct(*docs.columns).alias("row")).join(spans, ["k", "j"], "left")
    cut = given.select("row.*", F.col("found").alias(_free(docs, "found"))).mapInArrow(_cut_texts(docs.columns.index(text_column), text_column), docs.schema)
    return cut.where(F.col(text_column).isNull() | (F.col(text_column) != ""))

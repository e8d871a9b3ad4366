"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Components x become floor(64 x); a score is the inner product of two such vectors. Candidates are packed in blocks; in each,
every dimension has a list of the block's vectors in the order of that component. For a query, lists with a positive
component are read from the top and those with a negative one from the bottom (a zero one not at all), all to the same depth. What has been
seen is scored, and nothing else; no unseen vector can score more than the bound, the sum over dimensions of query component times list entry at
that depth. A block is left as soon as the bound is below the query's k-th score so far (from this and earlier blocks). On equality it is read on,
as a smaller id may win the tie.

Depths double. As the bound at a depth doesn't depend on what was scored, a query with k scores goes straight to the first depth whose bound is below
its k-th. Where the lists to that depth hold nearly all vectors of the block anyway, the block is read to its end and scored in one
product. In many dense dimensions that is the usual case: the bound adds up the best entries of all lists, which no vector has together.

Queries, every row whose id is divisible by `every`, come in blocks of at most `queries` rows; each block is broadcast and meets all candidates in one pass over them. Each
partition of candidates gives at most k rows a query, which a ranking by query merges. No candidate is moved for its queries' sake.

Edge cases: vectors that are null or hold a null or non-finite component take no part. Vectors of another length than the query's are no candidates of it.
Null ids take no part. Repeated rows are candidates each; a query given twice is answered once, by its first vector, and a row with the query's
id is no candidate of it. With fewer than k candidates all are returned. An empty table gives an empty table, and vectors without components score 0. Scores that
doubles cannot hold exactly are computed with whole numbers; those beyond 64 bits raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Candidates of a block.
BLOCK = 8192
#: Places of each list that are read at first.
FIRST_DEPTH = 16
#: A block is read to its end if fewer vectors than this are expected to stay unseen.
UNSEEN = 0.5
#: Queries that go through a block together.
TOGETHER = 512


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * 64).cast("long"))
    return vectors.where(v.isNotNull() & ~bad & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), whole.alias("v"))


def products(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products (queries, vectors) of whole numbers, exact."""
    if not x.shape[1]:
        return np.zeros((len(queries), len(x)), np.int64)
    top = (int(np.abs(queries).max(initial=0)) * int(np.abs(x).max(initial=0))) * x.shape[1]
    if top < 1 << 53:
        return (queries.astype(float) @ x.T.astype(float)).astype(np.int64)
    if top >= 1 << 63:
        raise ValueError("scores beyond 64 bits")
    return queries @ x.T


class Candidates:
    """A block of candidates with the sorted list of each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.n = ids, x, len(ids)
        self.order = np.argsort(x, axis=0, kind="stable")
        self.lists = np.take_along_axis(x, self.order, axis=0)  # ascending

    def seen(self, query: np.ndarray, old: int, depth: int) -> np.ndarray:
        """Places of the candidates that stand within `depth` places in some list as the query reads it, and within `old` places in none."""
        mark = np.zeros(self.n, bool)
        mark[self.order[self.n - depth :, query > 0]] = True
        mark[self.order[:depth, query < 0]] = True
        if old:
            mark[self.order[self.n - old :, query > 0]] = False
            mark[self.order[:old, query < 0]] = False
        return np.flatnonzero(mark)

    def bound(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """What no candidate beyond that depth can exceed."""
        return np.where(queries > 0, queries * self.lists[self.n - depth], queries * self.lists[depth - 1]).sum(1)


class BestOfQueries:
    """The k best candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.held = np.zeros(len(ids), np.int64)
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merges new candidates of query q."""
        own = ids != self.ids[q]
        if not own.all():
            scores, ids = scores[own], ids[own]
        if self.held[q] == self.k:
            better = scores >= self.scores[q, -1]
            scores, ids = scores[better], ids[better]
        if len(scores) > self.k:
            better = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[better], ids[better]
        if len(scores):
            held = self.held[q]
            s, n = np.concatenate([self.scores[q, :held], scores]), np.concatenate([self.found[q, :held], ids])
            order = np.lexsort((n, -s))[: self.k]
            self.held[q] = len(order)
            self.scores[q, : len(order)], self.found[q, : len(order)] = s[order], n[order]

    def search(self, block: Candidates) -> int:
        """The threshold algorithm over one block of candidates; returns how many products of vectors were computed."""
        depths = [d for d in (FIRST_DEPTH * 2**e for e in range(32)) if d < block.n]
        bounds = np.stack([block.bound(self.queries, d) for d in depths], axis=1) if depths else np.zeros((len(self.ids), 0))
        lists = np.count_nonzero(self.queries, axis=1)
        computed, whole = 0, []
        for q in range(len(self.ids)):
            old = step = 0
            while True:
                if self.held[q] == self.k:
                    below = np.flatnonzero(bounds[q] < self.scores[q, -1])
                    step = int(below[0]) if len(below) else len(depths)
                    if step < len(depths) and depths[step] <= old:
                        break
                depth = depths[step] if step < len(depths) else block.n
                if depth == block.n or block.n * (1 - depth / block.n) ** lists[q] < UNSEEN:
                    if not old:
                        whole.append(q)
                        break
                    depth = block.n
                    mark = np.ones(block.n, bool)
                    mark[block.seen(self.queries[q], 0, old)] = False
                    new = np.flatnonzero(mark)
                else:
                    new = block.seen(self.queries[q], old, depth)
                computed += len(new)
                self.take(q, products(self.queries[q : q + 1], block.x[new])[0], block.ids[new])
                old, step = depth, step + 1
                if depth == block.n:
                    break
        for k in range(0, len(whole), TOGETHER):
            part = whole[k : k + TOGETHER]
            computed += len(part) * block.n
            for q, scores in zip(part, products(self.queries[part], block.x), strict=True):
                self.take(q, scores, block.ids)
        return computed


def _searched(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: BestOfQueries(*of_length, k) for n, of_length in shared.value.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in best}
        for batch in batches:
            size, values = batch.column(1).value_lengths().to_numpy(), batch.column(1).flatten().to_numpy()
            ends = np.cumsum(size, dtype=np.int64)
            for n, parts in held.items():
                rows = np.flatnonzero(size == n)
                if len(rows):
                    parts.append((batch.column(0).to_numpy()[rows], values[(ends[rows] - n)[:, None] + np.arange(n)]))
                while sum(len(x) for x, _ in parts) >= BLOCK:
                    ids, x = np.concatenate([h[0] for h in parts]), np.concatenate([h[1] for h in parts])
                    parts[:] = [(ids[BLOCK:], x[BLOCK:])]
                    best[n].search(Candidates(ids[:BLOCK], x[:BLOCK]))
        for n, parts in held.items():
            if sum(len(x) for x, _ in parts):
                best[n].search(Candidates(np.concatenate([h[0] for h in parts]), np.concatenate([h[1] for h in parts])))
        for b in best.values():
            real = np.arange(k) < b.held[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.ids, b.held)), pa.array(b.found[real]), pa.array(b.scores[real])], ["query_id", "vec_id", "score"])

    return run


def _blocks(asked: DataFrame, size: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries by length of vector, `size` at a time on the driver."""
    held: dict[int, tuple[list, list]] = {}
    count = 0
    packed = lambda: {n: (np.array(ids, np.int64), np.array(rows, np.int64).reshape(len(ids), n)) for n, (ids, rows) in held.items()}
    for r in asked.toLocalIterator():
        ids, rows = held.setdefault(len(r.v), ([], []))
        ids.append(r.id)
        rows.append(r.v)
        count += 1
        if count == size:
            yield packed()
            held.clear()
            count = 0
    if held:
        yield packed()


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, queries: int = 32_768, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, ties to the smaller id."""
    candidates = written(whole_vectors(vectors, id_column, vector_column))
    asked = written(candidates.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    schema, found = "query_id long, vec_id long, score long", None
    for block in _blocks(asked, queries):
        part = candidates.mapInArrow(_searched(vectors.sparkSession.sparkContext.broadcast(block), k), schema)
        found = part if found is None else found.unionByName(part)
    found = vectors.sparkSession.createDataFrame([], schema) if found is None else found
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = 20, every: int = 20) -> str:
    return f"""
with w as (select cast(vec_id as bigint) as id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 64) as double)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.id as query_id, c.id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from w q join w c on q.id <> c.id where q.id % {every} = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= {k}"""

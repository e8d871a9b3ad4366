"""Token counts by a map-side lookup of two tiers.

Pre-tokens here are the runs of a text without white space: the tokenizer drops white space and its pattern never
crosses it, so a text's count is the sum over its runs. Tier one is a table of the lengths of frequent pre-tokens,
broadcast to all workers (at most `frequent` entries: one string of the pre-tokens and an array of lengths). Tier two is each worker's own cache; what it lacks is encoded by the
library in one batch for each slice. Pre-tokens are never shuffled.

Which pre-tokens are taken as frequent is read off about `sample_rows` rows of the whole table, chosen by a hash of id and text; it changes the
speed and never a count.

Edge cases: a null or empty text, or one of white space only, has no tokens. Special strings inside a text count as the
library counts them. Null or repeated ids pass through; other columns are left out. An empty table gives an empty table.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_schema, slices, split_words, worker_state

SLICE_BYTES = 2 << 20
#: Longer rows aren't looked at for the table of frequent pre-tokens.
SAMPLE_BYTES = 16_000
#: Pre-tokens that a worker holds beyond the broadcast table before it drops them and begins anew.
CACHE = 300_000


class Lengths:
    """Numbers of tokens of pre-tokens, for one tokenizer file."""

    def __init__(self, path: str, words: str, lengths: np.ndarray):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.frequent = words, lengths
        self.known: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        """Tier one alone."""
        words, lengths = self.frequent
        self.known = dict(zip(words.split("\n") if words else (), lengths.tolist(), strict=True))

    def learn(self, words: set[str]) -> None:
        if len(self.known) > len(self.frequent[1]) + CACHE:
            self.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, (len(e) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        words = [split_words(t) for t in texts]
        self.learn(set(chain.from_iterable(words)))
        length = self.known.__getitem__
        return [sum(map(length, w)) for w in words]


def frequent_lengths(docs: DataFrame, path: str, frequent: int, sample_rows: int, id_column: str, text_column: str) -> tuple[str, np.ndarray]:
    """The `frequent` commonest pre-tokens of about `sample_rows` rows of at most SAMPLE_BYTES bytes, joined by line ends (no pre-token has one), and their lengths."""
    share = int(min(1.0, sample_rows / max(1, docs.count())) * 2**53)
    taken = F.shiftrightunsigned(F.xxhash64(F.col(id_column).cast("string"), F.col(text_column), F.lit("sample")), 11) < share
    # About sample_rows rows; the limit bounds what reaches the driver if very many are equal.
    rows = docs.where(taken & (F.octet_length(text_column) <= SAMPLE_BYTES)).select(text_column).take(2 * sample_rows)
    counts = Counter(chain.from_iterable(split_words(r[0]) for r in rows))
    lengths = Lengths(path, "", np.zeros(0, np.uint16))
    words = [w for w, _ in counts.most_common(frequent)]
    lengths.learn(set(words))
    return "\n".join(words), np.array([lengths.known[w] for w in words], np.uint16)


def count_tokens(docs: DataFrame, path: str, frequent: int = 50_000, sample_rows: int = 2_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row its id, `n_bytes` (UTF-8) and `n_tokens`."""
    spark = docs.sparkSession
    key = uuid.uuid4().hex  # of this call, as the table is
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, frequent, sample_rows, id_column, text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = worker_state(("lengths", path, key), lambda: Lengths(path, *table.value))
        for batch in slices(batches, text_column, SLICE_BYTES):
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
            counts = lengths.count([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts, pa.int64())], [id_column, "n_bytes", "n_tokens"])

    return docs.select(id_column, text_column).mapInArrow(run, f"{ids_schema(docs, id_column)}, n_bytes long, n_tokens long")

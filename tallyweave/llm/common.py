"""What several operators share: caches of bounded size, text batches and word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop, written
from ..sources.tables import table

__all__ = ["GenerationCache", "drop", "ids_schema", "remainder", "slices", "split_words", "table", "worker_state", "written"]

#: Fixed value: the code points with Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACES = regex.compile(f"[{WHITE_SPACE}]+")
#: Separators that str.split() takes for white space and Unicode doesn't.
_NOT_SPACES = regex.compile("[\x1c-\x1f]")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


_STATE: list = [None, None]


def worker_state(key, make: Callable):
    """What an operator keeps in a worker process between tasks. A worker keeps that of one operator at a time, as workers
    serve one stage after another and their memory would else add up."""
    if _STATE[0] != key:
        _STATE[:] = None, None
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _STATE[:] = key, make()
    return _STATE[1]


class GenerationCache(dict):
    """Values of `make`, for at most 2 * `limit` keys: when the young generation is full it becomes the old one,
    and what is then asked for again returns to the young one. Read with cache[key]."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def split_words(text: str) -> list[str]:
    """The runs of `text` without white space."""
    if _NOT_SPACES.search(text):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of about `size` bytes of `column`, so that memory follows bytes and not rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        lengths = pa.compute.fill_null(pa.compute.binary_length(array), 0).to_numpy(zero_copy_only=False)
        first = total = 0
        for k, n in enumerate(lengths.tolist()):
            if total and total + n > size:
                yield batch.slice(first, k - first)
                first, total = k, 0
            total += n
        yield batch.slice(first)


def ids_schema(df: DataFrame, *columns: str) -> str:
    """The DDL of columns that an operator hands on as they are."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)

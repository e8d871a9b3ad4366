"""Byte-level BPE by backtracking, and decoding by an offset table.

A token sequence is the one that the merges give exactly if each neighbouring pair of it is what the merges make of
the pair's own bytes. So the encoder takes the longest token at each place (one Aho-Corasick pass finds it for all
places), keeps it if the pair with the token before is compatible, else tries the next shorter prefix token, and steps
back if there is none. Places that turned out to be dead ends are marked, which keeps the time linear.

Edge cases: a null or empty text has no ids and decodes to the empty text. The id column may be null or repeated; other
columns are left out, so clashing names do no harm. An empty table gives an empty table.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .common import GenerationCache, ids_schema, slices, worker_state

#: Bytes of text that a worker holds with its ids at once; a single longer text is taken whole.
SLICE_BYTES = 2 << 20
#: White-space-led chunks that a worker remembers, in each of two generations, and pre-tokens that aren't a space and a word: those are chunks.
CACHE = 150_000
OTHERS = 40_000
#: Pairs of tokens whose compatibility a worker remembers, in each of two generations.
PAIRS = 300_000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones as they are, others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class BacktrackingBPE:
    """Encodes and decodes by the vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        raw = lambda word: bytes(letters[c] for c in word)
        vocabulary = {raw(word): k for word, k in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        pieces = [b""] * size
        for piece, k in vocabulary.items():
            pieces[k] = piece
        # Ranks: single bytes merge before anything, then merges in the file's order.
        self.rank = [0] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for order, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(w) for w in (pair if isinstance(pair, list) else pair.split(" ")))
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merged[left, right] = order + 1
            if self.parts[whole] is None:
                self.parts[whole] = (left, right)
                self.rank[whole] = order + 1
        # The longest token that is a proper prefix of each token.
        self.shorter = [-1] * size
        for piece, k in vocabulary.items():
            self.shorter[k] = next((vocabulary[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in vocabulary), -1)
        self.length = [len(p) for p in pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, k in vocabulary.items():
            self.automaton.add_word(piece.decode("latin-1"), k)
        self.automaton.make_automaton()
        for text, k in self.special.items():
            pieces[k] = text.encode()
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pairs = GenerationCache(lambda key: self._compatible(*divmod(key, 1 << 20)), PAIRS)
        self.tokens = GenerationCache(self._pre_token, OTHERS)
        self.chunks = GenerationCache(self._chunk, CACHE)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave `left` and `right` apart when they meet.

        Both are taken apart again, the later merge first. At each moment the pieces at the boundary are those that
        stood there just before `limit`, the merge undone last; had their own merge come earlier, it would have won.
        On equal ranks the merge further left was made first."""
        limit = 1 << 30
        while True:
            together = self.merged.get((left, right))
            if together is not None and together < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a == 0 and b == 0:
                return True
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        word, pairs = piece.decode("latin-1"), self.pairs
        # Taking the longest match again and again is right if every pair of the outcome is compatible.
        out = [k for _, k in self.automaton.iter_long(word)]
        before = -1
        for count, token in enumerate(out):
            if before >= 0 and not pairs[before << 20 | token]:
                break
            before = token
        else:
            return out
        n, length, shorter = len(word), self.length, self.shorter
        longest = [0] * n
        for end, k in self.automaton.iter(word):  # from left to right, so the last that begins at a place is the longest
            longest[end + 1 - length[k]] = k
        alive = [True] * (n + 1)
        del out[count:]
        at = sum([length[k] for k in out])
        while True:
            before = out[-1] if out else -1
            while token >= 0 and not (alive[at + length[token]] and (before < 0 or pairs[before << 20 | token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == n:
                    return out
                token = longest[at]
            else:
                alive[at] = False
                token = out.pop()
                at -= length[token]

    def _pre_token(self, word: str) -> bytes:
        return array("i", self.encode_bytes(word.encode())).tobytes()

    def _words(self, text: str) -> list[str]:
        """Pre-tokens. Beyond U+024F the classes of letters and digits follow the library's version of Unicode."""
        if self._LATIN.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _chunk(self, chunk: str) -> bytes:
        if chunk[1:].isalpha() and chunk[0] == " ":
            return self._pre_token(chunk)
        return b"".join(map(self._ids, self._words(chunk)))

    def _ids(self, word: str) -> bytes:
        """Ids of a pre-token, remembered in one place only."""
        return self.chunks[word] if word[0] == " " and word[1:].isalpha() else self.tokens[word]

    _LATIN = regex.compile("[\\0-\u024f]*")

    #: A space within or at the end of a longer run of white space: there a pre-token may run on over it.
    _RUN = regex.compile(r"\s (?:\s|\Z)")

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. A space that a word follows always begins a pre-token, so such
        texts are cut at spaces; the rest is cut by the pattern."""
        if not text:
            return b""
        if self._RUN.search(text):
            return b"".join(map(self._ids, self._words(text)))
        first, *rest = text.split(" ")
        got = self.chunks.__getitem__
        return (got(first) if first else b"") + b"".join([got(" " + x) for x in rest])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; special tokens in it get their own ids."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), np.int32)
        found, at = [], 0
        for m in self.special_pattern.finditer(text):
            found += [self._plain(text[at : m.start()]), np.int32(self.special[m[0]]).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*found, self._plain(text[at:])]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: all pieces are gathered from one blob by their offsets. Bytes that aren't UTF-8 become U+FFFD."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        if not len(ends):
            return ""
        where = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.blob[where].tobytes().decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row its id, `ids` array<int> and `decoded` string. No shuffle; the vocabulary is loaded once a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_state(("bpe", path), lambda: BacktrackingBPE(path))
        for batch in slices(batches, text_column, SLICE_BYTES):
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array([bpe.decode(x) for x in ids], pa.string())], [id_column, "ids", "decoded"])

    return docs.select(id_column, text_column).mapInArrow(run, f"{ids_schema(docs, id_column)}, ids array<int>, decoded string")


def digests(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 of what encode_decode() returns."""
    return encoded.select(
        id_column,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

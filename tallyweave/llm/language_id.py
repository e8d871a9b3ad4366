"""Language identification by unigram piece models with all segmentations summed.

The pieces are a fixed public vocabulary: a SentencePiece model's pieces that consist of letters, lower-cased. Each
language has a probability for every piece. A word's probability is the sum over all its segmentations into pieces,
found by the forward algorithm; a text's is the product over its words (runs of letters). The score is the posterior of
the best language with equal priors.

Training reads at most about `per_language` rows of each language (expected; chosen by a hash of the id), and makes
`rounds` rounds of expectation and maximisation; the pieces' first weights are how often each occurs anywhere in a word.

Edge cases: a text that is null or has no letter gives `und` with score 0. Words may be of any length: sums are rescaled on the way, and
what reaches beyond a block of places is carried on. Letters that the vocabulary lacks count alike in every language. Of languages
that fit equally well the first by name is told (a text of unknown letters alone gives the first one, with an equal share as its score). With no labelled row
every text gives `und`. Null languages, texts and ids are no training rows; repeated rows count each time. Over `most_languages` different
languages raise, as the model is broadcast.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, ids_schema, slices, split_words, worker_state, written

SLICE_BYTES = 2 << 20
#: Places of a word that are summed before what reaches beyond them is carried on.
BLOCK = 256
#: Numbers of an array of sums, for each language.
CELLS = 1 << 19
#: Files of the training sample.
SAMPLE_PARTS = 8
#: Chunks of text (runs without white space) whose scores a worker holds before it begins anew.
CACHE = 150_000
_RUNS = regex.compile(r"\p{L}+")
_PUNCTUATION = ".,;:!?\"'()"
#: Probability of a letter that the vocabulary doesn't have, for every language.
UNKNOWN = 1e-7
#: Places after which sums are rescaled: a place takes a factor of UNKNOWN at least.
RESCALE = 16


class Pieces:
    """A trie of the vocabulary whose steps are found for many words at once."""

    def __init__(self, model_path: str, longest: int | None = None):
        """All pieces; `longest` leaves out longer ones, for small tests."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        raw = {model.id_to_piece(k).replace("▁", "").lower() for k in range(model.get_piece_size())}
        self.pieces = sorted(p for p in raw if _RUNS.fullmatch(p) and len(p) <= (longest or len(p)))
        self.longest = max(map(len, self.pieces))
        letters = sorted({c for p in self.pieces for c in p})
        self.table = np.zeros(0x110000, np.int32)  # by code point; 0: not in the vocabulary
        self.table[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.radix = len(letters) + 1
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for k, piece in enumerate(self.pieces):
            at = 0
            for c in piece:
                at = nodes.setdefault((at, int(self.table[ord(c)])), len(nodes) + 1)
            ends[at] = k
        keys = np.array([a * self.radix + c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.fromiter(nodes.values(), np.int64)[order]
        self.piece_of = np.full(len(nodes) + 1, -1, np.int32)
        self.piece_of[list(ends)] = list(ends.values())

    def codes(self, words: list[str], n: int) -> np.ndarray:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)
        return self.table[points].astype(np.int64)

    def steps(self, codes: np.ndarray, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first place, place behind, rows, pieces) of all pieces in words of one length that begin from `start` to before `stop`, by first place."""
        n = codes.shape[1]
        for first in range(start, n if stop is None else min(n, stop)):
            rows = np.flatnonzero(codes[:, first])
            at = np.zeros(len(rows), np.int64)
            for behind in range(first + 1, min(n, first + self.longest) + 1):
                want = at * self.radix + codes[rows, behind - 1]
                where = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                alive = self.keys[where] == want
                rows, at = rows[alive], self.targets[where[alive]]
                if not len(rows):
                    break
                found = self.piece_of[at]
                ok = found >= 0
                if ok.any():
                    yield first, behind, rows[ok], found[ok]


def by_length(words) -> Iterator[tuple[int, list[str]]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    yield from groups.items()


def chunked(words: list[str], n: int) -> Iterator[list[str]]:
    """Words of n letters in lists whose sums take at most about CELLS numbers."""
    size = max(1, CELLS // (min(n, BLOCK) + 1))
    for k in range(0, len(words), size):
        yield words[k : k + size]


def word_logs(pieces: Pieces, probabilities: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(words, languages): logs of the summed probability of all segmentations. Only the sums that a piece can still reach are held."""
    m, n = codes.shape
    reach = pieces.longest
    logs = np.zeros((m, probabilities.shape[1]))
    carried = np.zeros((reach, *logs.shape))
    carried[0] = 1
    for start in range(0, n, BLOCK):
        size = min(BLOCK, n - start)
        alpha = np.zeros((size + reach, *logs.shape))
        alpha[:reach] = carried
        part, done = codes[:, start : start + size + reach - 1], 0

        def passed(k: int, alpha=alpha) -> None:
            nonlocal logs
            if k % RESCALE == 0:
                top = alpha[k].copy()
                alpha[k : k + reach] /= top
                logs = logs + np.log(top)
            alpha[k + 1] += alpha[k] * UNKNOWN

        for first, behind, rows, found in pieces.steps(part, 0, size):
            while done <= first:
                passed(done)
                done += 1
            alpha[behind][rows] += alpha[first][rows] * probabilities[found]
        while done < size:
            passed(done)
            done += 1
        carried = alpha[size:]
    return logs + np.log(carried[0])


@dataclass
class LanguageModel:
    languages: list[str]
    probabilities: np.ndarray  # (pieces, languages)
    model_path: str
    longest: int | None = None


class Scorer:
    """Texts' log-probabilities in every language, with a bounded cache of chunks."""

    def __init__(self, model: LanguageModel):
        self.model, self.pieces = model, Pieces(model.model_path, model.longest)
        self.width = len(model.languages) + 1
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, self.width))

    def words(self, words: list[str]) -> np.ndarray:
        """(words, languages): log-probabilities."""
        out, place = np.zeros((len(words), len(self.model.languages))), {w: k for k, w in enumerate(words)}
        for n, group in by_length(words):
            for part in chunked(group, n):
                out[[place[w] for w in part]] = word_logs(self.pieces, self.model.probabilities, self.pieces.codes(part, n))
        return out

    def learn(self, chunks: set[str]) -> None:
        if len(self.rows) > CACHE:
            self.clear()
        new, flat, sizes = [], [], []
        for c in chunks:
            if c in self.rows:
                continue
            bare = c.strip(_PUNCTUATION)
            if bare in self.rows:
                self.rows[c] = self.rows[bare]
                continue
            runs = [bare] if bare.isalpha() else _RUNS.findall(c)
            new.append(c)
            flat += runs
            sizes.append(len(runs))
        if not new:
            return
        distinct = list(dict.fromkeys(flat))
        place = dict(zip(distinct, range(len(distinct)), strict=True))
        known = np.column_stack([self.words(distinct), np.ones(len(distinct))])
        scores, size = np.zeros((len(new), self.width)), np.array(sizes)
        if flat:
            some = np.flatnonzero(size)
            scores[some] = np.add.reduceat(known[np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))], (np.cumsum(size) - size)[some])
        self.rows.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, scores])

    def texts(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Best language, its posterior, and whether there is a letter; `und` and 0 without a letter or without languages."""
        chunks = [split_words(t.lower()) for t in texts]
        self.learn(set().union(*chunks))
        row, names = self.rows.__getitem__, self.model.languages
        best, score, letters = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for k, c in enumerate(chunks):
            total = self.scores[np.fromiter(map(row, c), np.int64, len(c))].sum(0)
            letters[k] = total[-1] > 0
            if not total[-1] or not names:
                best.append("und")
                continue
            logs = total[:-1]
            top = int(logs.argmax())
            best.append(names[top])
            score[k] = 1 / np.exp(logs - logs[top]).sum()
        return best, score, letters


def train(docs: DataFrame, labelled: Column, model_path: str, per_language: int = 1_000, rounds: int = 2, most_languages: int = 1_000, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """A model of the rows where `labelled` holds. What reaches the driver is one count for each piece and language."""
    rows = docs.where(labelled & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), F.xxhash64(F.col(id_column).cast("string"), F.lit("sample")).alias("h"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"over {most_languages} different languages")
    languages, width = sorted(sizes), len(Pieces(model_path).pieces)
    if not languages:
        return LanguageModel([], np.zeros((width, 0)), model_path)
    # A row is taken if its hash lies below its language's share.
    bound = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(int(min(1.0, per_language / sizes[name]) * 2**53)))])
    # Written, so that the rounds read the sample and not the corpus.
    sample = written(rows.where(F.shiftrightunsigned("h", 11) < F.element_at(bound, F.col("lang"))).select("lang", "text").repartition(SAMPLE_PARTS))
    spark = docs.sparkSession
    probabilities = None
    for _ in range(rounds + 1):
        given = spark.sparkContext.broadcast(probabilities)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            pieces = worker_state(("pieces", model_path), lambda: Pieces(model_path))
            sums = np.zeros((len(pieces.pieces), len(languages)))
            for batch in slices(batches, "text", SLICE_BYTES):
                counts: dict[str, Counter] = {}
                for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    counts.setdefault(name, Counter()).update(_RUNS.findall(text.lower()))
                for name, words in counts.items():
                    expected_counts(pieces, given.value, languages.index(name), words, sums)
            where, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(lang, pa.int32()), pa.array(sums[where, lang])], ["piece", "lang", "n"])

        found = sample.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        probabilities = np.full((width, len(languages)), 0.01)
        probabilities[found.piece, found.lang] += np.round(found.n, 6)
        probabilities /= probabilities.sum(0)
        given.unpersist()
    drop(sample)
    return LanguageModel(languages, probabilities, model_path)


def expected_counts(pieces: Pieces, probabilities: np.ndarray | None, language: int, words: Counter, sums: np.ndarray) -> None:
    """Adds to `sums` how often each piece occurs in the words: anywhere, if there are no probabilities yet, else as
    expected over all segmentations (forward times backward)."""
    for n, group in by_length(words):
        for part in chunked(group, n):
            codes, times = pieces.codes(part, n), np.array([words[w] for w in part], float)
            if probabilities is None:
                for _, _, rows, found in pieces.steps(codes):
                    np.add.at(sums[:, language], found, times[rows])
            else:
                _expected(pieces, probabilities[:, language], codes, times, sums[:, language])


def _expected(pieces: Pieces, p: np.ndarray, codes: np.ndarray, times: np.ndarray, sums: np.ndarray) -> None:
    m, n = codes.shape
    reach = pieces.longest
    before = np.zeros((n + 1, m))  # logs of the sums of all beginnings
    alpha, scale, done = np.zeros((n + 1, m)), np.zeros(m), 0
    alpha[0] = 1

    def passed(k: int) -> None:
        nonlocal scale
        before[k] = np.log(alpha[k]) + scale
        if k % RESCALE == 0:
            top = alpha[k].copy()
            alpha[k : k + reach] /= top
            scale = scale + np.log(top)
        alpha[k + 1] += alpha[k] * UNKNOWN

    for first, behind, rows, found in pieces.steps(codes):
        while done <= first:
            passed(done)
            done += 1
        alpha[behind][rows] += alpha[first][rows] * p[found]
    while done < n:
        passed(done)
        done += 1
    before[n] = np.log(alpha[n]) + scale
    beta, scale, done = alpha, np.zeros(m), n  # the sums of all ends take the place of alpha
    beta[:n], beta[n] = 0, 1

    def came_to(k: int) -> None:
        """All that begins behind place k is summed."""
        nonlocal scale
        if (k + 1) % RESCALE == 0:
            top = beta[k + 1].copy()
            beta[k + 1 : k + 1 + reach] /= top
            scale = scale + np.log(top)
        beta[k] += beta[k + 1] * UNKNOWN

    for start in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        for first, behind, rows, found in reversed(list(pieces.steps(codes, start, start + BLOCK))):
            while done > first:
                done -= 1
                came_to(done)
            part = p[found] * beta[behind][rows]
            beta[first][rows] += part
            np.add.at(sums, found, times[rows] * part * np.exp(before[first][rows] + scale[rows] - before[n][rows]))
        while done > start:
            done -= 1
            came_to(done)


def predict(docs: DataFrame, model: LanguageModel, *keep: str, text_column: str = "text") -> DataFrame:
    """The columns `keep`, `lang_pred` and `score` of each row. No shuffle."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(("language", key), lambda: Scorer(shared.value))
        for batch in slices(batches, "text__", SLICE_BYTES):
            best, score, _ = scorer.texts([t or "" for t in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(best, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text_column).alias("text__")).mapInArrow(run, f"{ids_schema(docs, *keep)}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of `docs` that have a letter, with all their columns; `lang_column` tells the predicted language. A model without
    languages changes none."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    place, lang = docs.columns.index(text_column), docs.columns.index(lang_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(("language", key), lambda: Scorer(shared.value))
        for batch in slices(batches, text_column, SLICE_BYTES):
            best, _, letters = scorer.texts([t or "" for t in batch.column(place).to_pylist()])
            columns = batch.columns
            if scorer.model.languages:
                columns[lang] = pa.array(best, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(letters))

    return docs.mapInArrow(run, docs.schema)

"""Language identification by unigrams over pieces, all segmentations summed (operator 8).

The pieces are those of a fixed public vocabulary that consist of lower-case
letters, possibly after the mark of a word's beginning.  Each language has a
probability for each piece.  A word can be cut into pieces in many ways; its
probability in a language is the sum over all of them, computed by the forward
algorithm from left to right.  A text's is the product over its words.

*Training* is expectation-maximisation: the backward algorithm adds to each
piece's count the share of the segmentations of each word that use it.  It runs
on the word counts of a sample of at most about ``sample`` labelled documents a
language, drawn by a hash of doc_id and counted in Spark, and on words of at
most ``TABLE`` letters; the model has one number a piece and language.

*Scoring* is by word: words met lately are remembered with their log
probabilities, new ones of a batch are computed together, position by position.
A run of more than ``TABLE`` letters is scored on its own by the same algorithm,
which needs the last few positions only and rescales them as it goes: no run is
cut, its segmentations are all summed, and time is in proportion to its length.

Words are runs of Unicode letters (general categories L) in training and in
scoring alike; digits, fractions and numerals are none.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without labelled documents every text is ``und``; ties go to the language first
by name; repeated rows are each returned; an empty table gives no rows; further
columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters, and numerals that are not decimal digits.
LETTERS = re.compile(r"[^\W\d_]+")
BEGIN = "▁"
#: Longest words whose positions share a table; their probabilities are far above the least double.
TABLE = 32
UNKNOWN = "und"
#: More than the length of any piece.
LENGTHS = 64
#: Probability of a character that no piece covers.
STRAY = 1e-8


def words_in(text: str) -> list[str]:
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ("".join(c if c.isalpha() else " " for c in w).split())]


class Pieces:
    """The lower-case letter pieces of a vocabulary file and a matcher for them."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.names = sorted({n for n in names if (n.removeprefix(BEGIN) or "a").isalpha() and n == n.lower() and n and "<" not in n})
        self.longest = max(map(len, self.names), default=0)
        self.matcher = ahocorasick.Automaton()
        for i, n in enumerate(self.names):
            self.matcher.add_word(n, i * LENGTHS + len(n))
        self.matcher.make_automaton()

    def lattice(self, words: list[str]) -> "Lattice":
        return Lattice(self, words)

    def log_probability(self, word: str, p: np.ndarray) -> np.ndarray:
        """Log probability of a word of any length in each language.

        Only the forward vectors of as many places as the longest piece has are
        held, as a ring; they are divided by the latest one whenever that gets
        small, and the logarithms of the divisors are added up.
        """
        marked, size = BEGIN + word, self.longest + 1
        ring = np.zeros((size, p.shape[1]))
        ring[0] = 1.0
        scale = np.zeros(p.shape[1])
        matches = self.matcher.iter(marked)
        coming = next(matches, None)
        for e in range(1, len(marked) + 1):
            new = STRAY * ring[(e - 1) % size]
            while coming is not None and coming[0] == e - 1:
                piece, length = divmod(coming[1], LENGTHS)
                new = new + ring[(e - length) % size] * p[piece]
                coming = next(matches, None)
            ring[e % size] = new
            if new.min() < 1e-100:
                ring /= new
                scale += np.log(new)
        return np.log(ring[len(marked) % size]) + scale


class Lattice:
    """All pieces in some words: of which word, from where to where, which piece; sorted by their end."""

    def __init__(self, pieces: Pieces, words: list[str]):
        marked = [BEGIN + w for w in words]
        joined = "\n".join(marked)
        self.size = np.array([len(w) for w in marked], dtype=np.int64)
        first = np.cumsum(self.size + 1) - self.size - 1
        found = np.fromiter(chain.from_iterable(pieces.matcher.iter(joined)), dtype=np.int64).reshape(-1, 2)
        of = np.repeat(np.arange(len(words)), self.size + 1)  # the word at each place
        word = of[found[:, 0]]
        end = found[:, 0] - first[word] + 1
        order = np.argsort(end.astype(np.uint16), kind="stable")
        self.word, self.end = word[order], end[order]
        self.piece, length = np.divmod(found[order, 1], LENGTHS)
        self.start = self.end - length
        self.cut = np.searchsorted(self.end, np.arange(int(self.size.max(initial=0)) + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Probability of each word's first 0, 1, ... characters in each language (words x places x languages)."""
        alpha = np.zeros((len(self.size), len(self.cut) - 1, p.shape[1]))
        alpha[:, 0] = 1.0
        for e in range(1, alpha.shape[1]):
            a, b = self.cut[e], self.cut[e + 1] if e + 1 < len(self.cut) else len(self.end)
            if a < b:
                w = self.word[a:b]  # ascending within an end
                new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                alpha[w[new], e] = np.add.reduceat(alpha[w, self.start[a:b]] * p[self.piece[a:b]], new)
            alpha[:, e] += STRAY * alpha[:, e - 1]
        return alpha

    def log_probabilities(self, p: np.ndarray) -> np.ndarray:
        return np.log(self.forward(p)[np.arange(len(self.size)), self.size])

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; ``weight`` is words x languages."""
        alpha = self.forward(p)
        n, rows = self.size, np.arange(len(self.size))
        beta = np.zeros_like(alpha)
        beta[rows, n] = weight / alpha[rows, n]
        counts = np.zeros_like(p)
        for e in range(alpha.shape[1] - 1, 0, -1):
            a, b = self.cut[e], self.cut[e + 1] if e + 1 < len(self.cut) else len(self.end)
            w, s, k = self.word[a:b], self.start[a:b], self.piece[a:b]
            after = beta[w, e] * p[k]
            np.add.at(counts, k, alpha[w, s] * after)
            np.add.at(beta, (w, s), after)
            beta[:, e - 1] += STRAY * beta[:, e]
        return counts


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # pieces x languages
    vocabulary: str


def fit(counts: dict[str, dict[str, int]], vocabulary: str, rounds: int = 4, smoothing: float = 0.1, part: int = 50_000) -> Model:
    """Piece probabilities from each language's word counts."""
    languages = sorted(counts)
    pieces = Pieces(vocabulary)
    words = sorted(w for w in set().union(*counts.values()) if len(w) <= TABLE) if counts else []
    weight = np.array([[counts[x].get(w, 0) for x in languages] for w in words], dtype=np.float64).reshape(len(words), len(languages))
    # to begin with, a piece is the likelier the longer it is, alike in all languages
    p = np.repeat(np.array([4.0 ** (len(n) - 12) for n in pieces.names])[:, None], max(1, len(languages)), axis=1)
    p /= p.sum(axis=0)
    parts = [(pieces.lattice(words[i : i + part]), weight[i : i + part]) for i in range(0, len(words), part)]
    for _ in range(rounds if words else 0):
        p = sum(lattice.expected(p, w) for lattice, w in parts) + smoothing
        p /= p.sum(axis=0)
    return Model(languages, np.log(p), vocabulary)


def held_out(doc_id):
    """Documents from which nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, vocabulary: str, sample: int = 500) -> Model:
    """Fits on about ``sample`` of the documents of each language; ``docs`` has doc_id, text and lang."""
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    limit = F.lit(0)
    for language, n in sizes.items():
        limit = F.when(F.col("lang") == language, int(min(1.0, sample / n) * (1 << 20))).otherwise(limit)
    drawn = known.where(F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id").cast("bigint")), F.lit(1 << 20)) < limit)
    counts: dict[str, dict[str, int]] = {x: {} for x in sizes}
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    for r in drawn.select("lang", words.alias("word")).groupBy("lang", "word").count().collect():  # the words of the sample
        counts[r["lang"]][r["word"]] = r["count"]
    return fit(counts, vocabulary)


class Scorer:
    """Log probabilities of words, remembered in rows of one table."""

    def __init__(self, model: Model, limit: int = 400_000):
        self.p = np.exp(model.log_p)
        self.pieces = Pieces(model.vocabulary)
        self.limit = limit
        self.place: dict[str, int] = {}
        self.table = np.empty((0, len(model.languages)))

    def texts(self, lists: list[list[str]]) -> np.ndarray:
        """Log probability of each list of words in each language."""
        runs = {w: self.pieces.log_probability(w, self.p) for w in {w for words in lists for w in words if len(w) > TABLE}}
        if runs:
            rest = self.texts([[w for w in words if len(w) <= TABLE] for words in lists])
            return rest + np.array([sum((runs[w] for w in words if len(w) > TABLE), np.zeros(rest.shape[1])) for words in lists])
        new = list(set().union(*lists) - self.place.keys()) if lists else []
        if len(self.place) + len(new) > self.limit and self.place:
            self.place, self.table = {}, self.table[:0]
            new = list(set().union(*lists))
        found = [self.table]
        for i in range(0, len(new), 20_000):
            part = sorted(new[i : i + 20_000], key=len)
            for j in range(0, len(part), 5_000):  # words of like length share a table
                some = part[j : j + 5_000]
                found.append(self.pieces.lattice(some).log_probabilities(self.p))
                base = len(self.place)
                self.place.update(zip(some, range(base, base + len(some))))
        self.table = np.concatenate(found)
        place = self.place.__getitem__
        return np.array([self.table[np.fromiter(map(place, words), dtype=np.int64, count=len(words))].sum(axis=0) for words in lists]).reshape(len(lists), -1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: the likeliest language and its share of the likelihood."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model.languages else None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = [words_in(t.as_py() or "") for t in batch.column(1)]
                names, scores = [], []
                table = scorer.texts(lists) if scorer else None
                for i, words in enumerate(lists):
                    if not words or table is None:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(table[i].argmax())
                    names.append(model.languages[best])
                    scores.append(float(1 / np.exp(table[i] - table[i][best]).sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")

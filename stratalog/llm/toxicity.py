"""Toxic spans by a linear-chain conditional random field (operator 5).

*Labelled tokens.*  Labels mark documents, so tokens are labelled from them: a
word, or one of its beginnings or endings, is telling if nearly all documents of
the training sample that have it are marked toxic; a token with a telling part in
a toxic document is labelled toxic, every other token of the sample clean.

*Model.*  Two states; a token's score is a bias and the weights of its features:
the word, its beginnings and endings, its shape (length, letters beyond ASCII)
and the words before and after it.  Features of clean and toxic tokens alike
have weights, so evidence counts for and against: a telling word in company that
clean documents keep is no sign.  A pair of neighbours adds a transition weight.
Weights are fitted by gradient ascent on the conditional likelihood of the
labelled tokens, sentence by sentence, with exact expectations from
forward-backward, and a penalty on their squares.

*Scoring.*  Forward-backward over the whole text gives each token's marginal
probability; a document's score is a logistic function of its greatest marginal
log-odds, fitted on the sample's documents, and its offending offsets are the
tokens of at least one half.  Forward and backward messages of a two-state chain
are kept as odds, one number a token, which cannot overflow, and all documents
of a batch advance together.

Bounds, all parameters: the model is fitted on about ``sample`` labelled
documents, drawn by a hash of doc_id and collected to the driver, and there on
at most ``sentences`` of their sentences with a toxic token and as many without,
drawn by a fixed seed.  Scoring covers every whole text.

Defined results: a null or empty text, or one without letters, gets the score of
a document without any sign; without labels of both kinds every document gets
the share of toxic labels (0 if there are none); of several labels for a doc_id
the toxic one counts; null labels count as none; repeated rows are each
returned; a score of exactly one half is toxic; an empty table gives no rows;
further columns, whatever their names, are left out by ``score`` and kept by
``drop_toxic``.  A very long text is one chain, whose cost is its length.
"""

from __future__ import annotations

import random
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Log-odds of a token are held within this.
MOST = 12.0


def features(token: str) -> list[str]:
    """The word, its beginnings and its endings."""
    return [token, *(token[:n] + "*" for n in (3, 4, 5, 6) if len(token) > n), *("*" + token[-n:] for n in (4, 5) if len(token) > n)]


def shape(token: str) -> list[str]:
    return [f"#{min(len(token), 12)}", "#ascii" if token.isascii() else "#wide"]


def in_context(words: list[str]) -> list[list[str]]:
    """All features of each word of a sentence; those of neighbours end in < (the word before) and > (the one after)."""
    out = [[*features(w), *shape(w)] for w in words]
    for i in range(1, len(words)):
        out[i].append(words[i - 1] + "<")
        out[i - 1].append(words[i] + ">")
    return out


def marginal_logits(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Log-odds of the second state for each token of sequences laid end to end.

    ``scores`` are log-odds of the tokens alone, ``transition`` is the 2 x 2
    table of log weights from state to state.
    """
    return chain(scores, lengths, transition)[0]


def chain(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray):
    """Marginal log-odds, forward odds, and the odds that the rest of the sequence gives each token."""
    total = int(lengths.sum())
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    step = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    active = np.bincount(step, minlength=1)  # sequences longer than each step
    begin = np.cumsum(active) - active
    place = begin[step] + np.repeat(rank, lengths)  # step by step, long sequences first
    odds = np.empty(total)
    odds[place] = np.exp(np.clip(scores, -MOST, MOST))
    stay, enter, leave, remain = np.exp(transition.ravel() - transition[0, 0])
    forward, backward = np.empty(total), np.empty(total)
    if total:
        before = odds[: active[0]]
        forward[: active[0]] = before
        for a, n in zip(begin[1:].tolist(), active[1:].tolist()):
            before = before[:n]
            before = odds[a : a + n] * (enter + remain * before) / (stay + leave * before)
            forward[a : a + n] = before
        after = np.empty(0)
        for a, n in zip(begin[::-1].tolist(), active[::-1].tolist()):
            here = np.ones(n)
            here[: len(after)] = after
            backward[a : a + n] = here
            x = odds[a : a + n] * here
            after = (leave + remain * x) / (stay + enter * x)
    return np.log(forward[place]) + np.log(backward[place]), forward[place], backward[place]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    transition: np.ndarray
    slope: float
    intercept: float
    constant: float | None = None

    def token_score(self, token: str) -> tuple[float, float, float]:
        """What a word adds to its own score, to that of the word after it and to that of the word before it."""
        get = self.weights.get
        return self.bias + sum([get(f, 0.0) for f in [*features(token), *shape(token)]]), get(token + "<", 0.0), get(token + ">", 0.0)


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def telling(texts: list[str], toxic: np.ndarray, least: int = 5, purity: float = 0.95) -> set[str]:
    """Words, beginnings and endings of at least ``least`` toxic documents that hardly any others have, between as many different pairs of neighbours.

    Copies of a document give the same neighbours, so words that only they share do not pass.
    """
    bad, good = Counter(), Counter()
    for text, y in zip(texts, toxic.tolist()):
        if y:
            bad.update({f for t in set(tokens_of(text)) for f in features(t)})
    bad = Counter({f: n for f, n in bad.items() if n >= least})
    known = common.Remembered(lambda w: tuple(f for f in features(w) if f in bad), 20_000)
    for text, y in zip(texts, toxic.tolist()):
        if not y:
            good.update({f for t in set(tokens_of(text)) for f in known[t]})
    between: dict[str, set[tuple[str, str]]] = {f: set() for f, n in bad.items() if n / (n + good[f]) >= purity}
    for text, y in zip(texts, toxic.tolist()):
        tokens = tokens_of(text) if y else []
        for a, t, b in zip(["", *tokens], tokens, [*tokens[1:], ""]):
            for f in features(t):
                if f in between and len(between[f]) < least:
                    between[f].add((a, b))
    return {f for f, x in between.items() if len(x) >= least}


class Labelled:
    """Sentences with tagged tokens: which feature occurs at which token."""

    def __init__(self, rows: list[tuple[list[str], list[int]]], least: int = 5):
        seen = Counter(f for words, _ in rows for found in in_context(words) for f in found)
        self.names = sorted(f for f, n in seen.items() if n >= least)
        del seen
        number = {f: i for i, f in enumerate(self.names)}
        place, feature, tag = array("q"), array("q"), array("q")
        for words, tags in rows:
            for found, t in zip(in_context(words), tags):
                known = [number[f] for f in found if f in number]
                feature.extend(known)
                place.extend([len(tag)] * len(known))
                tag.append(t)
        self.place, self.feature, self.tag = (np.frombuffer(x, dtype=np.int64) if x else np.empty(0, dtype=np.int64) for x in (place, feature, tag))
        self.lengths = np.array([len(words) for words, _ in rows], dtype=np.int64)
        inner = np.ones(len(tag), dtype=bool)
        inner[np.cumsum(self.lengths) - self.lengths] = False
        self.right = np.flatnonzero(inner)
        self.left = self.right - 1
        self.pairs = np.zeros((2, 2))
        np.add.at(self.pairs, (self.tag[self.left], self.tag[self.right]), 1)

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        """Of the log likelihood of the tags; ``theta`` is the features' weights, the bias and the transitions."""
        n = len(self.names)
        w, bias, trans = theta[:n], theta[n], theta[n + 1 :].reshape(2, 2)
        score = np.bincount(self.place, w[self.feature], minlength=len(self.tag)) + bias
        logits, forward, backward = chain(score, self.lengths, trans)
        gap = self.tag - 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
        # a pair's joint weight: forward odds of the left, transition, token and rest of the right
        e, x, f = np.exp(trans), np.exp(np.clip(score[self.right], -MOST, MOST)) * backward[self.right], forward[self.left]
        joint = np.stack([e[0, 0] * np.ones_like(f), e[0, 1] * x, e[1, 0] * f, e[1, 1] * f * x])
        joint /= joint.sum(axis=0)
        return np.concatenate([np.bincount(self.feature, gap[self.place], minlength=n), [gap.sum()], self.pairs.ravel() - joint.sum(axis=1)])


def fit(texts: list[str], toxic: np.ndarray, sentences: int = 6_000, rounds: int = 60, penalty: float = 0.05, purity: float = 0.95) -> Model:
    """Fits the field and the document score on texts with labels 0 and 1."""
    toxic = np.asarray(toxic, dtype=np.int64)
    if not toxic.any() or toxic.all():
        return Model({}, 0.0, np.zeros((2, 2)), 0.0, 0.0, float(toxic.mean()) if len(toxic) else 0.0)
    signs = telling(texts, toxic, purity=purity)
    sign = common.Remembered(lambda w: int(not signs.isdisjoint(features(w))), 20_000)
    drawn: tuple[list, list] = ([], [])  # sentences without and with a toxic token, and how many there were
    met = [0, 0]
    pick = random.Random(0)
    for text, y in zip(texts, toxic.tolist()):
        for part in SENTENCE.findall(text):
            words = tokens_of(part)
            tags = [sign[w] for w in words] if y else [0] * len(words)
            kind = int(any(tags))
            if not words:
                continue
            met[kind] += 1
            if len(drawn[kind]) < sentences:
                drawn[kind].append((words, tags))
            elif (at := pick.randrange(met[kind])) < sentences:
                drawn[kind][at] = (words, tags)
    data = Labelled([*drawn[1], *drawn[0]])
    n = len(data.names)
    theta = np.zeros(n + 5)
    theta[n] = -2.0
    square = np.zeros_like(theta)
    for _ in range(rounds):
        grad = data.gradient(theta) - penalty * theta
        square += grad * grad
        theta += 0.5 * grad / np.sqrt(square + 1e-8)
    weights = {f: float(x) for f, x in zip(data.names, theta) if abs(x) > 0.01}
    model = Model(weights, float(theta[n]), theta[n + 1 :].reshape(2, 2).copy(), 1.0, 0.0)
    del data, drawn
    look = Scores(model, 20_000)
    best = np.concatenate([greatest(token_logits([tokens_of(t) for t in texts[i : i + 100]], look)) for i in range(0, len(texts), 100)])
    model.slope, model.intercept = logistic(best, toxic)
    return model


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of y on x by Newton's method, with a little shrinkage."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    theta = np.array([0.5, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.1, 0.01])
        theta = theta + np.linalg.solve(hessian, a.T @ (y - p) - np.array([0.1, 0.01]) * theta * [1, 0])
    return max(float(theta[0]), 1e-3), float(theta[1])


class Scores:
    """``Model.token_score`` of words, remembered as rows of one table for about ``limit`` words."""

    def __init__(self, model: Model, limit: int = 400_000):
        self.model, self.limit = model, limit
        self.place: dict[str, int] = {}
        self.rows = array("d")

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.place) > self.limit:
            self.place, self.rows = {}, array("d")
        for w in set(words) - self.place.keys():
            self.place[w] = len(self.place)
            self.rows.extend(self.model.token_score(w))
        at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        return np.frombuffer(self.rows).reshape(-1, 3)[at]


def token_logits(lists: list[list[str]], look: Scores) -> list[np.ndarray]:
    """Marginal log-odds of every token of each list."""
    lengths = np.array([len(t) for t in lists], dtype=np.int64)
    ends = np.cumsum(lengths)
    total = int(lengths.sum())
    if not total:
        return [np.empty(0) for _ in lists]
    parts = look.of([w for words in lists for w in words])
    scores = parts[:, 0].copy()
    follows = np.ones(total, dtype=bool)
    follows[(ends - lengths)[lengths > 0]] = False
    at = np.flatnonzero(follows)
    scores[at] += parts[at - 1, 1]
    scores[at - 1] += parts[at, 2]
    return np.split(marginal_logits(scores, lengths[lengths > 0], look.model.transition), ends[:-1])


def greatest(logits: list[np.ndarray]) -> np.ndarray:
    """Each list's greatest log-odds, within MOST; -MOST without tokens."""
    return np.clip([x.max(initial=-MOST) for x in logits], -MOST, MOST)


def training_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of about ``sample`` labelled documents, by a hash of their doc_id."""
    named = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, sample / max(1, named.count()))
    chosen = named.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    few = chosen.count() <= 2 * sample  # about ``sample`` rows of two numbers, as the hash deals them
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen) if few else chosen, "doc_id").select("doc_id", "text", "toxic").toPandas()
    rows = rows.sort_values(["doc_id", "text"])
    return rows["text"].tolist(), rows["toxic"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, sample: int = 6_000, **parameters) -> Model:
    return fit(*training_sample(docs, labels, sample), **parameters)


def held_out(doc_id):
    """Documents from whose labels nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and spans: an array of start, end, probability of the tokens of at least one half."""
    common.ship(docs.sparkSession)
    schema = "doc_id bigint, score double, predicted int, spans array<struct<start:bigint,end:bigint,probability:double>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Scores(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [t.as_py() or "" for t in batch.column(1)]
                spans: list[list[dict]] = [[] for _ in texts]
                if model.constant is None:
                    logits = token_logits([tokens_of(t) for t in texts], look)
                    found = 1 / (1 + np.exp(-(model.slope * greatest(logits) + model.intercept)))
                    spans = [offending(t, x) if x.max(initial=-1.0) >= 0 else [] for t, x in zip(texts, logits)]
                else:
                    found = np.full(len(texts), model.constant)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32)), pa.array(spans, span)], names=["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(common.released(run), schema)


def offending(text: str, logits: np.ndarray) -> list[dict]:
    """Tokens of at least one half, by code-point offsets."""
    lower = text.lower()
    if len(lower) != len(text):  # some letter's lower case is several characters; the words before it stand where the marks say
        return _offending_by_letter(text, logits)
    p = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
    return [{"start": m.start(), "end": m.end(), "probability": float(x)} for m, x in zip(TOKEN.finditer(lower), p.tolist()) if x >= 0.5]


def _offending_by_letter(text: str, logits: np.ndarray) -> list[dict]:
    from itertools import accumulate

    ends = np.array(list(accumulate(len(c.lower()) for c in text)))  # of each character's lower case
    p = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
    place = lambda i: int(np.searchsorted(ends, i, side="right"))
    return [{"start": place(m.start()), "end": place(m.end() - 1) + 1, "probability": float(x)} for m, x in zip(TOKEN.finditer(text.lower()), p.tolist()) if x >= 0.5]


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Scores(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(batch.schema.names.index("text"))
                if model.constant is None:
                    best = greatest(token_logits([tokens_of(t.as_py() or "") for t in texts], look))
                    keep = model.slope * best + model.intercept < 0
                else:
                    keep = np.full(batch.num_rows, model.constant < 0.5)
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(common.released(run), docs.schema)

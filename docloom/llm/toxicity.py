"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams,
a text's vector the mean of the vectors of all its words, and a softmax layer
over the two labels reads it. Misspellings share most n-grams, and so most of
their vector, with the words seen in training.

An average over a long text keeps what few words say only if the many others
say nothing: a penalty on the length of each embedding draws those of n-grams
without evidence to zero, and n-grams of few training texts count for less.

Evidence is linear in the embeddings up to the softmax, so a trained model is
one number per n-gram bucket (the embedding times the difference of the softmax
columns) and a bias: 1 MB at 2**18 buckets, whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.labelled import fit_on_sample, score_column

_EDGES = ".,;:!?\"'()[]{}«»“”„…*_-–—#~|<>/\\"


@dataclass(frozen=True)
class ToxicityConfig:
    buckets: int = 1 << 18
    dim: int = 8
    shortest: int = 3
    longest: int = 6
    steps: int = 150
    rate: float = 0.2
    #: Weight of the sum of the embeddings' lengths, and the number of training texts at which a bucket counts half: one of n texts counts n / (n + half_texts).
    sparsity: float = 2e-5
    half_texts: float = 2.0
    #: Bounds of the training sample: rows of each label.
    rows_per_label: tuple[int, int] = (3_000, 2_000)
    seed: int = 5


def ngrams(word: str, c: ToxicityConfig) -> list[int]:
    """Buckets of the word's character n-grams and of the word itself."""
    marked = f"<{word.strip(_EDGES)}>"
    n, crc, top = len(marked), zlib.crc32, c.buckets - 1
    out = [crc(marked.encode()) & top]
    for k in range(c.shortest, min(c.longest, n - 1) + 1):
        out += [crc(marked[i:i + k].encode()) & top for i in range(n - k + 1)]
    return out


def word_counts(text: str) -> tuple[str, np.ndarray]:
    """The distinct words of a text, joined by blanks, and their counts."""
    counts = Counter(text.lower().split())
    return " ".join(counts), np.fromiter(counts.values(), np.int32, len(counts))


def _bags(words: list[str], c: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, and how many each word has; a few thousand words at a time are Python objects."""
    flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at in range(0, len(words), 4096):
        grams = [ngrams(w, c) for w in words[at:at + 4096]]
        sizes.append(np.fromiter(map(len, grams), np.int32, len(grams)))
        flat.append(np.fromiter(chain.from_iterable(grams), np.int32, int(sizes[-1].sum())))
    return np.concatenate(flat), np.concatenate(sizes)


def _runs(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


@dataclass(frozen=True)
class ToxicityModel:
    config: ToxicityConfig
    evidence: np.ndarray  # per bucket, float32
    bias: float
    base: float  # log odds of the label over all that the sample is from, for texts without words

    def words(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        flat, sizes = _bags(words, self.config)
        return np.add.reduceat(self.evidence[flat].astype(np.float64), _runs(sizes)) / sizes


def train(bags: list[tuple[str, np.ndarray]], labels: np.ndarray, c: ToxicityConfig = ToxicityConfig(), totals: np.ndarray | None = None) -> ToxicityModel:
    """Fit embeddings and softmax together by full-batch Adam on the word counts of texts; texts without words take no part.

    The loss is balanced; the base rate is that of ``totals``, the counts of
    labels 0 and 1 that the texts were sampled from. Sums run along arrays that
    are sorted by what they are summed for: by word, by text and by bucket.
    """
    labels = np.asarray(labels, np.float64)
    totals = np.array([(labels == 0).sum(), (labels == 1).sum()]) if totals is None else totals
    share = min(max(float(totals[1] / totals.sum()) if totals.sum() else 0.0, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    keep = [i for i, (_, counts) in enumerate(bags) if len(counts)]
    if not keep or labels[keep].min() == labels[keep].max():
        return ToxicityModel(c, np.zeros(c.buckets, np.float32), base, base)
    y, n = labels[keep], len(keep)
    # (text, word, share of the text's words), in order of texts and in order of words
    ids: dict[str, int] = {}
    sizes = np.array([len(bags[i][1]) for i in keep])
    word = np.fromiter((ids.setdefault(w, len(ids)) for i in keep for w in bags[i][0].split(" ")), np.int32, int(sizes.sum()))
    texts = _runs(sizes)
    times = np.concatenate([bags[i][1] / bags[i][1].sum() for i in keep])
    by_word = np.argsort(word, kind="stable")
    text_by_word, times_by_word = np.repeat(np.arange(n, dtype=np.int32), sizes)[by_word], times[by_word]
    in_texts = np.bincount(word, minlength=len(ids))
    words = _runs(in_texts)
    # (word, bucket) likewise
    grams, grams_of = _bags(list(ids), c)
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), grams_of)
    occurs = np.zeros(c.buckets)
    for at in range(0, len(grams), 1 << 20):  # temporary arrays stay small
        occurs += np.bincount(grams[at:at + (1 << 20)], in_texts[owner[at:at + (1 << 20)]], minlength=c.buckets)
    used = np.flatnonzero(occurs)
    place = np.zeros(c.buckets, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    grams, trust = place[grams], (occurs[used] / (occurs[used] + c.half_texts)).astype(np.float32)
    owner_by_gram = owner[np.argsort(grams, kind="stable")]
    buckets = _runs(np.bincount(grams, minlength=len(used)))
    starts = _runs(grams_of)
    del owner, occurs, by_word
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    rng = np.random.default_rng(c.seed)
    z, u, b = rng.normal(0, 0.01, (len(used), c.dim)).astype(np.float32), rng.normal(0, 0.5, c.dim).astype(np.float32), 0.0
    moments = [[np.zeros_like(z), np.zeros_like(z)], [np.zeros_like(u), np.zeros_like(u)], [0.0, 0.0]]
    for step in range(1, c.steps + 1):
        said = np.add.reduceat((trust * (z @ u))[grams], starts) / grams_of
        logit = np.add.reduceat(said[word] * times, texts) + b
        g = weight * (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y)
        at_word = np.add.reduceat(g[text_by_word] * times_by_word, words) / grams_of
        at_gram = trust * np.add.reduceat(at_word.astype(np.float32)[owner_by_gram], buckets)
        length = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-3)
        slopes = [np.outer(at_gram, u) + np.float32(c.sparsity) * z / length, at_gram @ z, g.sum()]
        moments = [[0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d] for (m, v), d in zip(moments, slopes)]
        rate = np.float32(c.rate * min(1.0, 2 * (1 - (step - 1) / c.steps)))
        z, u, b = (x - rate * (m / np.float32(1 - 0.9 ** step)) / (np.sqrt(v / np.float32(1 - 0.99 ** step)) + np.float32(1e-8)) for x, (m, v) in zip((z, u, b), moments))
    evidence = np.zeros(c.buckets, np.float32)
    evidence[used] = trust * (z @ u)
    return ToxicityModel(c, evidence, float(b), base)


def scores(model: ToxicityModel, texts: list[str], known: dict[str, float]) -> np.ndarray:
    """Probability of the label for each text; ``known`` keeps the evidence of words seen before."""
    tokens = [t.lower().split() for t in texts]
    fresh = list({w for t in tokens for w in t if w not in known})
    known.update(zip(fresh, model.words(fresh).tolist()))
    counts = np.array([len(t) for t in tokens], np.int64)
    said = np.bincount(np.repeat(np.arange(len(texts)), counts), np.fromiter((known[w] for t in tokens for w in t), np.float64, int(counts.sum())), minlength=len(texts))
    logit = np.where(counts > 0, model.bias + said / np.maximum(counts, 1), model.base)
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, c: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Train on a bounded sample of the labelled rows of the learning folds (see fit_on_sample)."""
    return fit_on_sample(docs, labels, "toxic", dict(enumerate(c.rows_per_label)), word_counts, lambda bags, y, totals: train(bags, y, c, totals))


def toxicity(docs: DataFrame, model: ToxicityModel) -> Column:
    """The score of ``docs``' text column, 0 to 1. Null, empty and blank texts get the base rate of the learning folds.

    Every text is read whole, however long. The score depends on the text
    alone, so repeated rows score alike; the table may be empty and may have
    any other columns.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return score_column(lambda texts, known: scores(held.value, texts, known), F.coalesce(docs["text"], F.lit("")))

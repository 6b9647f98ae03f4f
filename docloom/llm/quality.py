"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score(x) = b + <w, x> + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
the pairwise interactions of all features through vectors of low rank, in time
linear in the number of features of a document.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from docloom.llm.labelled import fit_on_sample, score_column
from docloom.llm.texts import utf8

_BINS = 8
#: Structure statistics and metadata (sizes), each cut into _BINS one-hot bins at these least values.
_STATS = {
    "log2_bytes": (4, 6, 7, 8, 9, 11, 13),
    "log2_lines": (1, 2, 3, 4, 5, 6, 8),
    "word_bytes": (2, 3, 4, 5, 6, 8, 12),
    "upper_share": (.005, .02, .05, .1, .2, .4, .7),
    "digit_share": (.005, .02, .05, .1, .2, .4, .7),
    "mark_share": (.01, .02, .04, .06, .1, .2, .4),
    "distinct_share": (.02, .05, .1, .2, .4, .6, .8),
    "same_as_before": (.01, .05, .1, .2, .4, .6, .8),
    "distinct_lines": (.1, .2, .3, .5, .7, .9, 1.),
    "top_word": (.03, .06, .1, .15, .2, .4, .6),
    "not_ascii": (.005, .02, .05, .1, .2, .4, .7),
    "shouting": (.05, .1, .2, .4, .6, .8, .95),
}


@dataclass(frozen=True)
class QualityConfig:
    buckets: int = 1 << 16
    rank: int = 6
    epochs: int = 6
    batch: int = 256
    rate: float = 0.05
    decay: float = 1e-5
    #: Bound of the training sample: rows, half of them of each label.
    rows: int = 8_000
    seed: int = 3

    @property
    def width(self) -> int:
        return self.buckets + len(_STATS) * _BINS


def _marks() -> np.ndarray:
    return np.array([33 <= i < 48 or 58 <= i < 65 or 91 <= i < 97 or 123 <= i < 127 for i in range(256)])


def _statistics(text: bytes, words: list[bytes], counts: np.ndarray) -> list[float]:
    raw = np.frombuffer(text, np.uint8)
    n, k = max(len(raw), 1), max(len(words), 1)
    by = np.bincount(raw, minlength=256)
    lines = text.split(b"\n")
    same = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    return [
        np.log2(n), np.log2(len(lines)), sum(map(len, words)) / k, by[65:91].sum() / n, by[48:58].sum() / n, by[_MARKS].sum() / n,
        len(counts) / k, same / k, len(set(lines)) / len(lines), counts.max(initial=0) / k, by[128:].sum() / n, sum(map(bytes.isupper, words)) / k]


_MARKS = _marks()


def features(texts: list[bytes], c: QualityConfig, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all non-zero features; a row's words have length 1 together."""
    rows, feats, values = [], [], []
    edges = [np.array(e) for e in _STATS.values()]
    for i, text in enumerate(texts):
        words = text.split()
        tokens = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = zlib.crc32(w.lower().strip(b".,;:!?\"'()")) & (c.buckets - 1)
            tokens.append(h)
        ids, counts = np.unique(np.array(tokens, np.int64), return_counts=True)
        weight = np.sqrt(counts)
        stats = _statistics(text, words, counts)
        bins = [c.buckets + j * _BINS + int(np.searchsorted(e, s, side="right")) for j, (e, s) in enumerate(zip(edges, stats))]
        rows.append(np.full(len(ids) + len(bins), i))
        feats.append(np.concatenate([ids, np.array(bins, np.int64)]))
        values.append(np.concatenate([weight / max(np.sqrt((weight ** 2).sum()), 1e-9), np.full(len(bins), 0.5)]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(feats), np.concatenate(values)


@dataclass(frozen=True)
class QualityModel:
    config: QualityConfig
    bias: float
    linear: np.ndarray  # width
    vectors: np.ndarray  # width x rank

    def logits(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias) + np.bincount(row, self.linear[feature] * value, minlength=n)
        for f in range(self.vectors.shape[1]):
            part = self.vectors[feature, f] * value
            out += 0.5 * (np.bincount(row, part, minlength=n) ** 2 - np.bincount(row, part * part, minlength=n))
        return out


def features_of(text: bytes, c: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    _, feature, value = features([text], c, {})
    return feature, value


def train(made: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, c: QualityConfig = QualityConfig(), totals: np.ndarray | None = None) -> QualityModel:
    """Fit by mini-batch AdaGrad on the logistic loss over the features of texts; without both labels only the bias is set.

    With ``totals``, the counts of labels 0 and 1 that the texts were sampled
    from, each row weighs as its label's share there over that in the sample.
    """
    labels = np.asarray(labels, np.float64)
    rng = np.random.default_rng(c.seed)
    held = np.array([(labels == 0).sum(), (labels == 1).sum()], np.float64)
    totals = held if totals is None else np.asarray(totals, np.float64)
    rate = min(max(float(totals[1] / totals.sum()), 1e-3), 1 - 1e-3) if totals.sum() else 0.5
    model = QualityModel(c, float(np.log(rate / (1 - rate))), np.zeros(c.width), rng.normal(0, 0.01, (c.width, c.rank)))
    if not len(labels) or labels.min() == labels.max():
        return model
    weight = (totals / totals.sum() / (held / held.sum()))[labels.astype(int)]
    feature, value = (np.concatenate(x) for x in zip(*made))
    begin = np.concatenate([[0], np.cumsum([len(f) for f, _ in made])])
    bias, w, v = model.bias, model.linear, model.vectors
    gw, gv, gb = np.full(c.width, 1e-6), np.full((c.width, c.rank), 1e-6), 1e-6
    for _ in range(c.epochs):
        order = rng.permutation(len(made))
        for at in range(0, len(order), c.batch):
            picked = order[at:at + c.batch]
            sizes = begin[picked + 1] - begin[picked]
            take = np.repeat(begin[picked] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            r, i, x = np.repeat(np.arange(len(picked)), sizes), feature[take], value[take]
            parts = v[i] * x[:, None]
            sums = np.stack([np.bincount(r, parts[:, f], minlength=len(picked)) for f in range(c.rank)], axis=1)
            squares = np.bincount(r, (parts ** 2).sum(axis=1), minlength=len(picked))
            logit = bias + np.bincount(r, w[i] * x, minlength=len(picked)) + 0.5 * ((sums ** 2).sum(axis=1) - squares)
            g = weight[picked] * (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels[picked])
            own, where = np.unique(i, return_inverse=True)
            gx = g[r] * x / len(picked)
            dw = np.bincount(where, gx) + c.decay * w[own]
            full = gx[:, None] * (sums[r] - parts)
            dv = np.stack([np.bincount(where, full[:, f]) for f in range(c.rank)], axis=1) + c.decay * v[own]
            gw[own] += dw * dw
            gv[own] += dv * dv
            w[own] -= c.rate * dw / np.sqrt(gw[own])
            v[own] -= c.rate * dv / np.sqrt(gv[own])
            db = g.mean()
            gb += db * db
            bias -= c.rate * db / np.sqrt(gb)
    return QualityModel(c, float(bias), w, v)


def scores(model: QualityModel, texts: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    row, feature, value = features(texts, model.config, known)
    return 1 / (1 + np.exp(-np.clip(model.logits(row, feature, value, len(texts)), -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, c: QualityConfig = QualityConfig()) -> QualityModel:
    """Train on a bounded sample of the labelled rows of the learning folds (see fit_on_sample)."""
    return fit_on_sample(docs, labels, "quality", {0: c.rows // 2, 1: c.rows // 2}, lambda text: features_of(text.encode("utf-8", "replace"), c), lambda made, y, totals: train(made, y, c, totals))


def quality(docs: DataFrame, model: QualityModel) -> Column:
    """The score of ``docs``' text column, 0 to 1, from the text alone.

    Every text is read whole; null and empty texts are scored by their
    structure statistics; repeated rows score alike; the table may be empty
    and may have any other columns.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return score_column(lambda texts, known: scores(held.value, [bytes(t) for t in texts], known), utf8())

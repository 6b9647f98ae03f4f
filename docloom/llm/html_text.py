"""Main text of HTML pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import math
import pickle
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.dom import Block, leaf_blocks
from docloom.llm.layouts import CLASSES, PARTS, invented, labelled_copies, labels_of
from docloom.llm.texts import blocks as slices

#: Pages with an ``article`` or ``main`` element that are learned from, of at most so many characters, and invented ones beside them.
SAMPLE, LONGEST, INVENTED = 240, 60_000, 60
#: Passes over the learned pages, step, and weight of the penalty on squared weights.
EPOCHS, STEP, PENALTY = 120, 0.3, 0.0001
#: How a block stands to the one before it: in the same element, in the same part below the same names, elsewhere.
EDGES = 3

_END = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")
_RIGHTS = re.compile(r"©|\(c\) ?\d{4}|copyright|all rights reserved", re.I)
_ASKS = re.compile(r"\b(?:cookies?|privacy|subscribe|newsletter|advertisement|sponsored|log ?in|sign ?(?:in|up)|register|share|tweet|repl(?:y|ies)|comments?|follow us|read more|related|search|menu|skip to)\b", re.I)


def features(page: Sequence[Block]) -> list[list[str]]:
    """Of each block: names of what is above it and the parts of a page they speak of, its element, and what its text is like."""
    return [[*above(b), *own] for b, own in zip(page, own_features(page))]


def above(b: Block) -> list[str]:
    """Features that follow from cues, nearest names and part alone; names of the main part say nothing of another part within it."""
    cues = b.cues if b.part in ("", "main") else [x for x in b.cues if PARTS.get(x) != "main"]
    return [*cues, *b.near, *{f"r:{PARTS[x]}" for x in cues if x in PARTS}, f"m:{b.part}"]


def own_features(page: Sequence[Block]) -> list[list[str]]:
    """The other features of each block."""
    out, headed = [], False
    for i, b in enumerate(page):
        headed |= b.tag == "h1"
        words = b.text.count(" ") + 1
        row = [f"b:{b.tag}", f"w:{min(7, int(math.log2(words)))}", f"l:{0 if not b.linked else 1 + min(2, int(3 * b.linked))}", "h:after" if headed else "h:before"]
        if _END.search(b.text[-8:]):
            row.append("e:stop")
        if words <= 40:
            if _RIGHTS.search(b.text):
                row.append("s:rights")
            if _ASKS.search(b.text):
                row.append("s:asks")
        row += [f"{x}|{b.tag}" for x in b.near] or ["a:none"]
        if len(page) > 5 and i < 2:
            row.append("p:first")
        if len(page) > 5 and i >= len(page) - 2:
            row.append("p:last")
        out.append(row)
    return out


def edges(page: Sequence[Block]) -> list[int]:
    """How each block stands to the one before it; the first has none and counts as 0."""
    return [0] + [0 if a.container == b.container else 1 if a.part == b.part and a.cues == b.cues else 2 for a, b in zip(page, page[1:])]


@dataclass
class Field:
    """Weights of features for the label "main text", of the first label, and of pairs of labels (edge, before, now)."""
    weights: dict[str, float]
    first: np.ndarray
    pairs: np.ndarray
    names: frozenset[str]

    def decode(self, emissions: Sequence[float], kinds: Sequence[int]) -> list[int]:
        """The likeliest labels (Viterbi); equal scores go to "not main text"."""
        (n, m), pairs = self.first.tolist(), self.pairs.tolist()
        back = []
        for t, (e, kind) in enumerate(zip(emissions, kinds)):
            if t:
                (nn, nm), (mn, mm) = pairs[kind]
                from_n, from_m = int(m + mn > n + nn), int(m + mm > n + nm)
                n, m = (m + mn if from_n else n + nn), (m + mm if from_m else n + nm)
                back.append((from_n, from_m))
            m += e
        if not len(emissions):
            return []
        labels = [int(m > n)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def extract(self, html: str | None, cache: dict, known: dict) -> str:
        """The main text of a page: its blocks, joined by single spaces. ``cache``: of attributes; ``known``: of sums over names."""
        page = leaf_blocks(html or "", self.names, cache, PARTS)
        emissions = []
        for block, row in zip(page, own_features(page)):
            key = (block.cues, block.near, block.part)
            if key not in known:
                if len(known) > 100_000:
                    known.clear()
                known[key] = sum(self.weights.get(f, 0.0) for f in above(block))
            emissions.append(known[key] + sum(self.weights.get(f, 0.0) for f in row))
        return " ".join(b.text for b, label in zip(page, self.decode(emissions, edges(page))) if label)


def log_likelihood(theta: np.ndarray, count: int, batches: Sequence[dict]) -> tuple[float, np.ndarray]:
    """Conditional log-likelihood of the labels and its gradient; theta: weights of ``count`` features, 2 first labels, EDGES * 4 pairs."""
    weights, first, pairs = theta[:count], theta[count:count + 2], theta[count + 2:].reshape(EDGES, 2, 2)
    total, gradient = 0.0, np.zeros_like(theta)
    d_first, d_pairs = gradient[count:count + 2], gradient[count + 2:].reshape(EDGES, 2, 2)
    for batch in batches:
        pages, steps = batch["labels"].shape
        here, kinds, labels = batch["here"], batch["kinds"], batch["labels"]
        emission = np.zeros((pages, steps, 2))
        emission[here, 1] = np.add.reduceat(weights[batch["features"]], batch["offsets"])
        move = pairs[kinds]
        ahead, behind = np.zeros((pages, steps, 2)), np.zeros((pages, steps, 2))
        ahead[:, 0] = first + emission[:, 0]
        for t in range(1, steps):
            x = ahead[:, t - 1, :, None] + move[:, t]
            ahead[:, t] = np.where(here[:, t, None], np.logaddexp(x[:, 0], x[:, 1]) + emission[:, t], ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            x = move[:, t + 1] + (emission[:, t + 1] + behind[:, t + 1])[:, None]
            behind[:, t] = np.where(here[:, t + 1, None], np.logaddexp(x[..., 0], x[..., 1]), behind[:, t + 1])
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        share = np.exp(ahead[..., 1] + behind[..., 1] - whole[:, None])
        gradient[:count] += np.bincount(batch["features"], np.repeat((labels - share)[here], batch["sizes"]), minlength=count)
        d_first += np.array([(1 - labels[:, 0] - 1 + share[:, 0]).sum(), (labels[:, 0] - share[:, 0]).sum()])
        both = np.exp(ahead[:, :-1, :, None] + move[:, 1:] + (emission[:, 1:] + behind[:, 1:])[:, :, None] - whole[:, None, None, None])
        now = here[:, 1:]
        for kind in range(EDGES):
            chosen = now & (kinds[:, 1:] == kind)
            d_pairs[kind] -= both[chosen].sum(0)
            np.add.at(d_pairs[kind], (labels[:, :-1][chosen], labels[:, 1:][chosen]), 1)
        gold = (emission[..., 1] * labels).sum(1) + first[labels[:, 0]]
        gold += np.where(now, np.take_along_axis(np.take_along_axis(move[:, 1:], labels[:, :-1, None, None], 2)[:, :, 0], labels[:, 1:, None], 2)[..., 0], 0).sum(1)
        total += float((gold - whole).sum())
    return total, gradient


def _batches(pages: Sequence[tuple[list[list[str]], list[int], list[int]]], index: dict[str, int], size: int = 64) -> list[dict]:
    """Pages of like length together, padded to the longest."""
    out = []
    pages = sorted((p for p in pages if p[0]), key=lambda p: len(p[0]))
    for at in range(0, len(pages), size):
        part = pages[at:at + size]
        steps = len(part[-1][0])
        batch = {"labels": np.zeros((len(part), steps), int), "kinds": np.zeros((len(part), steps), int), "here": np.zeros((len(part), steps), bool)}
        rows = [[index[f] for f in row] for found, _, _ in part for row in found]
        for i, (found, kinds, labels) in enumerate(part):
            batch["here"][i, :len(found)], batch["kinds"][i, :len(found)], batch["labels"][i, :len(found)] = True, kinds, labels
        batch["sizes"] = np.array([len(r) for r in rows])
        batch["offsets"] = np.concatenate([[0], np.cumsum(batch["sizes"])])[:-1]
        batch["features"] = np.array([f for r in rows for f in r])
        out.append(batch)
    return out


def train(pages: Sequence[tuple[Sequence[Block], Sequence[int]]], epochs: int = EPOCHS, step: float = STEP, penalty: float = PENALTY) -> Field:
    """A field with the largest penalised likelihood of the labels of ``pages``, by Adam steps over all of them."""
    made = [(features(page), edges(page), list(labels)) for page, labels in pages]
    index = {f: i for i, f in enumerate(sorted({f for found, _, _ in made for row in found for f in row}))}
    batches, count = _batches(made, index), len(index)
    theta = np.zeros(count + 2 + EDGES * 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, epochs + 1 if batches else 1):
        _, gradient = log_likelihood(theta, count, batches)
        gradient = gradient / len(made) - penalty * theta
        mean, square = .9 * mean + .1 * gradient, .99 * square + .01 * gradient ** 2
        theta += step * (1 - t / (epochs + 1)) * (mean / (1 - .9 ** t)) / (np.sqrt(square / (1 - .99 ** t)) + 1e-8)
    names = {f[2:] for f in index if f[:2] == "c:"}
    return Field({f: float(theta[i]) for f, i in index.items()}, theta[count:count + 2], theta[count + 2:].reshape(EDGES, 2, 2), frozenset(names | CLASSES))


def fit(pages: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Field:
    """A field trained in one task on at most ``sample`` pages that mark their main text by an ``article`` or ``main`` element.

    The tables hold no labels of pages, so the marks are the labels. Each page
    counts as it is and in copies that put its texts into other layouts, most
    without those elements, with menus, side bars, notices, adverts, forms and
    comments of other names; invented pages make sure that there is a model for
    any table. The sample is that of the least hashes among pages of at most
    ``longest`` characters, equal pages once; only the model, whose size is
    fixed, comes to the driver.
    """
    marked = pages.filter((F.length("html") <= longest) & F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("html", F.xxhash64("html").alias("key"))
    keys = marked.select("key").distinct().orderBy("key").limit(sample)
    chosen = marked.join(F.broadcast(keys), "key").groupBy("key").agg(F.first("html").alias("html"))  # at most ``sample`` keys

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pickle.dumps(learn(rows.sort_values("key")["html"].tolist()))]})

    found = chosen.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "model binary").first()
    return pickle.loads(found[0]) if found else learn([])


def learn(marked: Sequence[str]) -> Field:
    """A field from pages that mark their main text, their copies in other layouts, and invented pages."""
    rng = random.Random(12)
    learned = [labels_of(html) for html in marked]
    learned = [(page, labels) for page, labels in learned if any(labels)]
    for page, labels in [*learned, *(invented(rng) for _ in range(INVENTED))]:
        learned += labelled_copies([b.text for b, y in zip(page, labels) if y], [b.text for b, y in zip(page, labels) if not y], rng)
    return train(learned)


def main_text(pages: DataFrame, model: Field | None = None, keep: Sequence[str] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """(*keep, text, n_chars) of every row: the main text of the whole page, empty if it has none.

    A null page counts as empty; repeated rows are given each; an empty table
    gives an empty result; columns that are not named are not read. Pages are
    taken in slices of a few megabytes, in Arrow batches, without a shuffle.
    """
    model = model or fit(pages.select(F.col(column).alias("html")))
    slim = pages.select(*keep, F.col(column).alias("html"))
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        known: dict = {}
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [model.extract(html, cache, known) for html in part.column(kept).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = slim.drop("html").schema.add("text", "string").add("n_chars", "long")
    return slim.mapInArrow(run, schema)

"""A hidden Markov language model: Baum-Welch on Spark, exact sequence likelihoods by the scaled forward recursion.

Every word has its corpus count. The most frequent words are symbols of their
own; any other word w is emitted as its spelling class and then as
(c(w) + s) / (N_class + s * (V_class + 1)) within the class, so the likelihood
covers the open vocabulary and its exact counts while a state's emission table
stays bounded. The end of a text is a symbol too.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.texts import blocks, fold, most_frequent, utf8
from docloom.sources.tables import materialize

FOLDS = 10
#: The end of a text in the table of counts; no word is empty.
END = b""
CLASSES = 6 * 2 * 32


@dataclass(frozen=True)
class HmmConfig:
    states: int = 8
    rounds: int = 4
    #: Words with an emission of their own, and words whose count is looked up in memory (the rest is joined).
    symbols: int = 16_000
    frequent: int = 100_000
    smoothing: float = 0.1
    #: Frequent words whose meeting in texts makes the first states.
    anchors: int = 256
    seed: int = 1


def word_class(word: bytes) -> int:
    """Spelling class: length in threes, any byte outside ASCII, last byte modulo 32."""
    return (min(len(word) - 1, 17) // 3 * 2 + (not word.isascii())) * 32 + (word[-1] & 31)


@dataclass(frozen=True)
class Lexicon:
    """What encoding a text needs: bounded tables and corpus totals."""
    config: HmmConfig
    words: list[bytes]  # by falling count
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    ends: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    @property
    def n_symbols(self) -> int:
        return self.config.symbols + CLASSES + 1

    def base(self, c):
        s = self.config.smoothing
        return np.log10((c + s) / (self.total + s * (self.distinct + 1)))

    def within(self, c, of):
        s = self.config.smoothing
        return np.log10((c + s) / (self.class_total[of] + s * (self.class_distinct[of] + 1)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    for batch in batches:
        for part in blocks(batch, "utf8"):
            for text in part.column("utf8").to_pylist():
                counts.update(text.lower().split())
            counts[END] += part.num_rows
            if len(counts) > 500_000:
                yield out()
                counts.clear()
    if counts:
        yield out()


def _class_sizes():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            of = np.fromiter(map(word_class, batch.column("word").to_pylist()), np.int64, batch.num_rows)
            np.add.at(total, of, batch.column("c").to_numpy())
            np.add.at(distinct, of, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total), pa.array(distinct)], names=["of", "total", "distinct"])
    return run


def build_lexicon(counts: DataFrame, c: HmmConfig) -> Lexicon:
    """Totals over all counts, and the bounded list of frequent words."""
    total, distinct, ends = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.octet_length("word") == 0, F.col("c")))).first()
    words = counts.filter(F.octet_length("word") > 0)
    # Bounded by `frequent` words.
    top = sorted(most_frequent(words, "word", "c", c.frequent).collect(), key=lambda r: (-r[1], bytes(r[0])))
    own = [(int(r[1]), bytes(r[0])) for r in top[:c.symbols]]
    class_total, class_distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in words.mapInArrow(_class_sizes(), "of long, total long, distinct long").groupBy("of").agg(F.sum("total"), F.sum("distinct")).collect():
        class_total[r[0]], class_distinct[r[0]] = r[1], r[2]
    for n, w in own:  # words with a symbol of their own are not in a class
        class_total[word_class(w)] -= n
        class_distinct[word_class(w)] -= 1
    return Lexicon(c, [bytes(r[0]) for r in top], np.array([r[1] for r in top], np.int64), int(total or 0), int(distinct or 0), int(ends or 0), class_total, class_distinct)


_ENCODED = "row binary, doc_id long, held_out boolean, n_tokens long, seq binary, base double, within double, known long, words array<binary>, counts array<long>, classes array<int>"


def _encode(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        own = lex.config.symbols
        index = {w: i for i, w in enumerate(lex.words)}
        place = np.fromiter(map(word_class, lex.words), np.int64, len(lex.words))
        symbol = np.where(np.arange(len(place)) < own, np.arange(len(place)), own + place)
        base = lex.base(lex.counts.astype(np.float64))
        within = np.where(np.arange(len(place)) < own, 0.0, lex.within(lex.counts.astype(np.float64), place))
        end_base, end_known = float(lex.base(float(lex.ends))), int(lex.ends > 0)
        for batch in batches:
            for part in blocks(batch, "utf8"):
                out: dict[str, list] = {k: [] for k in ("row", "n_tokens", "seq", "base", "within", "known", "words", "counts", "classes")}
                for text in part.column("utf8").to_pylist():
                    words = text.lower().split()
                    ids = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                    seen = ids >= 0
                    rare = np.flatnonzero(~seen)
                    rare_words = [words[i] for i in rare.tolist()]
                    tally = Counter(rare_words)
                    classes = {w: word_class(w) for w in tally}
                    seq = np.empty(len(words) + 1, np.uint16)
                    seq[:-1][seen] = symbol[ids[seen]]
                    seq[rare] = [own + classes[w] for w in rare_words]
                    seq[-1] = lex.n_symbols - 1
                    out["row"].append(uuid.uuid4().bytes)
                    out["n_tokens"].append(len(words) + 1)
                    out["seq"].append(seq.tobytes())
                    out["base"].append(float(base[ids[seen]].sum()) + end_base)
                    out["within"].append(float(within[ids[seen]].sum()))
                    out["known"].append(int(seen.sum()) + end_known)
                    out["words"].append(list(tally))
                    out["counts"].append(list(tally.values()))
                    out["classes"].append([classes[w] for w in tally])
                kinds = {"row": pa.binary(), "seq": pa.binary(), "words": pa.list_(pa.binary()), "counts": pa.list_(pa.int64()), "classes": pa.list_(pa.int32()), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "within": pa.float64()}
                arrays = {k: pa.array(v, kinds[k]) for k, v in out.items()} | {"doc_id": part.column("doc_id"), "held_out": part.column("held_out")}
                names = [x.split()[0] for x in _ENCODED.split(", ")]
                yield pa.RecordBatch.from_arrays([arrays[n] for n in names], names=names)
    return run


@dataclass(frozen=True)
class Hmm:
    first: np.ndarray  # K
    step: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K

    def single(self) -> Hmm:
        """In single precision: enough for expected counts, which are scaled at every step and summed in double."""
        return Hmm(*(x.astype(np.float32) for x in (self.first, self.step, self.emit)))


def _sequences(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = part.column("seq").to_pylist()
    return np.frombuffer(b"".join(raw), np.uint16).astype(np.int64), np.array([len(r) // 2 for r in raw], np.int64)


#: Texts of more tokens are gathered, so that the steps they need beyond the others are taken together; and the tokens
#: that are worked on, and the steps' worth of tokens that are kept, at once.
_LONG, _TOKENS, _KEPT_STEPS = 1 << 11, 1 << 20, 1 << 19


def _matrix(flat: np.ndarray, sizes: np.ndarray):
    """Runs by falling length: their order, and for step t the symbols of the runs that still go on."""
    start = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    start, sizes = start[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    going = np.searchsorted(-sizes, -np.arange(longest), side="left")
    return order, going, lambda t: flat[start[:going[t]] + t]


def _forward(model: Hmm, alpha: np.ndarray | None, n: int, symbols: np.ndarray):
    """One scaled step of the n runs that go on: (alpha, emissions, scales); no alpha is the first step."""
    emit = model.emit[symbols]
    a = (np.repeat(model.first[None], n, axis=0) if alpha is None else alpha[:n] @ model.step) * emit
    scale = a.sum(axis=1, keepdims=True)
    return a / scale, emit, scale


def log10_likelihoods(model: Hmm, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 P(sequence) of each run of ``flat``, by the forward recursion scaled at every step."""
    order, going, at = _matrix(flat, sizes)
    logs, out, alpha = np.zeros(len(sizes)), np.zeros(len(sizes)), None
    for t, n in enumerate(going):
        alpha, _, scale = _forward(model, alpha, n, at(t))
        logs[:n] += np.log10(scale[:, 0])
    out[order] = logs
    return out


def expected_counts(model: Hmm, flat: np.ndarray, sizes: np.ndarray, kept: int = _KEPT_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected first states, transitions and emissions of whole runs, by the forward and backward recursions.

    The forward recursion keeps its state at the borders of stretches of steps
    with about ``kept`` tokens each; the backward one takes the stretches from
    the last to the first and makes each anew from its border. So memory is
    bounded for runs of any length, and nothing is cut.
    """
    k = len(model.first)
    order, going, at = _matrix(flat, sizes)
    first, steps, emissions = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
    if not len(going):
        return first, steps, emissions
    stretch = np.cumsum(going) // kept
    begins = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]])).tolist()
    ends = [*begins[1:], len(going)]
    borders, alpha = [], None
    for begin, end in zip(begins, ends):
        borders.append(alpha)
        if end < len(going):  # the last stretch is made below
            for t in range(begin, end):
                alpha, *_ = _forward(model, alpha, going[t], at(t))
    ahead, beyond = None, 0  # emission times beta over scale of the step after, and its runs
    for begin, end, alpha in zip(reversed(begins), reversed(ends), reversed(borders)):
        made = []
        for t in range(begin, end):
            symbols = at(t)
            made.append((symbols, *_forward(model, alpha, going[t], symbols)))
            alpha = made[-1][1]
        gammas = [None] * len(made)
        for i in range(len(made) - 1, -1, -1):
            _, alpha, emit, scale = made[i]
            beta = np.ones_like(alpha)
            if beyond:
                steps += alpha[:beyond].T @ ahead
                beta[:beyond] = ahead @ model.step.T
            gammas[i] = alpha * beta
            ahead, beyond = emit * beta / scale, len(alpha)
        symbol, gamma = np.concatenate([m[0] for m in made]), np.concatenate(gammas)
        for j in range(k):
            emissions[:, j] += np.bincount(symbol, gamma[:, j], minlength=len(model.emit))
        if begin == 0:
            first = gammas[0].sum(axis=0)
    return first, steps * model.step, emissions


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of about _TOKENS tokens, short texts with short ones and long with long."""
    long, held = [], 0
    for batch in batches:
        for part in blocks(batch, "seq", 2 * _TOKENS):
            far = pc.greater(pc.binary_length(part.column("seq")), 2 * _LONG)
            if (some := part.filter(far)).num_rows:
                long.append(some)
                held += pc.sum(pc.binary_length(some.column("seq"))).as_py() // 2
            if (rest := part.filter(pc.invert(far))).num_rows:
                yield rest
            if held >= _TOKENS:
                yield pa.Table.from_batches(long).combine_chunks().to_batches()[0]
                long, held = [], 0
    if long:
        yield pa.Table.from_batches(long).combine_chunks().to_batches()[0]


def _summed(rows: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(rows[:, j]) for j in range(rows.shape[1])]], names=["at", *[f"s{j}" for j in range(rows.shape[1])]])


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Hmm = model.value.single()
        k = len(m.first)
        first, steps, emissions = np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape)
        for part in _gathered(batches):
            f, s, e = expected_counts(m, *_sequences(part))
            first, steps, emissions = first + f, steps + s, emissions + e
        some = np.flatnonzero(emissions.any(axis=1))
        # symbols from 0, then transitions from -1 - state, then first states at -1 - K
        yield _summed(np.concatenate([emissions[some], steps, first[None]]), np.concatenate([some, -1 - np.arange(k), [-1 - k]]))
    return run


def _meetings(anchors: int):
    """How many texts hold both of two frequent words, as rows (at, s0, ...)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((anchors, anchors))
        for batch in batches:
            for part in blocks(batch, "seq", 2 * _TOKENS):
                flat, sizes = _sequences(part)
                text = np.repeat(np.arange(len(sizes)), sizes)
                some = flat < anchors
                has = np.zeros((len(sizes), anchors), np.float32)
                has[text[some], flat[some]] = 1
                both += has.T @ has
        yield _summed(both, np.arange(anchors))
    return run


def _groups(both: np.ndarray, k: int) -> np.ndarray:
    """The anchors in k groups of those that meet the same others; -1 for words that no text holds."""
    some = np.flatnonzero(both.diagonal() > 0)
    out = np.full(len(both), -1)
    if len(some) < k:
        return out
    share = both[some][:, some] / both.diagonal()[some]
    share = np.log(share / share.mean(axis=0) + 1e-2)
    share -= share.mean(axis=1, keepdims=True)
    share /= np.maximum(np.linalg.norm(share, axis=1, keepdims=True), 1e-9)
    centres = [0]
    while len(centres) < k:
        centres.append(int((share @ share[centres].T).max(axis=1).argmin()))
    heart = share[centres]
    for _ in range(20):
        group = (share @ heart.T).argmax(axis=1)
        heart = np.stack([share[group == j].sum(axis=0) if (group == j).any() else heart[j] for j in range(k)])
        heart /= np.maximum(np.linalg.norm(heart, axis=1, keepdims=True), 1e-9)
    out[some] = group
    return out


def _by_group(groups: np.ndarray, k: int, n_symbols: int):
    """Symbol counts of the texts whose anchors are mostly of one group, as rows (at, s0, ...); ties go to the first group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_symbols * k)
        for batch in batches:
            for part in blocks(batch, "seq", 2 * _TOKENS):
                flat, sizes = _sequences(part)
                text = np.repeat(np.arange(len(sizes)), sizes)
                some = np.flatnonzero(flat < len(groups))
                some = some[groups[flat[some]] >= 0]
                votes = np.bincount(text[some] * k + groups[flat[some]], minlength=len(sizes) * k).reshape(-1, k)
                counts += np.bincount(flat * k + votes.argmax(axis=1)[text], minlength=len(counts))
        counts = counts.reshape(n_symbols, k)
        some = np.flatnonzero(counts.any(axis=1))
        yield _summed(counts[some], some)
    return run


def _table(training: DataFrame, kernel, width: int) -> list:
    """The kernel's rows summed across partitions; one row per symbol at most, so bounded by the configuration."""
    schema = "at long, " + ", ".join(f"s{j} double" for j in range(width))
    return training.mapInArrow(kernel, schema).groupBy("at").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]).collect()


def _first_model(training: DataFrame, lex: Lexicon, unigram: np.ndarray) -> Hmm:
    """States from all texts: frequent words are grouped by the words they meet, texts by their words' groups."""
    c, k = lex.config, lex.config.states
    both = np.zeros((c.anchors, c.anchors))
    for at, *values in _table(training, _meetings(c.anchors), c.anchors):
        both[at] = values
    own = np.zeros((len(unigram), k))
    for at, *values in _table(training, _by_group(_groups(both, k), k, len(unigram)), k):
        own[at] = values
    noise = unigram[:, None] * np.random.default_rng(c.seed).uniform(0.8, 1.2, (len(unigram), k))
    emit = 0.5 * noise / noise.sum(axis=0) + 0.5 * (own + 50 * unigram[:, None]) / (own.sum(axis=0) + 50)
    step = np.full((k, k), 0.05 / max(k - 1, 1)) + np.eye(k) * (0.95 - 0.05 / max(k - 1, 1))
    return Hmm(np.full(k, 1 / k), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def baum_welch(encoded: DataFrame, lex: Lexicon, unigram: np.ndarray) -> Hmm:
    """Rounds over all whole texts of the learning folds; each round's counts are summed across partitions."""
    k = lex.config.states
    training = encoded.filter("not held_out").select("seq")
    model = _first_model(training, lex, unigram)
    for _ in range(lex.config.rounds):
        held = encoded.sparkSession.sparkContext.broadcast(model)
        first, steps, emissions = np.zeros(k), np.zeros((k, k)), np.zeros((lex.n_symbols, k))
        for at, *values in _table(training, _expect(held), k):
            if at >= 0:
                emissions[at] = values
            elif at >= -k:
                steps[-1 - at] = values
            else:
                first[:] = values
        emit = emissions + 20 * unigram[:, None]
        steps += 1
        model = Hmm((first + 1) / (first + 1).sum(), steps / steps.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        held.unpersist()
    return model


def _likelihoods(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            scores = log10_likelihoods(model.value, *_sequences(part))
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in _KEPT], pa.array(scores)], names=[*_KEPT, "hidden"])
    return run


_KEPT = ("row", "doc_id", "held_out", "n_tokens", "base", "within", "known")


def score_texts(docs: DataFrame, c: HmmConfig = HmmConfig()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from the rows whose crc32(doc_id) mod FOLDS is not 0 and scores all
    whole texts. Null and empty texts are the end token alone; a null id counts
    as the empty text (held out); repeated rows are learned from and scored
    each; an empty table gives an empty result; other columns are not read.
    Texts of any length are learned from and scored whole, memory follows the
    longest text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", FOLDS) == 0).alias("held_out"), utf8().alias("utf8"))
    counts = materialize(rows.filter("not held_out").select("utf8").mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    lex = build_lexicon(counts, c)
    unigram = np.concatenate([lex.counts[:c.symbols], np.zeros(max(0, c.symbols - len(lex.counts)), np.int64), lex.class_total, [lex.ends]]).astype(np.float64) + c.smoothing
    unigram /= unigram.sum()
    encoded = materialize(rows.mapInArrow(_encode(spark.sparkContext.broadcast(lex)), _ENCODED), "encoded")
    model = baum_welch(encoded, lex, unigram)
    held = spark.sparkContext.broadcast(model)
    scored = encoded.select("seq", *_KEPT).mapInArrow(_likelihoods(held), "row binary, doc_id long, held_out boolean, n_tokens long, base double, within double, known long, hidden double")
    rare = encoded.select("row", F.explode(F.arrays_zip("words", "counts", "classes")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"), F.col("w.classes").alias("of"))
    s = F.lit(c.smoothing)
    classes = spark.createDataFrame([(i, int(t), int(d)) for i, (t, d) in enumerate(zip(lex.class_total, lex.class_distinct))], "of int, t long, d long")
    found = rare.join(counts, "word", "left").join(F.broadcast(classes), "of").withColumn("c", F.coalesce("c", F.lit(0)))  # CLASSES rows
    more = found.groupBy("row").agg(
        F.sum(F.col("n") * F.log10((F.col("c") + s) / F.lit(float(lex.total + c.smoothing * (lex.distinct + 1))))).alias("more_base"),
        F.sum(F.col("n") * F.log10((F.col("c") + s) / (F.col("t") + s * (F.col("d") + 1)))).alias("more_within"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    zero = F.lit(0)
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("hidden") + F.col("within") + F.coalesce("more_within", F.lit(0.0))).alias("score"))

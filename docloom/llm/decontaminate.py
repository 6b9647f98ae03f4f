"""Benchmark decontamination: BM25 over the test items with block-max WAND, then overlap of question and answer.

Each item's BM25 impacts are divided by the score of the item's own text, so a
score is the share of the item that a passage brings, from 0 to 1, and one
threshold holds for items of any length.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docloom.llm.texts import blocks, utf8
from docloom.sources.tables import materialize

WORDS = re.compile(r"\w+")
SHINGLE = 5


@dataclass(frozen=True)
class DecontaminationConfig:
    k1: float = 1.2
    b: float = 0.75
    #: Share of an item's own score from which a passage is retrieved. A text that keeps 80 % of an
    #: item's shingles keeps at least 80 % of its words in place, so half of the score is well below it.
    threshold: float = 0.5
    #: Share of the shingles of the question, and of the answer, that must be found in the document.
    overlap: float = 0.8
    #: Share of the threshold that an item's commonest terms may bring together without opening it; its other terms, the rare ones, are looked up first.
    common: float = 0.6
    #: Items in a block of the index, and postings in a shard of it (the part that is in memory at once).
    block: int = 4
    postings: int = 2_000_000


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words before and after the cut: after the last "?", else the last line or sentence, else half way.

    Parts of fewer than SHINGLE words go to the other part, as they could be found anywhere.
    """
    at = text.rfind("?") + 1
    if not words_of(text[at:]) or not words_of(text[:at]):
        body = text.rstrip()
        at = body.rfind("\n") + 1
        if len(words_of(body[at:])) < SHINGLE or at == 0:
            ends = [m.end() for m in re.finditer(r"[.!?]\s+", body)]
            at = next((e for e in reversed(ends) if len(words_of(body[e:])) >= SHINGLE), 0)
    question, answer = words_of(text[:at]), words_of(text[at:])
    if len(question) < SHINGLE or len(answer) < SHINGLE:
        both = question + answer
        half = (len(both) + 1) // 2
        return (both[:half], both[half:]) if half >= SHINGLE and len(both) - half >= SHINGLE else (both, [])
    return question, answer


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the distinct runs of SHINGLE words, from those of the words, sorted; fewer words have none."""
    n = max(0, len(hashes) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n]
    return np.unique(out)


def _share(part: np.ndarray, have: np.ndarray) -> float:
    return len(np.intersect1d(part, have, assume_unique=True)) / len(part) if len(part) else 1.0


def holds_run(words: list[str], run: list[str]) -> bool:
    """Whether the words hold the run as it stands."""
    return any(words[i:i + len(run)] == run for i, w in enumerate(words) if w == run[0])


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each of some ranges, one after the other."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


class BlockMaxIndex:
    """Postings of one shard of items, with each term's largest impact per block of items and over all."""

    def __init__(self, items: list[tuple[int, str]], postings: list[tuple[int, str, float]], c: DecontaminationConfig):
        self.config = c
        self.ids = [i for i, _ in items]
        self.parts = [tuple(shingles(word_hashes(part)) for part in question_and_answer(t)) for _, t in items]
        #: Items too short for a shingle are verified by their words as a whole.
        self.whole = {i: words for i, (_, t) in enumerate(items) if len(words := words_of(t)) < SHINGLE}
        self.terms = {t: i for i, t in enumerate(sorted({t for _, t, _ in postings}))}
        self.step = max([16, *(len(words_of(t)) for _, t in items)])
        term = np.array([self.terms[t] for _, t, _ in postings], np.int64)
        item = np.array([i for i, _, _ in postings], np.int64)
        impact = np.array([x for _, _, x in postings])
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order], impact[order]
        #: Postings as one sorted list of term * items + item, so that any list is entered at any item by bisection.
        self.post = term * len(items) + self.item
        self.begin = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.n_blocks = max(1, -(-len(items) // c.block))
        self.most = np.zeros(len(self.terms))
        np.maximum.at(self.most, term, self.impact)
        # per term and block, sparse: term * n_blocks + block, the blocks of a term in a run
        self.block, first = np.unique(term * self.n_blocks + self.item // c.block, return_index=True)
        self.block_most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.block_begin = np.searchsorted(self.block, np.arange(len(self.terms) + 1) * self.n_blocks)

        self._rare(term, np.diff(self.begin)[term] if len(term) else term)

    def _rare(self, term: np.ndarray, df: np.ndarray) -> None:
        """Short lists with each item's rarest terms only, until the others together bring at most ``common`` of the threshold (``rest`` of the item)."""
        n, most = len(self.ids), self.config.common * self.config.threshold
        order = np.lexsort((-self.impact, df, self.item))
        item, impact = self.item[order], self.impact[order]
        before = np.cumsum(impact) - impact
        first = np.searchsorted(item, np.arange(n))
        before -= before[first[item]] if len(item) else 0
        own = np.bincount(item, impact, minlength=n)
        rare = np.zeros(len(term), bool)
        rare[order] = own[item] - before > most
        self.rest = np.maximum(0, own - np.bincount(self.item[rare], self.impact[rare], minlength=n))
        self.rare_item, self.rare_impact = self.item[rare], self.impact[rare]
        self.rare_begin = np.searchsorted(term[rare], np.arange(len(self.terms) + 1))

    def open_blocks(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """passage * n_blocks + block, sorted, of the blocks that may hold an item of the threshold; terms sorted by passage.

        An item can only reach it if its rare terms in the passage bring what
        its others leave to be wished for, so only the lists of rare terms are
        read. Their sums are first taken by a hash of passage and item, into a
        table as large as what is read: too many may share a place, none is
        missed. Blocks of items that are left are held against the maxima of
        all terms.
        """
        least, n = self.config.threshold - 1e-9, len(self.ids)
        size = self.rare_begin[t + 1] - self.rare_begin[t]
        ends = np.flatnonzero(np.append(p[1:] != p[:-1], True)) + 1  # of passages
        read, out, low = np.cumsum(size), [], 0
        while low < len(p):
            high = int(ends[min(np.searchsorted(read[ends - 1], (read[low - 1] if low else 0) + (1 << 20)), len(ends) - 1)])
            part = slice(low, high)
            at = _spread(self.rare_begin[t[part]], size[part])
            items, impact = self.rare_item[at], self.rare_impact[at]
            key = np.repeat(p[part], size[part]) * n + items
            bits = max(10, int(len(key)).bit_length() + 1)
            place = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
            keep = np.bincount(place, impact, minlength=1 << bits)[place] + self.rest[items] >= least
            keys, which = np.unique(key[keep], return_inverse=True)
            sums = np.bincount(which, impact[keep], minlength=len(keys))
            keys = keys[sums + self.rest[keys % n] >= least]
            out.append(np.unique(keys // n * self.n_blocks + keys % n // self.config.block))
            low = high
        opened = np.concatenate(out) if out else np.zeros(0, np.int64)
        first, size = np.searchsorted(p, opened // self.n_blocks), np.searchsorted(p, opened // self.n_blocks, "right")
        size -= first
        bounds = np.zeros(len(opened))
        for low in range(0, len(opened), 1 << 14):
            part = slice(low, low + (1 << 14))
            wanted = t[_spread(first[part], size[part])] * self.n_blocks + np.repeat(opened[part] % self.n_blocks, size[part])
            at = np.minimum(np.searchsorted(self.block, wanted), len(self.block) - 1)
            of = np.repeat(np.arange(len(opened[part])), size[part])
            bounds[part] = np.bincount(of, np.where(self.block[at] == wanted, self.block_most[at], 0.0), minlength=len(opened[part]))
        return opened[bounds >= least]

    def candidates(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all items that score at least the threshold, from the distinct terms of passages, sorted by passage."""
        opened = self.open_blocks(passage, term)
        some = np.isin(passage, opened // self.n_blocks)
        return self._wand(passage[some], term[some], opened)

    def _wand(self, p: np.ndarray, t: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block-max WAND, all passages a step at a time.

        The cursors of a passage are ordered by their items; the pivot is the
        first item at which the terms' overall maxima reach the threshold, so no
        item before it can. If its block cannot reach it (see open_blocks), all
        cursors before the next block that can skip to it; else the pivot is
        scored and passed.
        """
        least, n, step = self.config.threshold - 1e-9, len(self.ids), self.config.block

        def next_open(passage: np.ndarray, block: np.ndarray) -> np.ndarray:
            """The passage's first open block from ``block`` on; n_blocks without one."""
            at = np.searchsorted(opened, passage * self.n_blocks + block)
            found = np.append(opened, -1)[at]
            return np.where(found // self.n_blocks == passage, found % self.n_blocks, self.n_blocks)

        at, end = np.searchsorted(self.post, t * n + np.minimum(next_open(p, np.zeros(len(p), np.int64)) * step, n)), self.begin[t + 1]
        keep, out = at < end, []
        p, t, at, end = p[keep], t[keep], at[keep], end[keep]
        while len(at):
            d = self.item[at]
            order = np.lexsort((d, p))
            p, t, at, end, d = (x[order] for x in (p, t, at, end, d))
            starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(p)]]))
            total = np.cumsum(self.most[t])
            total -= np.repeat(total[starts] - self.most[t[starts]], sizes)
            short = np.add.reduceat(total < least, starts)
            open_ = short < sizes  # passages without a pivot are done
            pivot = d[np.where(open_, starts + short, 0)]
            nth = np.repeat(np.arange(len(starts)), sizes)
            block = next_open(p[starts], pivot // step)
            worth = block == pivot // step
            to = np.where(worth, pivot + 1, np.minimum(block * step, n))
            moves = open_[nth] & (d < to[nth])
            # a cursor that stands at the pivot brings its impact there, one before it what its list has there
            asked = np.flatnonzero(moves & worth[nth])
            own = nth[asked]
            wanted = t[asked] * n + pivot[own]
            found = np.where(d[asked] == pivot[own], at[asked], np.minimum(np.searchsorted(self.post, wanted), len(self.post) - 1))
            scores = np.bincount(own, np.where(self.post[found] == wanted, self.impact[found], 0.0), minlength=len(starts))
            hit = np.flatnonzero(open_ & worth & (scores >= least))
            out.append((p[starts[hit]], pivot[hit], scores[hit]))
            at[moves] = np.searchsorted(self.post, t[moves] * n + to[nth[moves]])
            keep = open_[nth] & (at < end)
            p, t, at, end = p[keep], t[keep], at[keep], end[keep]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of verified matches, best passage of each.

        Passages are windows of twice the longest item at steps of one, so each
        possible copy lies whole in a passage. A passage whose terms' overall
        maxima sum to less than the threshold is passed over at once.
        """
        tokens = list(map(words_of, texts))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter(map(self.terms.get, chain.from_iterable(tokens), repeat(-1)), np.int64, int(sizes.sum()))
        bound = np.concatenate([[0.0], np.cumsum(np.where(flat >= 0, self.most[flat], 0.0) if len(self.most) else np.zeros(len(flat)))])
        n = np.where(sizes > 0, np.maximum(1, -(-sizes // self.step) - 1), 0)
        text = np.repeat(np.arange(len(texts)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        start = np.cumsum(sizes) - sizes
        begin = start[text] + nth * self.step
        end = np.minimum(begin + 2 * self.step, (start + sizes)[text])
        hot = np.flatnonzero(bound[end] - bound[begin] >= self.config.threshold - 1e-9)
        # distinct terms of each passage that is left, and the bound they give
        size = end[hot] - begin[hot]
        spot = np.arange(size.sum()) + np.repeat(begin[hot] - (np.cumsum(size) - size), size)
        pair = np.repeat(np.arange(len(hot)), size) * (len(self.terms) + 1) + flat[spot] + 1
        pair = np.unique(pair[flat[spot] >= 0])
        of, term = pair // (len(self.terms) + 1), pair % (len(self.terms) + 1) - 1
        kept = (np.bincount(of, self.most[term], minlength=len(hot)) >= self.config.threshold - 1e-9)[of]
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        seen, hashed, have, near = (-1, -1), np.zeros(0, np.uint64), np.zeros(0, np.uint64), slice(0)
        for p, item, score in sorted(zip(*(x.tolist() for x in self.candidates(of[kept], term[kept])))):
            p = int(hot[p])
            d = int(text[p])
            if score <= found.get((d, item), (-1.0,))[0]:
                continue
            if (d, p) != seen:
                hashed = hashed if d == seen[0] else word_hashes(tokens[d])
                # one step more to either side: copies with words put in stay in view
                near = slice(max(0, int(begin[p] - start[d]) - self.step), int(end[p] - start[d]) + self.step)
                seen, have = (d, p), shingles(hashed[near])
            q, a = (_share(part, have) for part in self.parts[item])
            if min(q, a) >= self.config.overlap if item not in self.whole else holds_run(tokens[d][near], self.whole[item]):
                found[d, item] = (score, q, a)
        for (d, item), values in found.items():
            yield d, item, *values


@F.pandas_udf(ArrayType(StringType()))
def _split(texts: pd.Series) -> pd.Series:
    return texts.map(words_of)


def item_impacts(items: DataFrame, c: DecontaminationConfig) -> DataFrame:
    """(key, term, impact) of items (key, words): BM25 impacts over the item's own score, from the counts of all items."""
    lengths = items.select("key", F.size("words").alias("dl"))
    n, mean = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    tf = items.select("key", F.explode("words").alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * (1 - c.b + c.b * F.col("dl") / F.lit(mean or 1.0)))
    raw = tf.join(df, "term").join(lengths, "key").select("key", "term", (idf * saturated).alias("raw"))
    own = raw.groupBy("key").agg(F.sum("raw").alias("own"))
    return raw.join(own, "key").select("key", "term", (F.col("raw") / F.col("own")).alias("impact"))


def build_shards(items: DataFrame, c: DecontaminationConfig = DecontaminationConfig()) -> list[DataFrame]:
    """Indexes over all items as tables of one row (index: binary), each of about ``postings`` postings; impacts come from the counts of all items.

    Tasks build the indexes, one shard each, and write them to the shared folder.
    """
    text = F.coalesce("text", F.lit(""))
    # rows with one id but other texts are items of their own: they are told apart by their text
    keyed = items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).filter("item_id is not null").distinct()
    keyed = keyed.withColumn("key", F.sha2(F.concat_ws(":", F.col("item_id").cast("string"), "text"), 256)).withColumn("words", _split("text"))
    keyed = materialize(keyed.filter(F.size("words") > 0), "items")
    lists = item_impacts(keyed, c).groupBy("key").agg(F.collect_list("term").alias("terms"), F.collect_list("impact").alias("impacts"))  # one item's
    rows = materialize(keyed.join(lists, "key").select("key", "item_id", "text", "terms", "impacts"), "impacts")
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    shards = math.ceil(total / c.postings)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item_id", "text"])
        postings = [(i, t, x) for i, (terms, impacts) in enumerate(zip(rows["terms"], rows["impacts"])) for t, x in zip(terms, impacts)]
        index = BlockMaxIndex(list(zip(rows["item_id"].tolist(), rows["text"])), postings, c)
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "index": [pickle.dumps(index)]})

    if not shards:
        return []
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    built = materialize(rows.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard int, index binary"), "index")
    return [built.filter(F.col("shard") == s).select("index") for s in range(shards)]


def _held(spark: SparkSession, shard: DataFrame) -> Broadcast | None:
    """A finished shard for all workers; bounded by ``postings``."""
    row = shard.first()
    return spark.sparkContext.broadcast(pickle.loads(row[0])) if row else None


_SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _search(index: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: BlockMaxIndex = index.value
        for batch in batches:
            for part in blocks(batch, "utf8", 1 << 20):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[d], shard.ids[i], s, q, a) for d, i, s, q, a in shard.search([t.decode("utf-8", "replace") for t in part.column("utf8").to_pylist()])]
                if rows:
                    columns = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
    return run


def find_leaks(docs: DataFrame, items: DataFrame, c: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document that holds a test item.

    Every passage of every whole text queries the index of all items; a scan of
    the documents has one shard of the index in memory, so there is one scan for
    each ``postings`` postings. Null and empty texts hold nothing; null document
    ids are kept, null item ids and items without words take no part; repeated
    documents are reported each, repeated items once; empty tables give an empty
    result; other columns are not read. Items of one part only (fewer than
    2 * SHINGLE words) are verified by that part, those of fewer than SHINGLE
    words by their whole run of words, in its order. Memory follows the longest
    text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("utf8"))
    out = spark.createDataFrame([], _SCHEMA)
    for shard in build_shards(items, c):
        if index := _held(spark, shard):
            out = out.union(rows.mapInArrow(_search(index), _SCHEMA))
    return out


def _leaks(index: Broadcast, text: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts), bool)
            cuts = np.flatnonzero(np.diff(np.cumsum(texts.str.len().to_numpy()) >> 20)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
                for d, *_ in index.value.search(texts.iloc[begin:end].tolist()):
                    out[begin + d] = True
            yield pd.Series(out)
    return run(F.coalesce(text, F.lit("")))


def without_leaks(docs: DataFrame, items: DataFrame, c: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item (see find_leaks), with all their columns.

    The shards of the index are applied one after the other, each to what the
    ones before it left.
    """
    for n, shard in enumerate(build_shards(items, c)):
        if index := _held(docs.sparkSession, shard):
            docs = materialize(docs, "clean") if n else docs
            docs = docs.filter(~_leaks(index, docs["text"]))
    return docs

"""Max-Min semantic chunking: cluster consecutive units, bound the clusters, make chunks."""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from docloom.functions.identity import chunk_id, content_checksum
from docloom.functions.text import word_count
from docloom.operators.sentences import split_oversized


@dataclass(frozen=True)
class ChunkingConfig:
    """Bounds and thresholds; invalid combinations are rejected."""
    strategy: str = "semantic_max_min"
    min_tokens: int = 80
    target_tokens: int = 450
    max_tokens: int = 600
    overlap_tokens: int = 0
    hard_threshold: float = 0.6
    similarity_coefficient: float = 0.9
    initialization_constant: float = 1.5

    def __post_init__(self):
        faults = [what for what, bad in (
            ("strategy is unknown", self.strategy not in ("fixed_window", "structure_recursive", "semantic_max_min")),
            ("token bounds must rise from 1: min, target, max", not 1 <= self.min_tokens <= self.target_tokens <= self.max_tokens),
            ("overlap must be from 0 to below max_tokens", not 0 <= self.overlap_tokens < self.max_tokens),
            ("semantic_max_min has no overlap", self.strategy == "semantic_max_min" and self.overlap_tokens != 0),
            ("hard_threshold must lie in [0, 1]", not 0 <= self.hard_threshold <= 1),
            ("similarity_coefficient must lie in (0, 2]", not 0 < self.similarity_coefficient <= 2),
            ("initialization_constant must lie in (0, 2]", not 0 < self.initialization_constant <= 2),
        ) if bad]
        if faults:
            raise ValueError("; ".join(faults))


class RunCounts:
    """Token counts of a document's runs of units as they are rendered, each asked for once.

    A run is named by its first unit and the unit behind its last. Without
    ``count`` tokens are words: where every gap ends or begins with white space
    these add up, so sums serve. With it the text of a run is counted, many
    runs to a call. ``rising`` says that counts do not fall when units are added
    at the end, as those of tokenizers do not; ends are then found by bisection
    from where the units' own counts put them. ``sizes`` are the units' own
    counts, if these are known.
    """

    def __init__(self, units: Sequence[dict], count: Count | None = None, rising: bool = True, batch: int = 256, sizes: list[int] | None = None):
        self.count, self.rising, self.batch = count, rising, batch
        texts = [u["text"] for u in units]
        gaps = ["" if not i else u["separator"] or "" for i, u in enumerate(units)]
        if count is None and not all(g[:1].isspace() or g[-1:].isspace() for g in gaps[1:]):
            self.count = lambda texts: [len(t.split()) for t in texts]
        self.sizes: list[int] = sizes if sizes is not None else [len(t.split()) for t in texts] if count is None else counted_in_turn(texts, count, batch)
        self.total = list(accumulate(self.sizes, initial=0))
        self.known: dict[tuple[int, int], int] = {}
        if self.count is not None:
            self.text = "".join(g + t for g, t in zip(gaps, texts))
            self.stops = np.cumsum([len(g) + len(t) for g, t in zip(gaps, texts)]).tolist()
            self.starts = [stop - len(t) for stop, t in zip(self.stops, texts)]

    def of(self, runs: Sequence[tuple[int, int]]) -> list[int]:
        if self.count is None:
            return [self.total[stop] - self.total[start] for start, stop in runs]
        new = [r for r in dict.fromkeys(runs) if r not in self.known]
        for at in range(0, len(new), self.batch):
            part = new[at:at + self.batch]
            self.known.update(zip(part, counted([self.text[self.starts[start]:self.stops[stop - 1]] for start, stop in part], self.count)))
        return [self.known[r] for r in runs]

    def one(self, start: int, stop: int) -> int:
        if self.count is None:
            return self.total[stop] - self.total[start]
        known = self.known.get((start, stop))
        return known if known is not None else self.of([(start, stop)])[0]

    def last_within(self, start: int, stop: int, most: int) -> int:
        """The last end up to ``stop`` with at most ``most`` tokens from ``start``, which itself counts as none; counts rise."""
        if stop <= start:
            return start
        if self.count is None:
            return min(stop, bisect_right(self.total, self.total[start] + most) - 1)
        guess = min(stop, max(start + 1, bisect_right(self.total, self.total[start] + most) - 1))
        step = 1
        if self.one(start, guess) <= most:
            low = guess
            while low + step <= stop and self.one(start, low + step) <= most:
                low, step = low + step, 2 * step
            high = min(low + step, stop + 1)
        else:
            high = guess
            while high - step > start and self.one(start, high - step) > most:
                high, step = high - step, 2 * step
            low = max(start, high - step)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.one(start, middle) <= most else (low, middle)
        return low

    def ends(self, start: int, stop: int, c: ChunkingConfig, rising: bool) -> tuple[np.ndarray, bool]:
        """Ends short of ``stop`` with at most max_tokens from ``start``: those that reach the target if any does (True), else the best of the others."""
        if rising:
            last, below = self.last_within(start, stop - 1, c.max_tokens), self.last_within(start, stop - 1, c.target_tokens - 1)
            return (np.arange(below + 1, last + 1), True) if below < last else (np.arange(last, last + 1)[last == start:], False)
        found = np.arange(start + 1, stop)
        counts = np.array(self.of([(start, e) for e in found.tolist()]))
        found, counts = found[counts <= c.max_tokens], counts[counts <= c.max_tokens]
        if (counts >= c.target_tokens).any():
            return found[counts >= c.target_tokens], True
        return found[np.lexsort((found, counts))[-1:]], False


def _cut_oversized(cluster: range, counts: RunCounts, close: np.ndarray, c: ChunkingConfig) -> list[range]:
    """Cuts of one cluster into runs whose text has at most max_tokens.

    Among the ends that reach the target, the cut goes where the neighbours are
    least alike, then nearest to the target, then first; if none reaches it,
    where the count is largest.
    """
    out, start, stop = [], cluster.start, cluster.stop
    while (counts.last_within(start, stop, c.max_tokens) < stop) if counts.rising else counts.one(start, stop) > c.max_tokens:
        for rising in (True, False) if counts.rising else (False,):
            ends, reach = counts.ends(start, stop, c, rising)
            if len(ends) > 1 and reach:
                ends = ends[close[ends] == close[ends].min()]
            if len(ends) > 1:
                away = abs(np.array(counts.of([(start, e) for e in ends.tolist()])) - c.target_tokens)
                ends = ends[np.lexsort((ends, away))]
            # a counter that falls after all is met by counting every end
            if len(ends) and counts.one(start, int(ends[0])) <= c.max_tokens:
                break
        else:
            raise ProviderFault("unit_over_maximum")
        out.append(range(start, int(ends[0])))
        start = int(ends[0])
    return [*out, range(start, stop)]


def affinity(unit: np.ndarray, left: range, right: range) -> float:
    """The largest cosine between units of two clusters."""
    return float((unit[left.start:left.stop] @ unit[right.start:right.stop].T).max())


def _merge_undersized(clusters: list[range], counts: RunCounts, unit: np.ndarray, c: ChunkingConfig) -> list[range]:
    """Neighbours joined while a cluster is under min_tokens and the text of the union fits: closest pair first, left before right, then the later one.

    The options lie in a heap; a join adds those of the new cluster and of its
    neighbours, and options of clusters that are gone are passed over.
    """
    begins, ends = {r.start: r for r in clusters}, {r.stop: r for r in clusters}
    heap: list[tuple] = []
    small = lambda r: counts.one(r.start, r.stop) < c.min_tokens

    def offer(left: range | None, right: range | None) -> None:
        if left is None or right is None:
            return
        under = [small(left), small(right)]
        if any(under) and counts.one(left.start, right.stop) <= c.max_tokens:
            near = affinity(unit, left, right)
            for is_small, r, to_left in zip(under, (left, right), (0, 1)):
                if is_small:
                    heapq.heappush(heap, (-near, -to_left, -r.start, left.start, left.stop, right.stop))

    under = [n < c.min_tokens for n in counts.of([(r.start, r.stop) for r in clusters])]
    if not any(under):
        return clusters
    near_small = [pair for pair, *either in zip(zip(clusters, clusters[1:]), under, under[1:]) if any(either)]
    counts.of([(left.start, right.stop) for left, right in near_small])
    for left, right in near_small:
        offer(left, right)
    while heap:
        *_, start, middle, stop = heapq.heappop(heap)
        left, right = begins.get(start), begins.get(middle)
        if left is None or right is None or left.stop != middle or right.stop != stop:
            continue
        del begins[middle], ends[middle]
        begins[start] = ends[stop] = joined = range(start, stop)
        offer(ends.get(start), joined)
        offer(joined, begins.get(stop))
    return sorted(begins.values(), key=lambda r: r.start)


def cluster_fold(unit: np.ndarray, c: ChunkingConfig) -> np.ndarray:
    """The cluster of each of a document's unit vectors, in order.

    A vector joins the open cluster of one if initialization_constant times
    their cosine exceeds the hard threshold, and a larger one if its largest
    cosine to the members exceeds both the hard threshold and the cluster's
    least pairwise cosine scaled by the coefficient and a sigmoid of the
    cluster's size; otherwise it opens the next cluster. All comparisons are
    strict.
    """
    out = np.zeros(len(unit), np.int32)
    start, least = 0, np.inf
    for i in range(1, len(unit)):
        sims = unit[start:i] @ unit[i]
        size = i - start
        if size <= _FEW:  # Python's own lists are quicker than arrays of a few numbers
            sims = sims.tolist()
            low, high = min(sims), max(sims)
        else:
            low, high = sims.min(), sims.max()
        bar = c.hard_threshold if size == 1 else max(c.hard_threshold, least * c.similarity_coefficient / _damping(size))
        best = c.initialization_constant * high if size == 1 else high
        if best > bar:
            least = min(least, low)
            out[i] = out[i - 1]
        else:
            start, least = i, np.inf
            out[i] = out[i - 1] + 1
    return out


_FEW = 32


@lru_cache(4096)
def _damping(size: int) -> float:
    return float(1 + np.exp(1 - size))


def bounded_clusters(vectors: np.ndarray, counts: RunCounts, c: ChunkingConfig) -> np.ndarray:
    """Cluster numbers of a document's units after the token bounds are enforced on their text; maximum strict, minimum where neighbours fit."""
    if not len(vectors):
        return np.zeros(0, np.int32)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    numbers = cluster_fold(unit, c)
    close = np.concatenate([[0.0], (unit[1:] * unit[:-1]).sum(axis=1)])  # of each unit to the one before
    starts = np.flatnonzero(np.concatenate([[True], np.diff(numbers) != 0]))
    runs = [range(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(numbers)])]
    runs = [r for cluster in runs for r in _cut_oversized(cluster, counts, close, c)]
    out = np.zeros(len(numbers), np.int32)
    for n, r in enumerate(_merge_undersized(runs, counts, unit, c)):
        out[r.start:r.stop] = n
    return out


def cluster_rows(rows: DataFrame, group: str, order: str, vector: str, c: ChunkingConfig) -> DataFrame:
    """(group, order, cluster) of vectors that lie in rows; a group is one document and fits a task. Unusable vectors are to be left out before."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(vector).cast("array<double>").alias("v"))))
    docs = rows.groupBy(F.col(group).cast("long").alias(group)).agg(items.alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, items in zip(b.column(group), b.column("items")):
                v = np.array([i["v"] for i in items.as_py()], float)
                numbers = cluster_fold(v / np.linalg.norm(v, axis=1, keepdims=True), c)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(v), pa.int64()), pa.array([i["o"] for i in items.as_py()], pa.int64()), pa.array(numbers)], names=[group, order, "cluster"])

    return docs.mapInArrow(run, f"{group} long, {order} long, cluster int")


def neighbour_affinities(rows: DataFrame, group: str, order: str, vector: str, cluster: str) -> DataFrame:
    """(group, cluster, affinity) of each cluster of a document with the one behind it; a group is one document and fits a task."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(cluster).cast("int").alias("c"), F.col(vector).cast("array<double>").alias("v"))))
    docs = rows.groupBy(F.col(group).cast("long").alias(group)).agg(items.alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, items in zip(b.column(group).to_pylist(), b.column("items").to_pylist()):
                v = np.array([i["v"] for i in items], float)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                numbers = np.array([i["c"] for i in items])
                starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(v)]
                runs = [range(x, y) for x, y in zip(starts, starts[1:])]
                near = [affinity(v, x, y) for x, y in zip(runs, runs[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(near), pa.int64()), pa.array(numbers[starts[:-2]], pa.int32()), pa.array(near, pa.float64())], names=[group, "cluster", "affinity"])

    return docs.mapInArrow(run, f"{group} long, cluster int, affinity double")


#: Vectors of a batch of texts, in order; and token counts of a batch of texts.
Embed = Callable[[list[str]], Sequence[Sequence[float]]]
Count = Callable[[list[str]], Sequence[int]]


def hashed_embeddings(texts: list[str], dimensions: int = 32) -> np.ndarray:
    """A deterministic local embedding: words hashed to signed dimensions. A text without words, or whose words cancel out, gets equal components."""
    words = [_WORDS.findall(t.lower()) for t in texts]
    hashes = np.fromiter(map(zlib.crc32, map(str.encode, chain.from_iterable(words))), np.int64)
    at = np.repeat(np.arange(len(texts)), list(map(len, words))) * dimensions + hashes % dimensions
    out = np.bincount(at, np.where(hashes // dimensions % 8 == 0, -1.0, 1.0), minlength=len(texts) * dimensions).reshape(-1, dimensions)
    out[~out.any(axis=1)] = 1.0
    return out


_WORDS = re.compile(r"\w+")


class ProviderFault(Exception):
    """What a provider returned cannot be used; the message is the reason."""


def embedded(texts: list[str], embed: Embed, batch: int) -> np.ndarray:
    """One usable vector per text, all of one dimension, from calls of at most ``batch`` texts."""
    if not texts:
        return np.zeros((0, 0))
    vectors: list = []
    for at in range(0, len(texts), batch):
        part = texts[at:at + batch]
        got = embed(part)
        if len(got) != len(part):
            raise ProviderFault("unexpected_vector_count")
        vectors += list(got)
    if len({len(v) for v in vectors}) > 1:
        raise ProviderFault("inconsistent_dimensions")
    try:
        out = np.array(vectors, float).reshape(len(texts), -1)
    except (TypeError, ValueError) as e:
        raise ProviderFault("invalid_vector") from e
    if not out.shape[1] or not np.isfinite(out).all():
        raise ProviderFault("invalid_vector")
    if not out.any(axis=1).all():
        raise ProviderFault("zero_length_vector")
    return out


class _Asked:
    """A document whose vectors are asked for: what came back so far, or why it cannot be used."""

    def __init__(self, payload: object, texts: list[str], fault: str | None):
        self.payload, self.left, self.fault = payload, 0 if fault else len(texts), fault
        self.parts: list[np.ndarray] = []

    def take(self, texts: list[str], ask: Callable[[list[str]], np.ndarray]) -> None:
        self.left -= len(texts)
        if self.fault is None:
            try:
                self.parts.append(ask(texts))
            except ProviderFault as e:
                self.fault = str(e)

    def vectors(self) -> np.ndarray:
        if len({p.shape[1] for p in self.parts}) > 1:
            raise ProviderFault("inconsistent_dimensions")
        return np.concatenate(self.parts) if self.parts else np.zeros((0, 0))


def vectors_in_turn(documents: Iterator[tuple[object, list[str], str | None]], embed: Embed, batch: int) -> Iterator[tuple[object, np.ndarray | None, str | None]]:
    """(payload, vectors, fault) of documents (payload, texts, fault) in their order; a document with a fault is not asked for.

    Texts of one document after the other fill each call, so n texts take
    ceil(n / batch) calls. If a call is answered in a way that cannot be used,
    its texts are asked for document by document, which finds whose fault it is.
    """
    waiting: deque[_Asked] = deque()
    queue: list[tuple[_Asked, str]] = []

    def call(items: list[tuple[_Asked, str]]) -> None:
        try:
            got = embedded([t for _, t in items], embed, batch)
        except ProviderFault:
            for doc, own in groupby(items, key=lambda x: x[0]):
                doc.take([t for _, t in own], lambda texts: embedded(texts, embed, batch))
            return
        at = 0
        for doc, own in groupby(items, key=lambda x: x[0]):
            texts = [t for _, t in own]
            part, at = got[at:at + len(texts)], at + len(texts)
            doc.take(texts, lambda _, part=part: part)

    def done() -> Iterator[tuple[object, np.ndarray | None, str | None]]:
        while waiting and not waiting[0].left:
            doc = waiting.popleft()
            try:
                yield (doc.payload, None, doc.fault) if doc.fault else (doc.payload, doc.vectors(), None)
            except ProviderFault as e:
                yield doc.payload, None, str(e)

    for payload, texts, fault in documents:
        doc = _Asked(payload, texts, fault)
        waiting.append(doc)
        if fault is None:
            queue += [(doc, t) for t in texts]
        full = len(queue) // batch * batch
        for at in range(0, full, batch):
            call(queue[at:at + batch])
        del queue[:full]
        yield from done()
    if queue:
        call(queue)
    yield from done()


def counted(texts: list[str], count: Count) -> list[int]:
    got = list(count(texts))
    if len(got) != len(texts) or any(not isinstance(n, int) or isinstance(n, bool) or n < 1 for n in got):
        raise ProviderFault("invalid_token_count")
    return got


def counted_in_turn(texts: list[str], count: Count, batch: int = 256) -> list[int]:
    return [n for at in range(0, len(texts), batch) for n in counted(texts[at:at + batch], count)]


def longest_prefix(text: str, start: int, ends: Sequence[int], most: int, count: Count) -> int | None:
    """How many of the rising ``ends`` of prefixes of text[start:] can be taken with at most ``most`` tokens, less one; None if not the first.

    Steps double until the count is over the maximum, then halve: counts rise
    with the text, so what is counted is little longer than what is returned.
    """
    def fits(i: int) -> bool:
        part = text[start:ends[i]].strip()
        return bool(part) and counted([part], count)[0] <= most

    if not len(ends) or not fits(0):
        return None
    low, step = 0, 1
    while low + step < len(ends) and fits(low + step):
        low, step = low + step, 2 * step
    high = min(low + step, len(ends))
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def split_by_tokens(text: str, most: int, count: Count) -> list[tuple[str, str]]:
    """(gap, text) pieces of at most ``most`` tokens: as many whole words as fit, and of a word that does not fit as many characters."""
    ends = [m.end() for m in re.finditer(r"\S+\s*", text)]
    out, start, word, before = [], len(text) - len(text.lstrip()), 0, 0
    while start < len(text):
        place = longest_prefix(text, start, _Tail(ends, word), most, count)
        if place is not None:
            word += place + 1
            stop = ends[word - 1]
        else:
            letters = range(start + 1, ends[word] + 1)
            place = longest_prefix(text, start, letters, most, count)
            if place is None:
                raise ProviderFault("character_over_maximum")
            stop = letters[place]
            word += stop == ends[word]
        piece = text[start:stop].strip()
        begin = text.index(piece, start)
        out.append((text[before:begin] if out else "", piece))
        before, start = begin + len(piece), stop
    return out


class _Tail(Sequence):
    """A list from some place on, without a copy."""

    def __init__(self, values: Sequence[int], start: int):
        self.values, self.start = values, start

    def __len__(self) -> int:
        return len(self.values) - self.start

    def __getitem__(self, i: int) -> int:
        return self.values[self.start + i]


@dataclass(frozen=True)
class ParentConfig:
    """Parents of chunks: runs of whole chunks whose first units share ``depth`` headings, of at most ``max_tokens`` unless a chunk is larger by itself."""
    max_tokens: int = 2000
    depth: int = 1

    def __post_init__(self):
        if self.max_tokens < 1 or self.depth < 0:
            raise ValueError("max_tokens must be at least 1 and depth at least 0")


def parent_runs(runs: Sequence[dict], units: Sequence[dict], counts: RunCounts, parents: ParentConfig) -> list[dict]:
    """The chunks of a document packed into parents, as runs of units and of chunks (``child``, ``children``); tokens are those of the parent's text."""
    out: list[dict] = []
    section = None
    for i, run in enumerate(runs):
        stop, own = run["first"] + run["size"], list(units[run["first"]]["heading_path"] or [])[:parents.depth]
        if out and own == section and (n := counts.one(out[-1]["first"], stop)) <= parents.max_tokens:
            out[-1] |= {"size": stop - out[-1]["first"], "tokens": n, "children": out[-1]["children"] + 1}
        else:
            out.append({"first": run["first"], "size": run["size"], "tokens": run["tokens"], "child": i, "children": 1})
        section = own
    return out


def plan_chunks(docs: DataFrame, c: ChunkingConfig, embed: Embed = hashed_embeddings, count: Count | None = None, batch: int = 32, rising: bool = True, parents: ParentConfig | None = None) -> DataFrame:
    """(document_id, document_version, units, tokens, runs, parents, fault): the runs of units that are chunks, one row per document.

    ``embed`` gives the vectors of the units, asked for ``batch`` at a time; the
    units of a partition's documents fill each call (see vectors_in_turn).
    Without ``count`` tokens are words and units are cut as expressions; with it
    units are cut where they are counted, and a run's tokens are those of its
    text, which need not be the sum of its units' (see RunCounts). ``parents``
    are runs of chunks, none without a ParentConfig. ``fault`` says why a document has no
    runs: what a provider returned for it could not be used.
    """
    if count is None:
        docs = docs.withColumn("units", split_oversized(c.max_tokens))
    kept = docs.select("document_id", "document_version", "units")

    read = ("text", "separator", "heading_path") if parents else ("text", "separator")

    def prepared(units: list[dict], whole: pa.Scalar) -> tuple[list[dict], RunCounts, bool]:
        """Units with what is read of them (all of it if any was cut), their counts, and whether any was cut."""
        if count is None:
            return units, RunCounts(units, count, rising), False
        sizes = counted_in_turn([u["text"] for u in units], count)
        if all(n <= c.max_tokens for n in sizes):
            return units, RunCounts(units, count, rising, sizes=sizes), False
        made = []
        for u, n in zip(whole.as_py(), sizes):
            pieces = split_by_tokens(u["text"], c.max_tokens, count) if n > c.max_tokens else None
            made += [u] if pieces is None else [u | {"text": t, "separator": gap if i else u["separator"], "forced": True} for i, (gap, t) in enumerate(pieces)]
        return made, RunCounts(made, count, rising), True

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in _slices(batches, DOCUMENTS):
            for i, units in enumerate(_light(b.column("units"), read)):
                try:
                    units, counts, cut = prepared(units, b.column("units")[i])
                    yield (b, i, units, counts, cut), [u["text"] for u in units], None
                except ProviderFault as e:
                    yield (b, i, [], None, False), [], str(e)

    def planned(units: list[dict], counts: RunCounts, vectors: np.ndarray) -> tuple[list[dict], list[dict]]:
        sizes = np.bincount(bounded_clusters(vectors, counts, c)).tolist() if units else []
        firsts = [int(stop) - size for stop, size in zip(np.cumsum(sizes), sizes)]
        held = counts.of([(first, first + size) for first, size in zip(firsts, sizes)])
        runs = [{"first": first, "size": size, "tokens": n} for first, size, n in zip(firsts, sizes, held)]
        return runs, parent_runs(runs, units, counts, parents) if parents else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        made: dict[int, list[dict]] = {}  # units that are not those of the row any more
        for (b, i, units, counts, cut), vectors, fault in vectors_in_turn(documents(batches), embed, batch):
            try:
                row = (counts.sizes, *planned(units, counts, vectors), None) if fault is None else ([], [], [], fault)
            except ProviderFault as e:
                row = [], [], [], str(e)
            rows.append(row)
            if count is not None and (cut or row[-1] is not None):
                made[i] = units if row[-1] is None else []
            if i + 1 == b.num_rows:
                tokens, runs, families, faults = zip(*rows)
                column = b.column("units")
                if made:
                    column = _replaced(column, made)
                yield pa.RecordBatch.from_arrays(
                    [b.column("document_id"), b.column("document_version"), column, pa.array(tokens, pa.list_(pa.int32())), pa.array(runs, _RUNS), pa.array(families, _PARENTS), pa.array(faults, pa.string())],
                    names=["document_id", "document_version", "units", "tokens", "runs", "parents", "fault"])
                rows.clear()
                made.clear()

    run_type = StructType().add("first", "integer").add("size", "integer").add("tokens", "integer")
    parent_type = StructType(list(run_type.fields)).add("child", "integer").add("children", "integer")
    schema = StructType(list(kept.schema.fields)).add("tokens", ArrayType(IntegerType())).add("runs", ArrayType(run_type)).add("parents", ArrayType(parent_type)).add("fault", "string")
    return kept.mapInArrow(run, schema)


_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32()), ("tokens", pa.int32())]))
_PARENTS = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "size", "tokens", "child", "children")]))


#: Documents whose units and plans a task holds as Python objects at once.
DOCUMENTS = 256


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _replaced(column: pa.Array, rows: dict[int, list]) -> pa.Array:
    """``column`` with other values in some rows, which are given in order."""
    parts, at = [], 0
    for i, value in rows.items():
        parts += [column.slice(at, i - at), pa.array([value], column.type)]
        at = i + 1
    return pa.concat_arrays([*parts, column.slice(at)])


def _light(column: pa.ListArray, fields: Sequence[str]) -> Iterator[list[dict]]:
    """The structs of each row with some of their fields only."""
    held = column.flatten()
    values = iter(zip(*(_read(held.field(held.type.get_field_index(n))) for n in fields)))
    for n in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        yield [dict(zip(fields, v)) for v in islice(values, n)]


def _read(values: pa.Array) -> list:
    """The values, None for lists if all of them are empty."""
    empty = pa.types.is_list(values.type) and not pc.any(pc.not_equal(pc.list_value_length(values), 0)).as_py()
    return [None] * len(values) if empty else values.to_pylist()


def common_path(paths: Column) -> Column:
    """The longest common prefix of an array of string arrays; empty for no arrays."""
    def shorten(acc, path):
        same = F.transform(F.zip_with(acc, path, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
        first_other = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)), (F.size(same) + 1).cast("long"))
        return F.slice(acc, F.lit(1), (first_other - 1).cast("int"))
    return F.coalesce(F.aggregate(paths, paths[0], shorten), F.array().cast("array<string>"))


def chunk_documents(docs: DataFrame, c: ChunkingConfig = ChunkingConfig(), name: str = "semantic_max_min", version: str = "1",
                    embed: Embed = hashed_embeddings, count: Count | None = None, batch: int = 32, rising: bool = True) -> DataFrame:
    """Chunks of documents with ``units`` (see sentences.units): one row per chunk, in the order of chunk_index.

    A document stays one row until its chunks are made; only the links between
    finished chunks shuffle. A document without units has no chunks, nor has one
    for which a provider failed (see plan_chunks for its fault).
    """
    return render_chunks(plan_chunks(docs, c, embed, count, batch, rising), c, name, version, count)


def render_chunks(plan: DataFrame, c: ChunkingConfig = ChunkingConfig(), name: str = "semantic_max_min", version: str = "1", count: Count | None = None) -> DataFrame:
    """The chunks of a plan (see plan_chunks), with the counter that it was made with."""
    made = F.transform("runs", lambda r: F.struct(r.alias("run"), _own(r).alias("us")))
    d = plan.select("document_id", "document_version", F.posexplode(made).alias("chunk_index", "made")).select("document_id", "document_version", "chunk_index", "made.*")
    return _linked(_rendered(d, c, F.lit(name), version, count), ["document_id", "document_version"])


def _own(run: Column) -> Column:
    """The units of a run, so that a row of a run holds no others."""
    return F.slice("units", run["first"] + 1, run["size"])


def _rendered(d: DataFrame, c: ChunkingConfig, name: Column, version: str, count: Count | None, *kept: str) -> DataFrame:
    """Chunks without links of rows (document_id, document_version, chunk_index, run, us), and the columns ``kept``."""
    us = F.col("us")
    content = F.concat(us[0]["text"], F.array_join(F.transform(F.slice(us, 2, F.size(us)), lambda u: F.concat(u["separator"], u["text"])), ""))
    kinds = F.array_distinct(F.transform(us, lambda u: u["element_type"]))
    pages = F.filter(F.transform(us, lambda u: u["page_number"]), lambda p: p.isNotNull())
    tokens = word_count(F.col("content")) if count is None else F.col("run.tokens")
    d = d.withColumn("content", content).select(
        "document_id", "document_version", F.lit(None).cast("string").alias("parent_chunk_id"), "chunk_index", "content", F.col("content").alias("embedding_text"),
        content_checksum(F.col("content")).alias("content_checksum"), tokens.alias("token_count"), F.when(F.size(kinds) == 1, kinds[0]).otherwise("mixed").alias("content_type"),
        F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), common_path(F.transform(us, lambda u: u["heading_path"])).alias("heading_path"),
        F.array_distinct(F.transform(us, lambda u: u["element_id"])).alias("element_ids"), F.array_distinct(F.transform(us, lambda u: u["element_order"])).alias("element_orders"),
        F.col("run.first").alias("unit_start"), (F.col("run.first") + F.col("run.size") - 1).alias("unit_end"), F.exists(us, lambda u: u["forced"]).alias("forced_token_split"),
        name.alias("chunker_name"), F.lit(version).alias("chunker_version"), *kept)
    return d.withColumn("below_min_tokens", F.col("token_count") < c.min_tokens).withColumn("chunk_id", chunk_id(
        F.col("document_id"), F.col("document_version"), F.col("chunker_name"), F.col("chunker_version"), F.col("chunk_index"), F.col("content_checksum")))


def _linked(chunks: DataFrame, by: list[str]) -> DataFrame:
    # links need the neighbours' ids: the only shuffle, by document, of finished chunks
    along = Window.partitionBy(*by).orderBy("chunk_index")
    return chunks.withColumns({"previous_chunk_id": F.lag("chunk_id").over(along), "next_chunk_id": F.lead("chunk_id").over(along)})


def family_rows(plan: DataFrame, c: ChunkingConfig = ChunkingConfig(), name: str = "semantic_max_min", version: str = "1", count: Count | None = None) -> DataFrame:
    """Parents and chunks of a plan with parents (see plan_chunks), each rendered once, without links.

    Beside a chunk's columns: ``is_parent``, ``parent_index`` (of the parent or
    of the one that holds the chunk; with the document it names a family), and
    ``children``, how many a parent holds.
    """
    row = lambda run, **more: F.struct(
        *[F.lit(v).alias(n) if isinstance(v, bool) else v.cast("int").alias(n) for n, v in more.items()], F.struct(run["first"], run["size"], run["tokens"]).alias("run"), _own(run).alias("us"))
    family = lambda p, i: F.concat(
        F.array(row(p, is_parent=True, chunk_index=i, parent_index=i, children=p["children"])),
        F.transform(F.slice("runs", p["child"] + 1, p["children"]), lambda r, j: row(r, is_parent=False, chunk_index=p["child"] + j, parent_index=i, children=F.lit(None))))
    d = plan.select("document_id", "document_version", F.explode(F.flatten(F.transform("parents", family))).alias("made")).select("document_id", "document_version", "made.*")
    return _rendered(d, c, F.when(F.col("is_parent"), f"{name}_parents").otherwise(name), version, count, "is_parent", "parent_index", "children")


def render_families(plan: DataFrame, c: ChunkingConfig = ChunkingConfig(), name: str = "semantic_max_min", version: str = "1", count: Count | None = None) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of a plan with parents (see plan_chunks): chunks of two levels, linked both ways.

    Children are the chunks of render_chunks with their ``parent_chunk_id``;
    parents are chunks of their own with ``child_chunk_ids`` in order, a row as
    large as a parent's bound allows. Finished chunks shuffle once, by document.
    """
    by = ["document_id", "document_version"]
    rows = _linked(family_rows(plan, c, name, version, count).repartition(*by), [*by, "is_parent"])
    family = Window.partitionBy(*by, "parent_index")
    child = F.when(~F.col("is_parent"), F.struct("chunk_index", "chunk_id"))
    rows = rows.withColumns({
        "parent_chunk_id": F.when(~F.col("is_parent"), F.max(F.when(F.col("is_parent"), F.col("chunk_id"))).over(family)),
        "child_chunk_ids": F.transform(F.array_sort(F.collect_list(child).over(family)), lambda x: x["chunk_id"])})
    inner = ["is_parent", "parent_index", "children"]
    return rows.filter("is_parent").drop(*inner), rows.filter("not is_parent").drop(*inner, "child_chunk_ids")

"""SimHash fingerprints of word shingles, and near-duplicate groups by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import connected_components
from docloom.llm.ranking import join_facts
from docloom.llm.texts import token_runs, utf8
from docloom.sources.tables import materialize

SEED = 42
BUDGET = 2
#: The fingerprint is cut into BUDGET + 1 blocks: fingerprints within the budget agree on one of them.
CUTS = ((0, 22), (22, 43), (43, 64))
#: Buckets larger than this are split into node pairs of a deeper trie level before they reach a task.
BUCKET = 2048
#: Node pairs that are taken down at once, and fingerprints that one traversal reads.
_FRONTIER = 1 << 20
_ROWS = 1 << 16


def hashes_of(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles in order, repeats and all, in slices; a text of fewer words is one shingle, one without words has none."""
    digest = xxhash.xxh64_intdigest
    for run in token_runs(text, words - 1):
        shingles = [b" ".join(run)] if len(run) < words else map(b" ".join, zip(*[run[j:] for j in range(words)]))
        yield np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def fingerprint_of(slices: Iterable[np.ndarray]) -> np.uint64:
    """SimHash of a text's hashes: bit b is 1 if more than half of them have it; 0 without any."""
    n, sums = 0, np.zeros(64, np.int64)
    for hashes in slices:
        n += len(hashes)
        sums += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(sums * 2 > n).view(">u8")[0]


def fingerprints_of(texts: list[bytes], words: int = 3) -> np.ndarray:
    """SimHash of each text's shingles."""
    return np.array([fingerprint_of(hashes_of(t, words)) for t in texts], np.uint64)


def fingerprint(words: int = 3):
    """An Arrow UDF: UTF-8 bytes to the fingerprint as a signed long. Memory follows the longest text, not its shingles."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints_of(texts.tolist(), words).view(np.int64))
    return run


def _pairs(values: np.ndarray, roots: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs within the budget below pairs of trie nodes.

    A node is a run of ``values`` that is sorted and distinct in itself, read as
    a binary trie; ``roots`` are the node pairs to begin with, as rows (begin,
    end, begin, end), and a node paired with itself gives each of its pairs
    once. Node pairs are taken down together, level by level: children on the
    same side keep the bits that differ so far, children on opposite sides add
    one, and pairs over the budget are pruned. Two nodes of one fingerprint
    each are compared at once. The frontier is worked on in bounded pieces,
    depth first.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(0, np.column_stack([roots, np.zeros(len(roots), np.int64)]))]
    while stack:
        level, nodes = stack.pop()
        if len(nodes) > _FRONTIER:
            half = len(nodes) // 2
            stack += [(level, nodes[half:]), (level, nodes[:half])]
            continue
        single = (nodes[:, 1] - nodes[:, 0] == 1) & (nodes[:, 3] - nodes[:, 2] == 1)
        i, j = nodes[single, 0], nodes[single, 2]
        near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        if near.any():
            yield i[near], j[near]
        nodes = nodes[~single]
        if not len(nodes):
            continue
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - level)) & np.uint64(1))]).astype(np.int64)
        before = ones[level]
        # inside a node rows are sorted and share the prefix, so zeros come first
        a0, a1, b0, b1, d = nodes.T
        am, bm = a1 - (before[a1] - before[a0]), b1 - (before[b1] - before[b0])
        other = ~((a0 == b0) & (a1 == b1))  # a node with itself: one order of its two sides is enough
        found = np.concatenate([np.stack(x, axis=1) for x in (
            (a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), tuple(x[other] for x in (am, a1, b0, bm, d + 1)))])
        found = found[(found[:, 0] < found[:, 1]) & (found[:, 2] < found[:, 3]) & (found[:, 4] <= budget)]
        if len(found):
            stack.append((level + 1, found))


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the least node it is linked to through the pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            open_ = low < high
            if not open_.any():
                break
            np.minimum.at(root, high[open_], low[open_])
            while (root != root[root]).any():
                root = root[root]
    return root


_KEY = ("cut", "value", "low", "high")
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bucket_links(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Links inside the node pairs of many buckets, as a spanning forest: (a, b) signed fingerprints."""
    values = fp.view(np.uint64)
    order = np.lexsort((values, side, group))
    group, side, values = group[order], side[order], values[order]
    begin = np.concatenate([[0], np.flatnonzero((np.diff(group) != 0) | (np.diff(side) != 0)) + 1])
    end = np.concatenate([begin[1:], [len(values)]])
    alone = np.flatnonzero(side[begin] == 2)
    first = np.flatnonzero((side[begin[:-1]] == 0) & (side[begin[1:]] == 1) & (group[begin[:-1]] == group[begin[1:]]))
    left, right = np.concatenate([alone, first]), np.concatenate([alone, first + 1])
    root = _forest(len(values), _pairs(values, np.stack([begin[left], end[left], begin[right], end[right]], axis=1), BUDGET))
    linked = np.flatnonzero(root != np.arange(len(values)))
    return pa.RecordBatch.from_arrays([pa.array(values[linked].view(np.int64)), pa.array(values[root[linked]].view(np.int64))], schema=_LINKS)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by bucket and node pair: whole groups are gathered into traversals of about _ROWS fingerprints."""
    held: list[tuple[np.ndarray, ...]] = []
    size, last, number = 0, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in _KEY], axis=1).astype(np.int64)
        new = np.concatenate([[last is None or bool((key[0] != last).any())], (key[1:] != key[:-1]).any(axis=1)])
        group = number + np.cumsum(new)
        number, last = int(group[-1]), key[-1]
        rows = (group, batch.column("side").to_numpy(), batch.column("fp").to_numpy())
        starts = np.flatnonzero(new)
        if size + len(group) >= _ROWS and len(starts):
            cut = int(starts[-1])  # the last group may go on in the next batch
            held.append(tuple(x[:cut] for x in rows))
            yield _bucket_links(*map(np.concatenate, zip(*held)))
            held, size, rows = [], 0, tuple(x[cut:] for x in rows)
        held.append(rows)
        size += len(rows[0])
    if size:
        yield _bucket_links(*map(np.concatenate, zip(*held)))


def _bits(fp: Column, begin: int, end: int) -> Column:
    """Bits begin..end of the fingerprint, counted from the highest."""
    return F.shiftrightunsigned(fp, 64 - end).bitwiseAND(F.lit((1 << (end - begin)) - 1))


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints (column fp, long) within the budget.

    Fingerprints within the budget agree on at least one of BUDGET + 1 blocks,
    so each goes to that many buckets, one per block value: the subtrie below
    that block, rotated to the front. A bucket of more than BUCKET fingerprints
    is split at a deeper level: its fingerprints go to one group per pair of
    nodes of that level whose prefixes are within the budget. A task takes the
    groups of its partition down together (see _pairs) and returns a spanning
    forest of their links, never all pairs. All buckets are searched; none is
    capped.
    """
    cuts = F.array(*[F.struct(F.lit(i).alias("cut"), _bits(F.col("fp"), b, e).alias("value"), _bits(F.col("fp"), *_below(e)).alias("below")) for i, (b, e) in enumerate(CUTS)])
    keyed = fingerprints.select("fp", F.explode(cuts).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("cut", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    depth = F.when(F.col("n") > BUCKET, F.least(F.lit(_DEPTH), F.ceil(F.log2(F.col("n") / BUCKET)) + 1)).otherwise(0).cast("int")
    shared = keyed.join(sizes, ["cut", "value"]).withColumn("depth", depth)
    node = F.expr(f"shiftright(below, {_DEPTH} - depth)")
    masks = F.expr("""
        flatten(array(array(0L),
            if(depth = 0, array(), transform(sequence(0, depth - 1), i -> shiftleft(1L, i))),
            if(depth < 2, array(), flatten(transform(sequence(1, depth - 1), i -> transform(sequence(0, i - 1), j -> shiftleft(1L, i) + shiftleft(1L, j)))))))""")
    placed = shared.withColumn("node", node).withColumn("mask", F.explode(masks))
    other = F.col("node").bitwiseXOR(F.col("mask"))
    placed = placed.select(
        "fp", "cut", "value", F.least("node", other).alias("low"), F.greatest("node", other).alias("high"),
        F.when(F.col("mask") == 0, 2).when(F.col("node") < other, 0).otherwise(1).alias("side"))
    n = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_links, "a long, b long")


#: Levels below a block that a large bucket may be split at.
_DEPTH = 12


def _below(end: int) -> tuple[int, int]:
    """The bits after a block, going round to the first ones after the last block."""
    return (end, end + _DEPTH) if end < 64 else (0, _DEPTH)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Fingerprints at BUDGET or fewer differing bits are linked; a component's id
    is its smallest doc_id. Copies share a fingerprint and meet as one node, and
    fingerprints that many rows share are joined back by broadcast (see
    join_facts). Texts without words (null, empty, blank) have fingerprint zero
    and link like any other; null ids keep their row and count last for the
    smallest id; repeated rows come back as often as they came; texts of any
    length are read whole, in slices; an empty table gives an empty result.
    Other columns are not read.
    """
    rows = materialize(docs.select("doc_id", fingerprint(words)(utf8()).alias("fp")), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    roots = connected_components(fingerprint_links(distinct.select("fp")))
    named = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"), "least", "n"), "named")
    components = materialize(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps")), "components")
    facts = materialize(join_facts(named, components, "component", "fps").select("fp", "component_id", "n"), "facts")
    return join_facts(rows, facts, "fp", "n").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""Near copies: groups of texts whose five-word shingle sets have a Jaccard similarity of at least 0.8.

Candidates are what the trie join of SimHash fingerprints links (see simhash),
and, as similar texts may differ in more bits than it can be asked for, what
meets in bands of MinHash values. Every candidate pair is then checked on its
whole shingle sets, so no pair below the similarity is linked.
A pair at exactly 0.8 misses all bands with probability (1 - 0.8**4)**24 = 3e-6,
a closer one with less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from docloom.llm.components import connected_components
from docloom.llm.ranking import join_facts
from docloom.llm.simhash import fingerprint_links, fingerprint_of, hashes_of
from docloom.llm.texts import utf8
from docloom.sources.tables import materialize

SEED = 42
WORDS = 5
BANDS, ROWS = 24, 4
#: Classes of either side that are compared in one group, and classes that are held against one copy of their leader.
BLOCK, FOLLOWERS = 256, 64
_PIECE, _SLICE = 4096, 1 << 16
_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles_of(text: bytes) -> np.ndarray:
    """XXH64 of the text's shingles in order, repeats and all; a text of fewer words is one shingle, one without words has none."""
    return np.concatenate([np.zeros(0, np.uint64), *hashes_of(text, WORDS)])


def bands_of(shingles: np.ndarray) -> list[int]:
    """BANDS numbers, each of ROWS least hashes of the set: two sets agree on one with probability similarity ** ROWS."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _PIECE):
        least = np.minimum(least, (shingles[at:at + _PIECE, None] * _TIMES + _PLUS).min(axis=0))
    values = np.array([xxhash.xxh64_intdigest(least[i:i + ROWS].tobytes(), SEED) for i in range(0, len(least), ROWS)], np.uint64)
    return values.view(np.int64).tolist()


def _class_of(text: bytes) -> int:
    """A signed number for the text's words: texts that differ only in case and white space share it."""
    n = xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)
    return n - (1 << 64) if n >> 63 else n


@F.pandas_udf(ArrayType(LongType()))
def _sketch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out = []
        for t in texts:
            shingles = shingles_of(t)
            fp = int(fingerprint_of(shingles[at:at + _SLICE] for at in range(0, len(shingles), _SLICE)))
            out.append([_class_of(t), fp - (1 << 64) if fp >> 63 else fp, *bands_of(shingles)])
        yield pd.Series(out, dtype=object)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) have a Jaccard similarity of at least 0.8, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _arrow(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=_LINKS)


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[bool, list]]:
    """(whether a group begins, values) of the rows of a partition that is sorted by group; texts stay in Arrow till asked for."""
    last = None
    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in key))
        for k, *row in zip(keys, *(batch.column(c).to_pylist() for c in columns), batch.column("text")):
            yield k != last, row
            last = k


def _leader_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of classes to the leader in front of their group: one text is held beside the current one."""
    links, leader, held = [], None, None
    for begins, (name, text) in _groups(batches, ("leader", "block"), ("class",)):
        shingles = np.unique(shingles_of(text.as_py()))
        if begins:
            leader, held = name, shingles
        elif similar(held, shingles):
            links.append((leader, name))
        if len(links) > 10_000:
            yield _arrow(links)
            links = []
    yield _arrow(links)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the two sides of each group that join components: what is connected already is not compared."""
    links, left, root = [], [], {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for begins, (side, name, component, text) in _groups(batches, ("bucket", "block", "other"), ("side", "class", "component")):
        if begins:
            left, root = [], {}
            if len(links) > 10_000:
                yield _arrow(links)
                links = []
        shingles = np.unique(shingles_of(text.as_py()))
        if side == 0:  # the sides come in order
            left.append((name, component, shingles))
            continue
        for other, of, known in left:
            a, b = find(component), find(of)
            if a != b and similar(known, shingles):
                root[max(a, b)] = min(a, b)
                links.append((name, other))
    yield _arrow(links)


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """(leader, class) pairs that the trie join of the classes' fingerprints links: the least classes of linked fingerprints, and those of one fingerprint."""
    firsts = materialize(classes.groupBy("fp").agg(F.min("class").alias("leader"), F.count(F.lit(1)).alias("n")), "firsts")
    a, b = firsts.select(F.col("fp").alias("a"), F.col("leader").alias("x")), firsts.select(F.col("fp").alias("b"), F.col("leader").alias("y"))
    near = fingerprint_links(firsts.select("fp")).join(a, "a").join(b, "b").select(F.least("x", "y").alias("leader"), F.greatest("x", "y").alias("class"))
    return near.union(join_facts(classes.select("class", "fp"), firsts, "fp", "n").filter("class <> leader").select("leader", "class"))


def _class_links(classes: DataFrame, docs: DataFrame, row_key: str, proposed: DataFrame | None = None) -> DataFrame:
    """(a, b) links that connect the similar classes (columns class, bands, row_key); ``docs`` has their texts.

    ``proposed`` are pairs (leader, class) to be checked beside those that meet.

    Classes that share a band value meet in a bucket. First each is held against
    the least class of its buckets, which settles families of near copies in as
    many comparisons as they have members. Only buckets that still hold several
    components are searched further: the classes outside the bucket's largest
    component against all of it, in pairs of blocks.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def with_text(rows: DataFrame) -> DataFrame:
        wanted = rows.select("class").distinct().join(classes.select("class", "row_key"), "class")
        texts = wanted.join(docs.select(F.col(row_key).alias("row_key"), utf8().alias("text")), "row_key").dropDuplicates(["class"]).select("class", "text")
        return rows.join(texts, "class")

    def dealt(rows: DataFrame, kernel, key: list[str], then: list[str]) -> DataFrame:
        return with_text(rows).repartition(n, *key).sortWithinPartitions(*key, *then).mapInArrow(kernel, "a long, b long")

    keyed = materialize(classes.select("class", F.explode(F.transform("bands", lambda v, i: F.xxhash64(i, v))).alias("bucket")), "keyed")
    buckets = materialize(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("leader")).filter("n > 1"), "buckets")
    met = materialize(join_facts(keyed, buckets, "bucket", "n"), "met")
    pairs = met.filter("class <> leader").select("leader", "class")
    pairs = materialize((pairs if proposed is None else pairs.union(proposed)).distinct(), "pairs")
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / F.lit(FOLLOWERS)).alias("blocks"))
    leaders = sizes.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("class"), F.lit(0).alias("at"))
    followers = pairs.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("class"), "blocks").alias("block"), "class", F.lit(1).alias("at"))
    links = materialize(dealt(leaders.union(followers), _leader_links, ["leader", "block"], ["at"]), "links")

    named = met.join(connected_components(links).withColumnRenamed("node", "class"), "class", "left")
    named = materialize(named.select("class", "bucket", F.coalesce("root", "class").alias("component")), "named")
    members = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    rest = members.groupBy("bucket").agg(F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("most"), F.count(F.lit(1)).alias("components")).filter("components > 1")
    rest = materialize(rest.select("bucket", "n", F.col("most.component").alias("largest"), F.ceil((F.col("n") - F.col("most.m")) / F.lit(BLOCK)).alias("blocks"), F.ceil(F.col("n") / F.lit(BLOCK)).alias("others")), "open")
    open_ = join_facts(named, rest, "bucket", "n")
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    left = open_.filter("component <> largest").select("bucket", F.pmod(F.xxhash64("class"), "blocks").alias("block"), each("others").alias("other"), F.lit(0).alias("side"), "class", "component")
    right = open_.select("bucket", each("blocks").alias("block"), F.pmod(F.xxhash64("class", F.lit(1)), "others").alias("other"), F.lit(1).alias("side"), "class", "component")
    return links.union(dealt(left.union(right), _block_links, ["bucket", "block", "other"], ["side"]))


def first_rows(docs: DataFrame, row_key: str) -> DataFrame:
    """(class, component, doc_id, row_key): the first row of each class of equal words, and the component of its near copies.

    Rows of a class are ordered by doc_id, null last, then ``row_key``. Texts
    without words (null, empty, blank) are one class. A component's name is its
    least class. Copies are merged before anything is joined, so a hot text is
    one row from there on; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.col(row_key).alias("row_key"), _sketch(utf8()).alias("sketch"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "sketch")).alias("first")
    classes = materialize(rows.withColumn("class", F.col("sketch")[0]).groupBy("class").agg(first).select(
        "class", "first.doc_id", "first.row_key", F.col("first.sketch")[1].alias("fp"), F.slice("first.sketch", 3, BANDS).alias("bands")), "classes")
    roots = connected_components(_class_links(classes, docs, row_key, _fingerprint_pairs(classes))).withColumnRenamed("node", "class")
    return classes.join(roots, "class", "left").select("class", F.coalesce("root", "class").alias("component"), "doc_id", "row_key")

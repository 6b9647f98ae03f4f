"""Token counts of whole texts without materialising token ids.

Method: the pieces of each distinct pre-token are counted once, joined to the
per-document pre-token frequencies, and summed. A bounded list of frequent
pre-tokens is counted up front and looked up in memory, so that they never
travel as join keys; every other pre-token goes through the join. Which
pre-tokens are on that list changes no result, only how many rows are joined.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm.texts import blocks, most_frequent, utf8
from docloom.sources.tables import materialize

VOCABULARY = "byte_bpe_50k.json"


class Splitter:
    """Pre-tokens of a text as the byte-level vocabulary's library cuts them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.words = regex.compile(public_tokenizers.PATTERN)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies, and the number of special strings (one token each)."""
        if self.special is None or not self.special.search(text):
            return Counter(self.words.findall(text)), 0
        parts, counts = self.special.split(text), Counter()
        for part in parts:
            counts.update(self.words.findall(part))
        return counts, len(parts) - 1

    def pieces(self, pretokens: list[str]) -> list[int]:
        """Piece counts, a thousand encodings in memory at a time."""
        return [len(e.ids) for at in range(0, len(pretokens), 1000) for e in self.tokenizer.encode_batch(pretokens[at:at + 1000], add_special_tokens=False)]


@cache
def _splitter(path: str) -> Splitter:
    """One vocabulary in memory for all tasks of a worker."""
    return Splitter(path)


def _sampled_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen = _splitter(path), Counter()
        for batch in batches:
            for part in blocks(batch, "utf8"):
                for text in part.column("utf8").to_pylist():
                    seen.update(splitter.frequencies(text.decode("utf-8", "replace"))[0].keys())
        yield pa.RecordBatch.from_pydict({"pretoken": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
    return run


def frequent_pretokens(docs: DataFrame, path: str, size: int, sample_rows: int) -> dict[str, int]:
    """At most ``size`` pre-tokens with their piece counts, from about ``sample_rows`` rows."""
    n = docs.count()
    sample = docs.select(utf8().alias("utf8"))
    if n > sample_rows:
        sample = sample.sample(sample_rows / n, seed=7)
    words = sample.mapInArrow(_sampled_words(path), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    top = sorted(r[0] for r in most_frequent(materialize(words, "words"), "pretoken", "n", size).collect())
    return dict(zip(top, Splitter(path).pieces(top), strict=True))


def _frequencies(path: str, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, known = _splitter(path), frequent.value
        for batch in batches:
            for part in blocks(batch, "utf8", 1 << 20):
                rows, base, words, counts = [], [], [], []
                for raw in part.column("utf8").to_pylist():
                    found, total = splitter.frequencies(raw.decode("utf-8", "replace"))
                    rare: list[str] = []
                    for word, k in found.items():
                        pieces = known.get(word)
                        if pieces is None:
                            rare.append(word)
                        else:
                            total += pieces * k
                    rows.append(uuid.uuid4().bytes)
                    base.append(total)
                    words.append(rare)
                    counts.append([found[w] for w in rare])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("n_bytes"), pa.array(rows, pa.binary()), pa.array(base, pa.int64()),
                    pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())),
                ], names=["doc_id", "n_bytes", "row", "base", "words", "counts"])
    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(path)
        for batch in batches:
            words = batch.column("pretoken").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("pretoken"), pa.array(splitter.pieces(words), pa.int64())], names=["pretoken", "pieces"])
    return run


def count_tokens(docs: DataFrame, path: str | None = None, *, frequent: int = 200_000, sample_rows: int = 5_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``.

    Only ``doc_id`` and ``text`` are read, so other columns may have any name.
    A null or empty text has 0 bytes and 0 tokens; a null or repeated doc_id
    keeps its rows apart (each row carries an id of its own); an empty table
    gives an empty result. Texts are never cut: a long text is one row of the
    frequency table, as large as its distinct rare pre-tokens.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(VOCABULARY)
    slim = docs.select("doc_id", "text")
    # Bounded by `frequent` entries.
    known = spark.sparkContext.broadcast(frequent_pretokens(slim, path, frequent, sample_rows))
    rows = slim.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("utf8"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    rows = materialize(rows.mapInArrow(
        _frequencies(path, known), "doc_id long, n_bytes long, row binary, base long, words array<string>, counts array<long>"), "pretokens")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("pretoken"), F.col("w.counts").alias("n"))
    pieces = rare.select("pretoken").distinct().mapInArrow(_pieces(path), "pretoken string, pieces long")
    sums = rare.join(pieces, "pretoken").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    return rows.select("doc_id", "n_bytes", "row", "base").join(sums, "row", "left").select(
        "doc_id", "n_bytes", (F.col("base") + F.coalesce("more", F.lit(0))).alias("n_tokens"))

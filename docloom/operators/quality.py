"""Constraints as data: every row gets the list of those it violates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Enumerations of the data model.
ELEMENT_TYPES = ("title", "heading", "paragraph", "list_item", "table", "caption", "code", "other")
STATUSES = ("completed", "partial", "rejected", "skipped")


def violations(**checks: Column) -> Column:
    """array<string>: names of the checks that do not hold; a check that is null does not hold."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(None)).otherwise(F.lit(n)) for n, c in checks.items()]), lambda v: v.isNotNull())


def both_or_neither(a: Column, b: Column) -> Column:
    return a.isNull() == b.isNull()


def element_checks() -> dict[str, Column]:
    start, end = F.col("char_start"), F.col("char_end")
    return dict(
        empty_text=F.length("text") >= 1, element_type=F.col("element_type").isin(*ELEMENT_TYPES), negative_order=F.col("order") >= 0,
        page_number=F.col("page_number").isNull() | (F.col("page_number") >= 1), half_span=both_or_neither(start, end), span_order=start.isNull() | end.isNull() | (end > start))


def element_violations() -> Column:
    return violations(**element_checks())


def order_violations(elements: Column) -> Column:
    """Violations of a document's elements (array of structs with ``order``): none at all, or orders that are not unique and rising."""
    rising = F.forall(F.sequence(F.lit(0), F.size(elements) - 2), lambda i: elements[i]["order"] < elements[i + 1]["order"])
    return violations(no_elements=F.size(elements) >= 1, order_not_rising=(F.size(elements) < 2) | rising)


def chunk_checks() -> dict[str, Column]:
    start, end = F.col("page_start"), F.col("page_end")
    other = [F.col(c).isNull() | (F.col(c) != F.col("chunk_id")) for c in ("parent_chunk_id", "previous_chunk_id", "next_chunk_id")]
    return dict(
        empty_content=F.length("content") >= 1, negative_index=F.col("chunk_index") >= 0, token_count=F.col("token_count") >= 1,
        half_pages=both_or_neither(start, end), page_order=start.isNull() | end.isNull() | (end >= start), self_link=other[0] & other[1] & other[2])


def chunk_violations() -> Column:
    return violations(**chunk_checks())


def outcome_checks() -> dict[str, Column]:
    rejected = F.col("status") == "rejected"
    return dict(
        status=F.col("status").isin(*STATUSES), missing_document=rejected | (F.col("document_id").isNotNull() & F.col("document_version").isNotNull()),
        rejected_chunks=~rejected | (F.col("chunk_count") == 0))


def outcome_violations() -> Column:
    return violations(**outcome_checks())


def observed(rows: DataFrame, checks: dict[str, Column], observation: Observation) -> DataFrame:
    """``rows`` with ``violations`` and ``quarantined``; ``observation`` counts rows, quarantined ones and each violation in the pass that reads them."""
    marked = rows.withColumn("violations", violations(**checks)).withColumn("quarantined", F.size("violations") > 0)
    counts = [F.count_if(F.array_contains("violations", name)).alias(name) for name in checks]
    return marked.observe(observation, F.count(F.lit(1)).alias("rows"), F.count_if("quarantined").alias("quarantined"), *counts)


def quarantine(rows: DataFrame, faults: Column) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rows with violations) of one table."""
    marked = rows.withColumn("violations", faults)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)

"""The answer stage: prompt messages, a pluggable provider, and public error statuses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public code and HTTP status per kind of failure; anything else is provider_error.
FAILURES = {"configuration": ("provider_configuration_error", 503), "timeout": ("provider_timeout", 504), "rate_limit": ("provider_rate_limited", 429)}
OTHER = ("provider_error", 502)

#: Answers one batch of prompts, in order.
Provider = Callable[[list[str]], list[str]]


def echo(prompts: list[str]) -> list[str]:
    return [f"echo: {p}" for p in prompts]


def messages(query: Column) -> Column:
    """One user message per query."""
    return F.array(F.struct(F.lit("user").alias("role"), query.alias("content")))


def error_code(failure: Column) -> Column:
    out = F.lit(OTHER[0])
    for kind, (code, _) in FAILURES.items():
        out = F.when(failure == kind, code).otherwise(out)
    return F.when(failure.isNotNull(), out)


def error_status(failure: Column) -> Column:
    """HTTP status of a failure, 200 without one."""
    out = F.lit(OTHER[1])
    for kind, (_, status) in FAILURES.items():
        out = F.when(failure == kind, status).otherwise(out)
    return F.coalesce(F.when(failure.isNotNull(), out), F.lit(200))


def _ask(provider: Provider, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(answer, failure) of each prompt: one call for all; if it fails they are asked one by one, so that a failure is the row's own."""
    try:
        got = provider(prompts)
        if len(got) == len(prompts):
            return [(g, None) if isinstance(g, str) else (None, "malformed") for g in got]
        failure = "malformed"
    except TimeoutError:
        failure = "timeout"
    except Exception as e:  # noqa: BLE001  reported by kind only
        failure = getattr(e, "kind", "other")
    return [(None, failure)] if len(prompts) == 1 else [x for p in prompts for x in _ask(provider, [p])]


def answer(queries: DataFrame, provider: Provider = echo, batch: int = 32) -> DataFrame:
    """(query, answer, sources, code, status) of rows (query[, prompt, sources]).

    ``prompt`` is what the provider is asked, the query itself without it;
    ``sources`` are carried to the answer, none without them and for rows that
    failed. A provider's failure is a row's code, not the job's end; empty
    queries are 422 and are not asked.
    """
    d = queries.select(
        "query", (F.col("prompt") if "prompt" in queries.columns else F.col("query")).alias("prompt"),
        (F.col("sources") if "sources" in queries.columns else F.array()).cast("array<string>").alias("sources"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = b.index[b["query"].fillna("") != ""]
            out = pd.DataFrame({"query": b["query"], "sources": b["sources"], "answer": None, "failure": None}, dtype=object)
            for at in range(0, len(asked), batch):
                part = asked[at:at + batch]
                for i, (said, failure) in zip(part, _ask(provider, b["prompt"][part].tolist())):
                    out.at[i, "answer"], out.at[i, "failure"] = said, failure
            yield out

    d = d.mapInPandas(run, "query string, sources array<string>, answer string, failure string")
    blank = F.coalesce(F.length("query"), F.lit(0)) == 0
    return d.select("query", "answer", F.when(F.col("answer").isNotNull(), F.col("sources")).otherwise(F.array().cast("array<string>")).alias("sources"),
                    error_code(F.col("failure")).alias("code"), F.when(blank, 422).otherwise(error_status(F.col("failure"))).alias("status"))

"""From the text of queries to answers with sources: embed, search, assemble a context, ask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import answers, retrieval
from docloom.operators.context import assemble_context
from docloom.operators.maxmin import Embed, hashed_embeddings
from docloom.sources.tables import materialize


def contexts(queries: DataFrame, chunks: DataFrame, config: retrieval.RetrievalConfig = retrieval.RetrievalConfig(), embed: Embed = hashed_embeddings,
             max_tokens: int = 6000, max_chunks: int = 6) -> DataFrame:
    """(query_id, query, context, sources, excluded, token_count) of queries (query_id, query) over chunks (see maxmin.render_chunks).

    The context is the contents of the chunks that fit the budget, best first,
    a blank line apart; sources are their ids. A query that finds nothing has an
    empty context.
    """
    stored = retrieval.embed_texts(chunks.select("chunk_id", "document_id", "content", "embedding_text", "token_count"), "embedding_text", embed).drop("embedding_text")
    stored = materialize(stored.withColumn("vec_id", F.monotonically_increasing_id()), "stored")
    # queries have negative ids, so that none is taken for a chunk
    asked = materialize(retrieval.embed_texts(queries.select("query_id", "query"), "query", embed).withColumn("vec_id", -1 - F.monotonically_increasing_id()), "asked")
    owner = "document_id" if config.max_per_document is not None else None
    # hits are few: written by themselves, their size is known and the contents of all chunks need not be shuffled to them
    hits = materialize(retrieval.search(stored, asked, config, owner), "found").join(stored.select("vec_id", "chunk_id", "content", "token_count"), "vec_id")
    hits = materialize(hits, "hits")
    fit = assemble_context(hits, "query_id", "rank", "token_count", "chunk_id", max_tokens, max_chunks).withColumnRenamed("query_id", "vec_id")
    texts = hits.groupBy(F.col("query_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "content"))).alias("texts"))  # top_k of one query
    none = F.array().cast("array<string>")
    d = asked.join(fit, "vec_id", "left").join(texts, "vec_id", "left").withColumn("sources", F.coalesce("included", none))
    return d.select("query_id", "query", F.array_join(F.transform("sources", lambda c: F.element_at("texts", c)), "\n\n").alias("context"), "sources",
                    F.coalesce("excluded", none).alias("excluded"), F.coalesce("token_count", F.lit(0).cast("long")).alias("token_count"))


def answer_queries(queries: DataFrame, chunks: DataFrame, provider: answers.Provider = answers.echo, config: retrieval.RetrievalConfig = retrieval.RetrievalConfig(),
                   embed: Embed = hashed_embeddings, max_tokens: int = 6000, max_chunks: int = 6) -> DataFrame:
    """(query, answer, sources, code, status): the provider is asked the context and the query (see answers.answer)."""
    found = contexts(queries, chunks, config, embed, max_tokens, max_chunks)
    return answers.answer(found.withColumn("prompt", F.concat_ws("\n\n", F.nullif("context", F.lit("")), "query")), provider)

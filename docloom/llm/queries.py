"""The operators applied to whole tables: (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, hard_negatives, hmm, html_text, mixing, quality, secrets, sharding, simhash, token_counts, topk, toxicity, whitening
from docloom.llm.texts import fold
from docloom.sources.tables import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read_table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.toxicity(docs, model), 0.5)


def _scored(docs: DataFrame, score: Column, least: float) -> DataFrame:
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.interleave(read_table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return _scored(docs, quality.quality(docs, model), 0.3)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"), secrets.spans_text(F.col("secrets")).alias("spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", moved.alias("label")))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_hmm": op6_hmm,
    "op7_quality": op7_quality,
    "op8_topk": op8_topk,
    "op9_simhash": op9_simhash,
    "op10_secrets": op10_secrets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_html_text": op12_html_text,
    "op13_whitening": op13_whitening,
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _found(pattern: str) -> str:
    """A list of {s, e, v} of all matches of ``pattern`` in t, cut at marks put around them."""
    parts = f"string_split(regexp_replace(t, {_text(pattern)}, chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    return f"""list_transform([{parts}], lambda p: list_transform(range(2, len(p) + 1, 2), lambda i: {{
        's': list_sum(list_transform(p[1:i - 1], lambda x: length(x)))::BIGINT, 'e': list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT, 'v': p[i]}}))[1]"""


def _secrets_sql() -> str:
    """Every window is counted afresh here, which the scaled integer sums make the same."""
    terms = f"[{', '.join(map(str, secrets._terms()))}]"
    window = f"substr(v, i + 1, {secrets.WINDOW})"
    total = f"list_sum(list_transform(list_distinct(string_split({window}, '')), lambda ch: {terms}[length({window}) - length(replace({window}, ch, '')) + 1]))"
    most = " ".join(f"WHEN regexp_full_match({window}, '{p}') THEN {secrets._most(b)}" for p, b in (
        ("[^A-Za-z]*", secrets.NO_LETTER), ("[^0-9]*", secrets.NO_DIGIT), ("[0-9A-Fa-f]*", secrets.HEXADECIMAL), ("[0-9A-Za-z]*", secrets.ALPHANUMERIC)))
    filler = f"repeat('{secrets.ALLOWED}', length(p))"
    cut = f"string_split(regexp_replace(m.v, {_text(secrets.UUID)}, chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    joined = f"array_to_string(list_transform({cut}, lambda p, i: CASE WHEN i % 2 = 0 THEN {filler} ELSE p END), '')"
    masked = f"array_to_string(list_transform(regexp_extract_all({joined}, {_text(secrets.PIECES)}), lambda p: CASE WHEN regexp_matches(p, {_text(secrets.ALLOW)}) THEN {filler} ELSE p END), '')"
    kinds = "['assign', 'access', 'hex', 'entropy']"
    span = lambda l: f"array_to_string(list_transform(list_sort({l}), lambda x: {kinds}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    base = lambda k: f"list_transform(l{k}, lambda m: {{'s': m.s, 'k': {k}, 'e': m.e}})"
    return f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS nth, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
        f AS (
            SELECT doc_id, nth, list_filter({_found(secrets.ASSIGN)}, lambda m: length(regexp_extract(m.v, {_text(secrets.ASSIGN)}, 2)) >= 8) AS l0,
                {_found(secrets.ACCESS)} AS l1, {_found(secrets.HEX)} AS l2, {_found(secrets.CANDIDATE)} AS c FROM d
        ), v AS (
            SELECT nth, s, {masked} AS v FROM (SELECT nth, m, m.s AS s FROM (SELECT nth, unnest(c) AS m FROM f))
        ), i AS (
            SELECT nth, s, v, unnest(range(0, length(v) - {secrets.WINDOW - 1})) AS i FROM v
        ), w AS (
            SELECT nth, s, min(i) AS low, max(i) AS high FROM i WHERE NOT contains({window}, '{secrets.ALLOWED}') AND {total} <= CASE {most} ELSE {secrets._most(secrets.ANY)} END GROUP BY nth, s
        ), h AS (
            SELECT nth, list({{'s': s + low, 'k': 3, 'e': s + high + {secrets.WINDOW}}}) AS added FROM w GROUP BY nth
        ), s AS (
            SELECT doc_id, l0, l1, l2, {base(0)} || {base(1)} || {base(2)} AS fixed, coalesce(added, []) AS added FROM f LEFT JOIN h USING (nth)
        )
        SELECT doc_id, len(l0) AS n_assign, len(l1) AS n_access, len(l2) AS n_hex, sha256({span("fixed")}) AS base_sha256, {span("fixed || added")} AS spans FROM s
    """


#: DuckDB SQL with the same rows as the query of that name.
ORACLES: dict[str, str] = {
    "op5_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
        ), w AS (
            SELECT *, [5, 2, 1][(place % 3 + 1)::INTEGER]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS cap,
                (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM s
        ), r AS (
            SELECT *, budget - coalesce(sum(cap) OVER f, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS sharing FROM w
            WINDOW f AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (
            SELECT *, min(CASE WHEN rest * weight / sharing < cap THEN {'ratio': cap / weight, 'place': place, 'rest': rest, 'sharing': sharing} END) OVER () AS level FROM r
        ), t AS (
            SELECT source, source_size, place, budget, CASE WHEN level IS NULL THEN cap ELSE least(cap, level.rest * weight / level.sharing) END AS target FROM l
        ), q AS (
            SELECT d.doc_id, d.size, t.source_size, t.place, t.target, t.budget,
                row_number() OVER (ORDER BY t.place, md5('23:' || coalesce(d.doc_id::VARCHAR, '-') || ':' || d.size), d.doc_id, d.size) AS pos,
                sum(d.size) OVER (PARTITION BY t.place ORDER BY md5('23:' || coalesce(d.doc_id::VARCHAR, '-') || ':' || d.size), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS inside
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), e AS (
            SELECT q.*, pass, (pass * source_size + inside)::DOUBLE / target AS finish FROM q CROSS JOIN (VALUES (0), (1)) AS p(pass) WHERE size > 0
        ), m AS (
            SELECT pos, size, floor(budget)::BIGINT AS budget, coalesce(sum(size) OVER (ORDER BY finish, place, pass, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e
        ), k AS (
            SELECT pos, sum(greatest(0, least(size, budget - before)))::BIGINT AS taken FROM m GROUP BY pos
        )
        SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON q.pos = k.pos
    """,
    "op8_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT q.nth AS query_nth, q.vec_id AS query_id, c.nth, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v AS q JOIN v AS c ON q.nth <> c.nth AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_nth ORDER BY score DESC, vec_id, nth) AS rank FROM p) WHERE rank <= 5
    """,
    "op10_secrets": _secrets_sql(),
    "op11_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS nth, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.nth AS anchor, a.vec_id AS anchor_id, c.nth, c.vec_id, a.label = c.label AS alike, list_inner_product(a.v, c.v)::BIGINT AS score
            FROM v AS a JOIN v AS c ON a.nth <> c.nth AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, nth) AS place FROM s WHERE alike) WHERE place <= 5
        ), n AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST, s.nth) AS rank
            FROM p JOIN s ON p.anchor = s.anchor AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        )
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
}

"""Queries over vectors of texts, with their SQL: nearest rows, contexts of alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrel.operators import reports, retrieval, text_vectors
from sentrel.plans.catalog import query
from sentrel.plans.oracle import PROMPT, SQL, _with
from sentrel.sources import adapters as ad
from sentrel.sources.readers import table

DIMS = 512


def _shown(digits: int):
    """Rounded, without a negative zero."""
    return (F.round("distance", digits) + F.lit(0.0)).alias("distance")


def _knowledge(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


@query
def text_vectors_of_corpus(spark, d):
    """The corpus as (id, bucket, value) of all buckets that are not zero."""
    c = _knowledge(spark, d)
    v = text_vectors.vectors(c, text_vectors.fit(c, dims=DIMS))
    return v.select("id", F.posexplode("vector").alias("bucket", "value")).filter("value <> 0")


@query
def alert_contexts(spark, d):
    """The two nearest corpus texts of each alert's question."""
    out = retrieval.alert_contexts(ad.alerts(spark, d), _knowledge(spark, d), dims=DIMS)
    return out.select("transaction_id", "question", "rank", "id", _shown(6))


@query
def sar_prompt_with_context(spark, d):
    al = ad.timed_alerts(spark, d)
    return reports.sar_prompt(al, contexts=retrieval.alert_contexts(al, _knowledge(spark, d), dims=DIMS))


@query
def embedding_neighbours(spark, d):
    """For every id divisible by 50 the nearest of all vectors, its own left out."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = retrieval.topk_join(q, e, 6, "query_id", "vec_id", "embedding")
    return out.filter("query_id <> vec_id").select("query_id", "vec_id", _shown(4))


@query
def document_neighbours(spark, d):
    """For every text of the benchmark the nearest of all documents."""
    docs, asked = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    w = text_vectors.fit(docs, dims=DIMS)
    out = retrieval.topk_join(text_vectors.vectors(asked, w), text_vectors.vectors(docs, w), 3, "query_id", "doc_id", sizes=(asked.count(), docs.count()))
    return out.select("query_id", "rank", "doc_id", _shown(6))


def _vectors(name: str, source: str) -> str:
    """CTEs <name>_v (id, bucket, value) and <name>_n (id, norm); weights of corpus_w."""
    return f"""{name}_v AS (SELECT g.id, g.bucket, g.n * w.weight AS value FROM ({_counts(source)}) g JOIN corpus_w w USING (bucket)),
{name}_n AS (SELECT id, sqrt(CAST(sum(value * value) AS DOUBLE)) AS norm FROM {name}_v GROUP BY id)"""


def _counts(source: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"SELECT id, unnest(regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM {source}"
    grams = f"SELECT id, word AS gram FROM ({words}) UNION ALL SELECT id, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3))) FROM ({words})"
    return f"SELECT id, CAST('0x' || substr(md5(gram), 1, 6) AS INT) % {DIMS} AS bucket, count(*) AS n FROM ({grams}) GROUP BY ALL"


def _weights(source: str) -> str:
    return f"""corpus_w AS (SELECT b.bucket, 1 + CAST(floor(16 * ln(((SELECT count(*) FROM {source}) + 1)::DOUBLE / (count(c.id) + 1)) + 0.5) AS BIGINT) AS weight
    FROM (SELECT unnest(range({DIMS})) AS bucket) b LEFT JOIN ({_counts(source)}) c USING (bucket) GROUP BY b.bucket)"""


def _nearest(queries: str, k: int) -> str:
    """top(query, rank, id, d)."""
    return f"""top AS (SELECT query, id, d, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM (
    SELECT q.id AS query, c.id, 1 - CAST(sum(q.value * c.value) AS DOUBLE) / (any_value(qn.norm) * any_value(cn.norm)) AS d
    FROM (SELECT id, bucket, value FROM {queries}_v UNION ALL SELECT id, -1, 0 FROM {queries}_n) q JOIN (SELECT id, bucket, value FROM corpus_v UNION ALL SELECT id, -1, 0 FROM corpus_n) c USING (bucket)
    JOIN {queries}_n qn ON qn.id = q.id JOIN corpus_n cn ON cn.id = c.id GROUP BY q.id, c.id) QUALIFY rank <= {k})"""


CORPUS = "corpus AS (SELECT item_id AS id, text FROM benchmark)"
ASKED = "asked AS (SELECT *, 'rules for ' || coalesce(payment_method, 'unknown') || ' in ' || coalesce(governorate, 'unknown') AS question FROM alerts), questions AS (SELECT DISTINCT question AS id, question AS text FROM asked)"
LOOKUP = f"{CORPUS}, {_weights('corpus')}, {ASKED}, {_vectors('questions', 'questions')}, {_vectors('corpus', 'corpus')}, {_nearest('questions', 2)}"

SQL["text_vectors_of_corpus"] = f"WITH {CORPUS}, {_weights('corpus')}, {_vectors('corpus', 'corpus')} SELECT id, CAST(bucket AS INT) AS bucket, CAST(value AS INT) AS value FROM corpus_v"
SQL["alert_contexts"] = _with("", "alerts").rstrip() + f", {LOOKUP} SELECT transaction_id, question, CAST(rank AS INT) AS rank, top.id, round(d, 6) + 0.0::DOUBLE AS distance FROM asked JOIN top ON top.query = question"
SQL["sar_prompt_with_context"] = _with("", "alerts").rstrip() + f""", {LOOKUP} SELECT transaction_id, {PROMPT.format(context="' || coalesce(c.text, 'No specific regulatory context found.') || '")} AS prompt
FROM asked LEFT JOIN top ON top.query = question AND rank = 1 LEFT JOIN corpus c ON c.id = top.id"""
SQL["embedding_neighbours"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT query_id, vec_id, round(d, 4) + 0.0::DOUBLE AS distance FROM (SELECT q.vec_id AS query_id, c.vec_id, 1 - list_dot_product(q.v, c.v) / (q.n * c.n) AS d FROM e q JOIN e c ON q.vec_id % 50 = 0 WHERE q.n * c.n > 0
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY d, c.vec_id) <= 6) WHERE query_id <> vec_id"""
SQL["document_neighbours"] = f"""WITH corpus AS (SELECT doc_id AS id, text FROM documents), asked AS (SELECT item_id AS id, text FROM benchmark), {_weights('corpus')}, {_vectors('corpus', 'corpus')}, {_vectors('asked', 'asked')}, {_nearest('asked', 3)}
SELECT query AS query_id, CAST(rank AS INT) AS rank, id AS doc_id, round(d, 6) + 0.0::DOUBLE AS distance FROM top"""

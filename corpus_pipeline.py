"""Five stages from raw documents to a mix; each is written before the next reads it.

STAGES: (name, function(spark, docs, sf_dir) -> DataFrame). All but the last return
the columns of ``docs``; ``n_chars``, where present, follows the text. Rows without an
id, or with an id that others have, are documents of their own in every stage; extra
columns stay as they are, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrel.llm import automaton_dedup, decontaminate, graph, jaccard_join, mixing, quality_rules

#: Words of a passage that counts as repeated, shingle words and least similarity of
#: near copies, and the seed of the mix.
PASSAGE_WORDS = 50
SHINGLE_WORDS = 5
SIMILARITY = (80, 100)
SEED = 13
#: What the last stage adds; input columns of these names get the suffix ``_in``.
ADDED = ["size", "source_size", "target", "taken"]


def _restored(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from operator output with the others in ``_x``."""
    def column(c: str):
        if c == "doc_id":
            return F.col("doc_id").cast(docs.schema[c].dataType)
        if c == "text":
            return F.col(text).alias(c)
        if c == "n_chars":
            return F.length(text).cast(docs.schema[c].dataType).alias(c)
        return F.col("_x")[c].alias(c)

    return df.select(*[column(c) for c in docs.columns])


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others the lines that pass stay."""
    return _restored(quality_rules.apply_rules(docs, carry=True).filter("kept"), docs, "cleaned")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row with the least id stays, also where ids
    are NULL or repeated."""
    return jaccard_join.drop_near_copies(docs, SHINGLE_WORDS, *SIMILARITY)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS or more stay only in documents with the least id;
    documents of which no word is left go. Rows with equal ids, or without one, do
    not cut each other's passages."""
    out = automaton_dedup.dedup_passages(docs, PASSAGE_WORDS, carry=True, layout=True)
    return _restored(out.filter("n_symbols > n_removed"), docs, "kept")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with how many of their words the mix takes. Equal rows take
    equally many."""
    m = mixing.mix(docs, seed=SEED).groupBy("source", "row_hash").agg(*[F.max(c).alias(c) for c in ADDED])
    names = graph.free_names(ADDED, docs.columns)
    d = docs.select(F.struct(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns]).alias("x"), F.col("source").cast("string").alias("s"), mixing.row_hash(F.col("doc_id"), F.col("text"), SEED).alias("h"))
    j = d.alias("d").join(m.alias("m"), (F.col("d.h") == F.col("m.row_hash")) & F.col("d.s").eqNullSafe(F.col("m.source")))
    return j.select("x.*", *[f"m.{c}" for c in ADDED])


STAGES = [("quality_rules", clean_lines), ("ngram_jaccard_join", drop_near_copies), ("substring_dedup", cut_passages), ("decontamination", drop_leaks), ("mix_sources", mix_sources)]

#: Near copies in groups and edited benchmark passages are not expressed in SQL; see
#: tests/llm for brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; stages are written as Parquet below
    spark.checkpoint.dir (which a cluster must set). A stage's input is removed once
    the stage is written; the last one's output is what the result reads."""
    folder = f"{graph.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

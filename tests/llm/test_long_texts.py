"""One text of some megabytes and its copy beside short ones, through every operator on documents."""

import math
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from sentrel.llm import automaton_dedup, decontaminate, importance, jaccard_join, language_id, licenses, lm_score, mixing, quality_rules, suffix_dedup

WORDS = 400_000
PHRASE = "This work is licensed under the GNU General Public License, version 3."


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeéfghilmnorstu") for _ in range(r.randint(2, 9)))
    lines = [" ".join(word() for _ in range(r.randint(8, 20))) + "." for _ in range(WORDS // 14)]
    long = "\n".join([*lines, PHRASE])
    rows = [(1, long, "en", "a"), (2, long, "en", "a")] + [(i, " ".join(word() for _ in range(60)) + ".", "en" if i % 2 else "de", "b") for i in range(3, 40)] + [(90, "", "de", "b"), (91, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).cache()
    yield df, long
    df.unpersist()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_rules_and_scans(docs):
    df, long = docs
    n = len(long.split())
    q = by_id(quality_rules.apply_rules(df.select("doc_id", "text"), with_text=False))
    assert q[1].n_words == n > 300_000 and q[1].kept and not q[91].kept and q[1].word_chars == sum(map(len, long.split()))
    s = by_id(licenses.scan_licenses(df.select("doc_id", "text")))
    assert s[1].labels == "gpl,gpl-3.0" and s[1].n_base == 1 and s[1].first_word > 300_000 and s[3].labels == ""


def test_copies(docs):
    df, long = docs
    g = by_id(jaccard_join.similar_groups(df.select("doc_id", "text")))
    assert g[1].component_id == g[2].component_id == 1 and g[1].n_shingles == g[2].n_shingles > 300_000 and g[3].component_id == 3
    p = by_id(automaton_dedup.dedup_passages(df.select("doc_id", "text")))
    assert p[1].n_removed == 0 and p[2].n_removed == p[2].n_symbols == len(long.split()) and p[2].kept == ""
    b = by_id(suffix_dedup.dedup_substrings(df.select("doc_id", "text")))
    assert b[1].n_removed == b[2].n_removed == len(long.encode()) and b[1].n_spans == 1 and b[3].n_removed == 0


def test_learnt(spark, docs):
    df, long = docs
    m = by_id(mixing.mix(df))
    assert m[1].size == len(long.split()) and m[91].size == 0
    lang = by_id(language_id.identify(df.select("doc_id", "text", "lang")))
    assert lang[1].lang_pred in ("en", "de") and lang[91].lang_pred == "und" and 0 <= lang[1].score <= 1
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    assert importance.resample(df.select("doc_id", "text"), labels).count() == df.count()
    scores = by_id(lm_score.score_texts(df.select("doc_id", "text"), start_steps=3))
    assert scores[1].n_tokens == len(long.split()) + 1 and math.isclose(scores[1].score, scores[2].score, rel_tol=1e-6) and scores[1].score < -100_000


def test_leaks(spark, docs):
    df, long = docs
    bench = spark.createDataFrame([(7, long[2_000_000:2_000_300])], "item_id long, text string")
    assert sorted({r.doc_id for r in decontaminate.find_leaks(df.select("doc_id", "text"), bench).collect()}) == [1, 2]


def test_stages(spark, docs, tmp_path):
    df, _ = docs
    df.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "a question that no text holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1 in ids and 2 not in ids and {3, 4, 5} <= ids

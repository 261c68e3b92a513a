import corpus_pipeline as cp
from sentrel.llm import automaton_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    line = lambda i: f"Clean line {i} of a text, with word{i} and more{i} of it{i}. "
    good = "\n".join(line(i) for i in range(12))
    passage = " ".join(f"p{i}." for i in range(60))
    rows = [
        (9001, good, "en", "s1", 1), (9002, good, "en", "s1", 1), (9003, good + "\nOne more line, at its end.", "en", None, 1), (9004, "A | b | c\n" * 30, "en", "s1", 1),
        (9005, "\n".join(line(i + 100) for i in range(9)) + "\n" + passage, "en", "s2", 1), (9006, "\n".join(line(i + 200) for i in range(9)) + "\n" + passage, "de", "s2", 1),
        (9007, "\n".join(line(i + 300) for i in range(9)) + "\n" + bench[0], "en", "s2", 1), (9008, None, None, None, None), (9009, "", "en", "s1", 0), (None, "\n".join(line(i + 400) for i in range(9)), "en", "s3", 1),
    ]
    src = tmp_path / "in"
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(str(src / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(src / "benchmark.parquet"))
    kept, now = {}, spark.read.parquet(str(src / "documents.parquet"))
    for i, (name, f) in enumerate(cp.STAGES):
        f(spark, now, str(src)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in now.collect()}
        if i < 4:
            assert now.columns == docs.columns and now.schema == docs.schema
    assert 9004 not in kept["quality_rules"] and 9008 not in kept["quality_rules"] and None in kept["mix_sources"]
    assert 9001 in kept["ngram_jaccard_join"] and not {9002, 9003} & set(kept["ngram_jaccard_join"])
    assert "p59." in kept["substring_dedup"][9005] and "p3." not in kept["substring_dedup"][9006] and "word205" in kept["substring_dedup"][9006]
    assert kept["substring_dedup"][9001] == kept["ngram_jaccard_join"][9001]
    assert 9007 in kept["substring_dedup"] and 9007 not in kept["decontamination"] and {9001, 9005, 9006} <= set(kept["decontamination"])
    final = now.collect()
    assert all(0 <= r.taken <= 2 * r.size for r in final) and len(final) == len(kept["decontamination"])
    assert sorted(map(str, cp.run(spark, str(src)).select("doc_id", "taken").collect())) == sorted(map(str, now.select("doc_id", "taken").collect()))


def test_layout_is_kept(spark):
    p = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"a\n{p}\n b  c"), (2, f" x\ty\n\n{p} \n z"), (3, p), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in automaton_dedup.dedup_passages(df, layout=True).collect()}
    assert got == {1: f"a\n{p}\n b  c", 2: " x\ty\n\nz", 3: "", 4: ""}

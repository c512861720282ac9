import corpus_pipeline


def test_stages_keep_clean_documents_and_columns(spark, sf_tiny):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").limit(60)
    prose = " ".join(f"clean{i} words{i * 7 % 31}" for i in range(40))
    near = prose.replace("clean20", "other")
    item = spark.read.parquet(f"{sf_tiny}/benchmark.parquet").first().text
    extra = [(9000, prose), (9001, near), (9002, prose), (9002, prose), (9003, f"{' '.join(f'z{i}' for i in range(30))} {item}"), (9004, None), (None, " ".join(f"n{i}" for i in range(30)))]
    more = spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_tiny), name)
        left[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert {9000, 9001, 9002, 9003, None} <= set(left["quality_rules"]) and 9004 not in left["quality_rules"]
    assert len(left["line_dedup"]) == len(left["quality_rules"])
    assert 9000 in left["ngram_jaccard_join"] and not {9001, 9002} & set(left["ngram_jaccard_join"])
    assert 9003 not in left["benchmark_decontamination"] and None in left["benchmark_decontamination"]
    assert set(left["mixing"]) <= set(left["benchmark_decontamination"])


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, bitmap binary, rep string, keeper long, topic string, n_words int, _h long, places int"


def test_clashing_columns_empty_tables_and_long_texts(spark, sf_tiny):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(i, t, "en", s, None, b"x", "r", 1, "t", 2, 3, 4) for i, t, s in [(1, long, "a"), (2, long + " end", None), (None, None, None), (3, "", "a"), (4, "\\n".join(["one line that is shared by all"] * 3), "b")]]
    for data in (rows, []):
        docs = spark.createDataFrame(data, CLASHING)
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.materialize(stage(spark, docs, sf_tiny), name)
            if name != "mixing":
                assert out.columns == docs.columns
                docs = out
        assert [r.doc_id for r in docs.collect()] == ([1] if data else [])


def test_of_rows_that_share_an_id_each_class_keeps_one(spark, sf_tiny):
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(50))
    rows = [(1, text("a"), 0), (1, text("b"), 1), (2, text("b") + " x", 2), (3, text("a") + " y", 3), (3, text("a") + " y", 4), (5, text("c"), 5), (5, text("c"), 6)]
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, spark.createDataFrame(rows, "doc_id long, text string, n int"), sf_tiny).collect()
    assert sorted((r.doc_id, r.text[0]) for r in out) == [(1, "a"), (1, "b"), (5, "c")]

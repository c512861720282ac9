"""Operators on literal rows: expected values are worked out by hand."""

import pytest
from marginalia.functions import text, tokens
from marginalia.operators import classify, glossary, layout, matching, memory, selection, spatial, tables
from marginalia.sources import files
from marginalia.streaming import jobs
from pyspark.sql import functions as F

SPANS = [("FRONT POCKET ", 61.62, 318.21, 116.15, 325.21), ("OPENING WIDTH", 61.62, 326.20, 117.12, 333.20)]
WRAPPED = (61.62, 318.21, 117.12, 333.20)
NODE = ("FRONT POCKET OPENING WIDTH", 60.0, 317.0, 133.0, 334.0)
BAG = [
    ("FRONT POCKET BAG ", 61.62, 336.14, 132.26, 343.14), ("LENGTH", 61.62, 344.13, 88.92, 351.13),
    ("FRONT POCKET BAG ", 61.62, 354.14, 132.27, 361.14), ("WIDTH", 61.62, 362.13, 84.43, 369.13),
]


def frame(spark, cases):
    rows = [(page, i, *row) for page, listed in cases.items() for i, row in enumerate(listed)]
    return spark.createDataFrame(rows, "page string, idx int, text string, x0 double, y0 double, x1 double, y1 double")


def test_match_nodes(spark):
    spans = {
        "multiline": SPANS,
        "rows": SPANS + BAG,
        "distant": [("FRONT POCKET OPENING WIDTH", 61.62, 50.0, 150.0, 57.0), *SPANS],
        "interleaved": [SPANS[0], ("XS", 120.0, 318.21, 130.0, 325.21), SPANS[1]],
        "context": [
            ("BEFORE", 5.0, 5.0, 25.0, 12.0), ("FRONT POCKET", 5.0, 15.0, 25.0, 25.0), ("AFTER", 5.0, 28.0, 25.0, 35.0),
            ("FRONT", 65.0, 15.0, 74.0, 25.0), ("POCKET", 75.0, 15.0, 85.0, 25.0),
        ],
    }
    nodes = {c: [NODE] for c in ("multiline", "distant", "interleaved")} | {
        "rows": [("FRONT POCKET OPENING WIDTH", 60.0, 317.0, 134.0, 334.0), ("FRONT POCKET BAG LENGTH", 60.0, 335.0, 134.0, 352.0), ("FRONT POCKET BAG WIDTH", 60.0, 353.0, 134.0, 370.0)],
        "context": [("BEFORE", 35.0, 5.0, 55.0, 12.0), ("FRONT POCKET", 35.0, 15.0, 55.0, 25.0), ("AFTER", 35.0, 28.0, 55.0, 35.0)],
    }
    diagonal = {c: 1031.1 for c in spans} | {"context": 141.4}
    out = matching.match_nodes(frame(spark, nodes), frame(spark, spans), spark.createDataFrame(list(diagonal.items()), "page string, diagonal double")).collect()
    got = {(r.page, r.idx): (r.confidence, (r.x0, r.y0, r.x1, r.y1)) for r in out}
    for case in ("multiline", "distant", "interleaved"):
        assert got[(case, 0)] == ("high", WRAPPED)
    assert got[("rows", 0)] == ("high", WRAPPED)
    assert got[("rows", 1)] == ("high", (61.62, 336.14, 132.26, 351.13))
    assert got[("rows", 2)] == ("high", (61.62, 354.14, 132.27, 369.13))
    assert got[("context", 1)] == ("high", (5.0, 15.0, 25.0, 25.0))


def test_text_functions(spark):
    rows = spark.createDataFrame([("  Straße–A  B ", "abcd", "axcd", "a|b\n<br>& \r")], "t string, a string, b string, c string")
    r = rows.select(
        text.normalize_term(F.col("t")), text.normalize_term(F.concat(F.lit("ﬁ Ａ "), F.col("t"))), text.similarity(F.col("a"), F.col("b")),
        text.unescape_cell(text.escape_cell(F.col("c"))) == F.col("c"), text.similarity(F.lit(""), F.lit("")),
    ).first()
    assert tuple(r) == ("strasse-a b", "fi a strasse-a b", 0.75, True, 1.0)


def locked(spark, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.lock_tokens(F.col("t")).alias("l")).collect()
    return [[(x.kind, x.value) for x in r.l] for r in rows]


def test_tokens(spark):
    assert locked(spark, "Style No: SK12 12.5 cm 30% ±0.5 é12 19-4005 TCX 2024-01-05 xSTYLE AB1", None) == [
        [
            ("style_code", "SK12"), ("number", "12.5"), ("unit", "cm"), ("percentage", "30%"), ("tolerance", "±0.5"),
            ("color_code", "19-4005 TCX"), ("date", "2024-01-05"), ("generic_code", "AB1"),
        ],
        [],
    ]


def test_token_boundaries(spark):
    # é and a letter with a mark go on; an escaped underscore does not; a mark after a token spoils it.
    assert locked(spark, "e\u030112", "a\\_12", "a_12", "12\u0301 7", "STYLE AB1é 5", "DESIGNER: John Smith 3") == [
        [], [("number", "12")], [], [("number", "7")], [("number", "5")], [("person", "John Smith"), ("number", "3")],
    ]


def test_translations_keep_tokens_by_value(spark):
    cases = [
        ("DESIGNER: John Smith, 5 cm", "设计师: John Smith, 5 cm", True),
        ("DESIGNER: John Smith", "设计师: John Smyth", False),
        ("Style No: SK12 5 cm", "款号 SK12 cm 5", False),
        ("5 cm", "5 cm 6", False),
        ("Material: AB-9X 9", "面料 AB-9X 9", True),
        ("no tokens", "nichts", True),
    ]
    rows = spark.createDataFrame(cases, "s string, t string, want boolean")
    got = rows.select("s", tokens.same_tokens(tokens.lock_tokens(F.col("s")), F.col("t")).alias("got"), "want").collect()
    assert [r for r in got if r.got != r.want] == []


def test_union_area(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0), (1, 5.0, 5.0, 15.0, 15.0), (1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 1.0, 1.0), (2, 3.0, 0.0, 4.0, 2.0), (3, 1.0, 1.0, 1.0, 5.0)]
    out = spatial.union_area(spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double"), "page").collect()
    assert sorted(map(tuple, out)) == [(1, 175.0), (2, 3.0)]


def test_place_cells(spark):
    rows = [(1, 0, 0, "a", 2, 1), (1, 0, 1, "b", 1, 2), (1, 1, 0, "c", 1, 2), (1, 1, 1, "d", 1, 1), (1, 2, 0, "e", 2, 1)]
    out = tables.place_cells(spark.createDataFrame(rows, "table_id int, row int, ord int, text string, colspan int, rowspan int")).collect()
    assert {r.text: r.column for r in out} == {"a": 0, "b": 2, "c": 0, "d": 1, "e": 1}


def test_duplicates_follow_selection(spark):
    rows = [(0, 0, "Sew here", "header"), (0, 1, "Sew here", "body"), (0, 2, "Sew here", "body"), (1, 0, "Sew here", "body")]
    nodes = spark.createDataFrame([(p, i, "bom", 0.95, r, t, "high") for p, i, t, r in rows], "page_id long, pos int, page_type string, confidence double, role string, text string, coordinate_confidence string")
    terms = spark.createDataFrame([], "source_term string, target_term string, norm string, priority int, do_not_translate boolean")
    out = {r.item_id: r.reason for r in selection.select_candidates(nodes, terms).collect()}
    assert out == {"p001-i001": "skipped_admin", "p001-i002": "page_rule", "p001-i003": "skipped_duplicate", "p002-i001": "page_rule"}


def test_classify_conflict_and_agent(spark):
    schema = "page int, title string, headers array<string>, features array<string>, agent struct<page_type:string,confidence:double,evidence:array<string>>"
    rows = [
        (1, "BOM / Size chart", [], [], None), (2, "BOM / Size chart", [], [], ("label_pack", 0.9, ["x"])), (3, "bombast", ["POM", "tolerance", "description"], [], None),
        (4, None, None, None, ("bom", 0.7, ["x"])),
    ]
    out = {r.page: (r.page_type, r.confidence, r.stage) for r in classify.classify_pages(spark.createDataFrame(rows, schema)).collect()}
    assert out == {1: ("unknown", 0.0, "conflict"), 2: ("label_pack", 0.9, "agent"), 3: ("measurement", 0.95, "table"), 4: ("unknown", 0.7, "pending")}


def test_memory_round_trip_and_recall(spark, tmp_path):
    schema = "source_text string, corrected string, page_type string, context string, seq long"
    odd = "a|b\n<br> &   \x0b\x0c"
    store = spark.createDataFrame([(odd, "one", "bom", "c", 1), ("x", "two", "bom", "c", 2), (" x ", "three", "bom", "c", 3)], schema)
    assert memory.additions(store, store).count() == 0
    files.write_memory(store, f"file://{tmp_path}/m", "source_text", "corrected")
    assert files.read_memory(spark, f"file://{tmp_path}/m", "source_text", "corrected").where("corrected = 'one'").first().source_text == odd
    ask = spark.createDataFrame([("i1", "x", "bom", "c", ["TWO"]), ("i2", "x", "measurement", "c", [])], "item_id string, source_text string, page_type string, context string, targets array<string>")
    out = sorted((r.item_id, r.corrected, tuple(r.warnings)) for r in memory.recall(ask, store).collect())
    assert out == [("i1", "three", ("conflicting_corrections", "glossary_conflict")), ("i1", "two", ("conflicting_corrections",))]


def test_glossary_reader(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_bytes("﻿source_term,target_term,aliases\n\"two\nlines\",b,c|d\ne,f,\n".encode())
    out = [(r.row_number, r.source_term, r.aliases) for r in files.read_glossary(spark, f"file://{path}").collect()]
    assert out == [(2, "two\nlines", "c|d"), (3, "e", None)]
    with pytest.raises(ValueError):
        files.read_glossary(spark, "g.xlsx")


def test_binary_files(spark, tmp_path):
    for name in ("b.PDF", "A.pdf", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    out = files.binary_files(spark, f"file://{tmp_path}").collect()
    assert [r.name for r in out] == ["A.pdf", "b.PDF"]
    assert files.bounded(files.binary_files(spark, f"file://{tmp_path}"), 4).count() == 0


def test_learning_stream_adds_once(spark, tmp_path):
    schema = "source_text string, corrected string, page_type string, context string, seq long"
    inbox, store = f"file://{tmp_path}/in", f"file://{tmp_path}/store"
    for n in range(2):
        spark.createDataFrame([("x", "one", "bom", "c", 1), ("y", f"v{n}", "bom", "c", 2)], schema).write.mode("append").parquet(inbox)
        jobs.learn_stream(spark.readStream.schema(schema).parquet(inbox), store, f"file://{tmp_path}/mark").awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(store).collect()
    assert sorted((r.source_text, r.corrected) for r in out) == [("x", "one"), ("y", "v0"), ("y", "v1")]


def test_glossary_of_any_size_finds_the_same(spark):
    parts = [("small-widget", "w"), ("c++", "c"), ("a/b test", "t"), ("±", "pm"), ("+size", "s"), ("(x) y", "xy"), ("straße", "st")]
    filler = [(f"filler{i:05d} term", "f") for i in range(50_001)]
    texts = ["a smallwidget here", "uses c++ code", "ab test and a - b test", "tol ± 5", "the +size and size", "(x) y", "eine strasse", "filler00042 term", "none"]
    rows = spark.createDataFrame(list(enumerate(texts)), "text_id int, norm_text string")

    def found(listed):
        terms = spark.createDataFrame(listed, "source_term string, target_term string").withColumns(
            {"norm": text.normalize_term(F.col("source_term")), "priority": F.lit(0), "do_not_translate": F.lit(False)}
        )
        return sorted((r.text_id, r.start, r.end, r.matched_text) for r in glossary.hits(rows, terms).collect())

    want = [
        (0, 2, 13, "smallwidget"), (1, 5, 8, "c++"), (2, 0, 7, "ab test"), (2, 12, 22, "a - b test"), (3, 4, 5, "±"), (4, 4, 9, "+size"),
        (5, 0, 5, "(x) y"), (6, 5, 12, "strasse"),
    ]
    assert found(parts) == want
    assert found(parts + filler) == sorted([*want, (7, 0, 16, "filler00042 term")])


def test_layout_of_dense_table_and_exhausted_pages(spark):
    item = "page int, item_id string, text string, x0 double, y0 double, x1 double, y1 double"
    dense = [(1, f"i{k:02d}", "short text", 200.0, 100.0, 240.0, 112.0) for k in range(30)]
    odd = [(2, "i0", "in a table", 20.0, 20.0, 60.0, 32.0), (3, "i0", "word " * 400, 5.0, 5.0, 25.0, 15.0), (4, "i0", "outside", 90.0, 90.0, 140.0, 99.0)]
    items = spark.createDataFrame(dense + odd, item)
    pages = spark.createDataFrame([(1, 0.0, 0.0, 500.0, 300.0), (2, 0.0, 0.0, 500.0, 300.0), (3, 0.0, 0.0, 30.0, 30.0), (4, 0.0, 0.0, 100.0, 100.0)], "page int, p_x0 double, p_y0 double, p_x1 double, p_y1 double")
    none = spark.createDataFrame([], "page int, id string, x0 double, y0 double, x1 double, y1 double")
    cells = spark.createDataFrame(
        [(2, 1, 0, 0, "Size", "in a table", 15.0, 15.0, 100.0, 40.0), (2, 2, 0, 0, "Remarks", "", 100.0, 15.0, 150.0, 40.0), (2, 3, 0, 0, "Fit", " ", 150.0, 15.0, 250.0, 40.0)],
        "page int, id int, table_id int, row int, header string, text string, x0 double, y0 double, x1 double, y1 double",
    )
    source = items.where("page = 2").select("page", F.lit(9).alias("id"), "x0", "y0", "x1", "y1")
    words = source.select("page", "id", "x0", "y0", "x1", "y1")
    free = spatial.free_cells(source, cells, words)
    assert [tuple(r) for r in free.collect()] == [(2, 9, 102.0, 17.0, 148.0, 38.0)]
    rest = spatial.free_cells(source, cells.where("id = 1"), words)
    assert [tuple(r) for r in rest.collect()] == [(2, 9, 61.5, 16.5, 98.5, 38.5)]
    out = {(r.page, r.item_id): r for r in layout.plan_page_layout(items, pages, none, free.withColumn("item_id", F.lit("i0")).drop("id")).collect()}
    assert len(out) == 33
    assert out[2, "i0"].strategy == "same_row_cell" and out[2, "i0"].status == "placed"
    assert out[3, "i0"].status == "manual_review_fallback" and out[3, "i0"].risk == "high"
    assert out[4, "i0"].status == "candidate_exhausted" and out[4, "i0"].x0 is None
    first = [r for (p, _), r in out.items() if p == 1 and r.status == "placed"]
    assert len(first) >= 4 and all(r.movement <= layout.NEAR for r in first)


def test_marks_in_texts_and_values_found_once(spark):
    odd = "﷐ 5 cm ﷑AB-9﷒ AB-9"
    assert locked(spark, odd) == [[("number", "5"), ("unit", "cm"), ("generic_code", "AB-9"), ("generic_code", "AB-9")]]
    cases = [("aa.a aa", "a"), ("x+x+x", "x+x"), ("﷐q q", "q"), ("ää ä", "ä"), ("none", "zz"), ("a.b axb", "a.b")]
    rows = spark.createDataFrame(cases, "t string, v string").select("t", text.literal_places(F.col("t"), F.col("v")).alias("p"))
    got = {r.t: [(x.start, x.end) for x in r.p] for r in rows.collect()}
    assert got == {"aa.a aa": [(0, 1), (1, 2), (3, 4), (5, 6), (6, 7)], "x+x+x": [(0, 3)], "﷐q q": [(1, 2), (3, 4)], "ää ä": [(0, 1), (1, 2), (3, 4)], "none": [], "a.b axb": [(0, 3)]}


def test_heavy_work_on_a_small_file_is_spread(spark, sf_tiny):
    import __spark_entry__ as entry

    assert entry.queries()["f6_validate_tokens"](spark, sf_tiny).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_matching_never_broadcasts_texts(spark):
    spans, nodes = matching.with_neighbours(frame(spark, {"rows": SPANS + BAG})), matching.with_neighbours(frame(spark, {"rows": [NODE]})).withColumn("diagonal", F.lit(1031.1))
    plan = matching.exact_matches(nodes, matching.span_chains(spans))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan

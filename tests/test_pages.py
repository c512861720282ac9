"""What meets on a page: brute force on literal rows, and plans that never move pairs."""

import random

import pytest
from marginalia.operators import spatial
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")
RECT = "page int, id long, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture(scope="module")
def boxes():
    """Dense pages with copies, edges that touch, one tall rectangle and one across bands."""
    r, rows = random.Random(7), []
    for page in range(3):
        for k in range(120):
            x, y = float(r.randrange(0, 150)), float(r.choice([0, 250, 255, 256, 500]) + r.randrange(0, 20))
            rows.append((page, k, x, y, x + r.randrange(1, 40), y + r.randrange(1, 12)))
        rows += [(page, 120, 10.0, 0.0, 30.0, 700.0), (page, 121, 0.0, 240.0, 150.0, 300.0), (page, 122, *rows[-3][2:]), (page, 123, 5.0, 5.0, 5.0, 9.0)]
    return [*rows, (None, 1, 0.0, 0.0, 9.0, 9.0), (None, 2, 0.0, 0.0, 9.0, 9.0)]


def overlap(a, b, by=0.0):
    return a[0] is not None and a[0] == b[0] and a[2] < b[4] + by and b[2] - by < a[4] and a[3] < b[5] + by and b[3] - by < a[5]


def moves(df):
    """Joins and aggregates, and exchanges after rectangles were paired."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.rindex("MapInArrow")] if "MapInArrow" in plan else plan
    return [w for w in ("Join", "Aggregate") if w in plan] + ["Exchange"] * ("Exchange" in top)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pairs_of_one_table(spark, boxes):
    """j14"""
    r = spark.createDataFrame(boxes, RECT)
    out = spatial.overlap_pairs(r, r)
    assert moves(out) == []
    assert rows_of(out) == sorted([(a[0], a[1], b[1]) for a in boxes for b in boxes if overlap(a, b)], key=str)
    other = spatial.overlap_pairs(r.where("id < 50"), r.where("id >= 50"), 3.0)
    assert rows_of(other) == sorted([(a[0], a[1], b[1]) for a in boxes for b in boxes if a[1] < 50 <= b[1] and overlap(a, b, 3.0)], key=str)


def test_earlier_placements(spark, boxes):
    """j15"""
    out = spatial.earlier_overlaps(spark.createDataFrame(boxes, RECT))
    assert moves(out) == []
    assert rows_of(out) == sorted([(a[0], a[1], b[1]) for a in boxes for b in boxes if b[1] < a[1] and overlap(a, b)], key=str)


def test_annotation_collisions(spark, boxes):
    """j16"""
    out = spatial.annotation_collisions(spark.createDataFrame(boxes, RECT), 1.0)
    assert moves(out) == []
    want = [(a[0], a[1], b[1], "overlap" if overlap(a, b) else "clearance") for a in boxes for b in boxes if a[1] != b[1] and (overlap(a, b, 1.0) if b[1] < a[1] else overlap(b, a, 1.0))]
    assert rows_of(out) == sorted(want, key=str)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_placements_dealt_out_by_page(spark, boxes):
    """j15: rows that are dealt out by page are not shuffled again; a null id comes before nothing."""
    r = spark.createDataFrame([*boxes, (0, None, 0.0, 0.0, 90.0, 90.0)], RECT).repartition("page")
    out = spatial.earlier_overlaps(r)
    assert exchanges(out) == 1
    assert rows_of(out) == sorted([(a[0], a[1], b[1]) for a in boxes for b in boxes if b[1] < a[1] and overlap(a, b)], key=str)


def test_collisions_dealt_out_by_page(spark, boxes):
    """j16: the same, also where adding the clearance rounds."""
    rows = [(p, k, *[v / 3 for v in sides]) for p, k, *sides in boxes]
    want = lambda rows, by: [(a[0], a[1], b[1], "overlap" if overlap(a, b) else "clearance") for a in rows for b in rows if a[1] != b[1] and (overlap(a, b, by) if b[1] < a[1] else overlap(b, a, by))]
    for held, by in ((boxes, 1.0), (rows, 1 / 3)):
        out = spatial.annotation_collisions(spark.createDataFrame([*held, (0, None, 0.0, 0.0, 90.0, 90.0)], RECT).repartition("page"), by)
        assert exchanges(out) == 1
        assert rows_of(out) == sorted(want(held, by), key=str)


def test_leaders_of_several_segments(spark, boxes):
    """j16, leader lines: level, upright and slanting segments, each pair once."""
    r = spark.createDataFrame(boxes, RECT)
    lines = [(0, 500, [(0.0, 5.0), (80.0, 5.0), (80.0, 600.0)]), (1, 3, [(0.0, 0.0), (160.0, 520.0)]), (2, 7, [(1.0, 1.0)]), (2, 8, [(400.0, 0.0), (400.0, 9.0)])]
    leaders = spark.createDataFrame(lines, "page int, id long, points array<struct<x:double,y:double>>")
    out = spatial.leader_collisions(leaders, r, 1.0)
    assert moves(out) == []

    def touches(p, q, b):
        """Clipping of the segment by the grown rectangle."""
        t0, t1 = 0.0, 1.0
        for d, lo, hi, at in ((q[0] - p[0], b[2] - 1, b[4] + 1, p[0]), (q[1] - p[1], b[3] - 1, b[5] + 1, p[1])):
            if d == 0:
                if not lo <= at <= hi:
                    return False
            else:
                u, v = sorted(((lo - at) / d, (hi - at) / d))
                t0, t1 = max(t0, u), min(t1, v)
        return t0 <= t1

    want = {(page, i, b[1]) for page, i, ps in lines for b in boxes if b[0] == page and b[1] != i and any(touches(p, q, b) for p, q in zip(ps, ps[1:]))}
    assert rows_of(out) == sorted(want, key=str) and len(want) > 10


def test_smallest_region(spark, boxes):
    """j18"""
    r = spark.createDataFrame(boxes, RECT)
    points = [(p, n, float(x), float(y)) for n, (p, x, y) in enumerate((p, x, y) for p in (0, 1, 9, None) for x in range(0, 200, 9) for y in (0, 5, 250, 256, 260, 512, 800))]
    out = spatial.smallest_region(spark.createDataFrame(points, "page int, id int, x double, y double"), r)
    assert moves(out) == []

    def best(p):
        held = [((b[4] - b[2]) * (b[5] - b[3]), b[1]) for b in boxes if p[0] is not None and b[0] == p[0] and b[2] <= p[2] <= b[4] and b[3] <= p[3] <= b[5]]
        return min(held)[1] if held else None

    assert rows_of(out) == sorted([(p[0], p[1], best(p)) for p in points], key=str)


def cells_of(spark, boxes):
    rows = [(*b, b[1] // 5 if b[1] % 11 else None, b[1] % 2, (" ", "x", None)[b[1] % 3], ("Fit notes", "Size", None)[b[1] % 7 % 3]) for b in boxes if b[1] % 4]
    return rows, spark.createDataFrame(rows, RECT + ", table_id long, row long, text string, header string")


def test_same_row_cells(spark, boxes):
    """j17"""
    rows, cells = cells_of(spark, boxes)
    sources = [b for b in boxes if b[1] % 4 == 0]
    out = spatial.same_row_cells(spark.createDataFrame(sources, RECT), cells)
    assert moves(out) == []
    want = {
        (s[0], s[1], c[1]) for s in sources for t in rows if t[6] is not None and overlap(s, t)
        for c in rows if c[0] == t[0] and c[6:8] == t[6:8] and not (c[8] or "").strip()
    }
    assert rows_of(out) == sorted(want, key=str) and want


def test_same_row_cells_of_one_table(spark, boxes):
    """j17: one table is read and shuffled once; rows of one cell and of several."""
    for each in (5, 1):
        rows = [(*b, b[1] + 900, b[1] % 4 == 0, b[1] % 3 > 0, b[1] // each if b[1] % 11 else None, 0, (" ", "x", None)[b[1] % 7 % 3]) for b in boxes]
        table = spark.createDataFrame(rows, RECT + ", cell_id long, is_source boolean, is_cell boolean, table_id long, row long, text string")
        out = spatial.same_row_cells_of(table.repartition("page"))
        assert moves(out) == [] and exchanges(out) == 1
        cells = [t for t in rows if t[8] and t[9] is not None]
        want = {(s[0], s[1], c[6]) for s in rows if s[7] for t in cells if overlap(s, t) for c in cells if c[0] == t[0] and c[9] == t[9] and not (c[11] or "").strip()}
        assert rows_of(out) == sorted(want, key=str) and want


def test_cells_are_read_once(spark, sf_tiny):
    """j17"""
    from marginalia.plans.space_queries import catalog

    plan = catalog.queries["j17_same_row_cells"](spark, sf_tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") == 1


def test_free_cells(spark):
    """g18: rows with remarks, rests, plain blanks; cells alike give a source one rectangle."""
    r, rows, words = random.Random(3), [], []
    for page in range(2):
        for k in range(80):
            x, y = float(r.randrange(0, 4) * 40), float(r.randrange(0, 6) * 60)
            rows.append((page, k, x, y, x + r.choice([30, 45, 60]), y + r.choice([12, 20]), k // 4 if k % 13 else None, 0, (" ", "x", None)[k % 3], ("Fit notes", "Size", None)[k % 5 % 3]))
            words.append((page, 1, x, y, x + 12.0, y + 5.0))
    words = words[::3]
    sources = [(p, k, float(7 * k), float(11 * k), 7.0 * k + 30, 11.0 * k + 9) for p in range(3) for k in range(30)]
    out = spatial.free_cells(
        spark.createDataFrame(sources, RECT), spark.createDataFrame(rows, RECT + ", table_id long, row long, text string, header string"), spark.createDataFrame(words, RECT)
    )
    assert moves(out) == []
    roomy = lambda b: b[2] - b[0] >= 24.0 and b[3] - b[1] >= 9.5
    want = set()
    for s in sources:
        for row in {t[6:8] for t in rows if overlap(s, t)}:
            offers = []
            for c in (c for c in rows if c[0] == s[0] and c[6:8] == row):
                if row[0] is not None and not (c[8] or "").strip():
                    offers.append((0 if "note" in (c[9] or "").lower() else 2, (c[2] + 2, c[3] + 2, c[4] - 2, c[5] - 2)))
                if overlap(s, c) and (ends := [w[4] for w in words if overlap(c, w)]):
                    offers.append((1, (max(ends) + 1.5, c[3] + 1.5, c[4] - 1.5, c[5] - 1.5)))
            offers = [o for o in offers if roomy(o[1])]
            want |= {(s[0], s[1], *o[1]) for o in offers if o[0] == min(o[0] for o in offers)}
    assert rows_of(out) == sorted(want, key=str) and len(want) > 20


def test_free_cells_are_read_once(spark, sf_tiny):
    """g18: one table is read and shuffled once, with the same rows as three tables."""
    from marginalia.plans import registry, space_queries

    out = space_queries.catalog.queries["g18_free_cells"](spark, sf_tiny)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") == 1
    rows = space_queries._tables(registry.Tables(spark, sf_tiny)).cache()
    three = spatial.free_cells(rows.where("is_source"), rows.where("is_cell"), rows.where("word IS NOT NULL").select("page", "id", "word.*"))
    assert rows_of(out) == rows_of(three) != []


@pytest.fixture(scope="module")
def dense():
    """Two pages whose rectangles meet hundreds of others, with copies and a null id."""
    r, rows = random.Random(9), []
    for page in range(2):
        for k in r.sample(range(1500), 1500):
            x, y = float(r.randrange(0, 150)), float(r.randrange(0, 150))
            rows.append((page, k, x, y, x + r.randrange(20, 60), y + r.randrange(8, 30)))
        rows += [(page, 1500, *rows[-1][2:]), (page, None, 0.0, 0.0, 90.0, 90.0), (page, 1501, 5.0, 5.0, 5.0, 9.0)]
    return rows


def room(df, path):
    """Bytes of a row in the file that a query's result takes."""
    df.coalesce(1).write.parquet(str(path))
    return sum(p.stat().st_size for p in path.glob("*.parquet")) / df.sparkSession.read.parquet(str(path)).count()


def test_long_lists_of_pairs_take_little_room(spark, dense, tmp_path):
    """j14"""
    r = spark.createDataFrame(dense, RECT).repartition("page")
    out = spatial.overlap_pairs(r, r)
    assert rows_of(out) == sorted([(a[0], a[1], b[1]) for a in dense for b in dense if overlap(a, b)], key=str)
    assert room(out, tmp_path / "pairs") < 0.8


def test_long_lists_of_collisions_take_little_room(spark, dense, tmp_path):
    """j16"""
    out = spatial.annotation_collisions(spark.createDataFrame(dense, RECT).repartition("page"), 1.0)
    known = [v for v in dense if v[1] is not None]
    want = [(a[0], a[1], b[1], "overlap" if overlap(a, b) else "clearance") for a in known for b in known if a[1] != b[1] and (overlap(a, b, 1.0) if b[1] < a[1] else overlap(b, a, 1.0))]
    assert rows_of(out) == sorted(want, key=str)
    assert room(out, tmp_path / "collisions") < 1.0


def test_long_lists_of_earlier_ones_take_little_room(spark, dense, tmp_path):
    """j15"""
    wide = [(page, k, x0, y0, x1 + 40, y1 + 40) for page, k, x0, y0, x1, y1 in dense]
    out = spatial.earlier_overlaps(spark.createDataFrame(wide, RECT).repartition("page"))
    known = [v for v in wide if v[1] is not None]
    assert rows_of(out) == sorted([(a[0], a[1], b[1]) for a in known for b in known if b[1] < a[1] and overlap(a, b)], key=str)
    assert room(out, tmp_path / "earlier") < 1.0

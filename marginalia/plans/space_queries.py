"""Queries of the geometry, spatial, matching, table and layout operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.functions import geometry as geo
from marginalia.functions.geometry import Box
from marginalia.operators import classify, coverage, exchange, layout, matching, review, selection, spatial, tables
from marginalia.plans.registry import Catalog
from marginalia.plans.views import RECT, RECT_SPARK, view
from marginalia.sources.scratch import staged

catalog = Catalog()
query = catalog.query
SIDES = ("x0", "y0", "x1", "y1")


def rects(t):
    return view(t, RECT_SPARK)


def _pair_sql(where: str) -> str:
    return f"SELECT a.page, a.id AS a_id, b.id AS b_id FROM r a JOIN r b ON a.page = b.page AND {where}"


_OVER = "a.x0 < b.x1{c} AND b.x0{m} < a.x1 AND a.y0 < b.y1{c} AND b.y0{m} < a.y1"
_O0, _O1 = _OVER.format(c="", m=""), _OVER.format(c=" + 1", m=" - 1")


_ON_PAGE = f"r AS MATERIALIZED (SELECT page, id, x0, y0, x1, y1, kind FROM ({RECT}))"


@query("a1_bounding_box", f"SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({RECT}) GROUP BY page")
def _a1(t):
    return spatial.bounding_box(rects(t), "page")


@query(
    "a2_union_area",
    f"""
WITH {_ON_PAGE}, e AS (SELECT DISTINCT page, x FROM (SELECT page, x0 AS x FROM r UNION ALL SELECT page, x1 FROM r)),
s AS (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) AS nx FROM e),
i AS (SELECT s.page, s.x, nx - x AS dx, y0, y1, max(y1) OVER (PARTITION BY s.page, s.x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
      FROM s JOIN r ON r.page = s.page AND r.x0 <= s.x AND r.x1 >= s.nx)
SELECT page, sum(dx * greatest(0, y1 - greatest(y0, coalesce(pm, y0)))) AS area FROM i GROUP BY page""",
)
def _a2(t):
    return spatial.union_area(rects(t), "page")


@query("j14_rect_overlap", f"WITH {_ON_PAGE} " + _pair_sql(_O0))
def _j14(t):
    r = rects(t)
    return spatial.overlap_pairs(r, r).select("page", "a_id", "b_id")


@query("j15_earlier_placements", f"WITH {_ON_PAGE} " + _pair_sql(f"b.id < a.id AND {_O0}"))
def _j15(t):
    return spatial.earlier_overlaps(rects(t)).select("page", "a_id", "b_id")


@query("j16_annotation_collisions", f"WITH {_ON_PAGE}, p AS (SELECT a.page, a.id AS i, b.id AS o, CASE WHEN {_O0} THEN 'overlap' ELSE 'clearance' END AS kind FROM r a JOIN r b ON a.page = b.page AND b.id < a.id AND {_O1}) SELECT page, i AS item_id, o AS object_id, kind FROM p UNION ALL SELECT page, o, i, kind FROM p")
def _j16(t):
    return spatial.annotation_collisions(rects(t), layout.CLEARANCE)


_CELLS = "SELECT page, id, id // 5 AS table_id, id % 5 AS row, x0, y0, x1, y1, CASE WHEN kind % 3 = 0 THEN ' ' ELSE 'x' END AS text FROM r"


@query("j17_same_row_cells", f"WITH {_ON_PAGE}, c AS ({_CELLS}), h AS (SELECT DISTINCT a.page, a.id, b.table_id, b.row FROM r a JOIN c b ON a.page = b.page AND {_O0} WHERE a.kind = 1) SELECT h.page, h.id, c.id AS cell_id FROM h JOIN c USING (page, table_id, row) WHERE trim(c.text) = ''")
def _j17(t):
    text = F.when(F.col("kind") % 3 == 0, " ").otherwise("x").alias("text")
    cell = [F.lit(True).alias("is_cell"), F.col("id").alias("cell_id"), F.floor(F.col("id") / 5).alias("table_id"), (F.col("id") % 5).alias("row"), text]
    return spatial.same_row_cells_of(rects(t).select("page", "id", (F.col("kind") == 1).alias("is_source"), *cell, *SIDES))


@query("j18_smallest_region", f"WITH {_ON_PAGE}, p AS (SELECT page, id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM r), j AS (SELECT p.page, p.id, r.id AS region_id, row_number() OVER (PARTITION BY p.page, p.id ORDER BY (r.x1 - r.x0) * (r.y1 - r.y0), r.id) AS n FROM p JOIN r ON p.page = r.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) SELECT page, id, region_id FROM j WHERE n = 1")
def _j18(t):
    r = rects(t)
    points = r.select("page", "id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return spatial.smallest_region(points, r)


@query("k12_region_by_area", f"WITH {_ON_PAGE} SELECT page, arg_min(id, [(x1 - x0) * (y1 - y0), id]) AS region_id FROM r WHERE x0 <= 250 AND x1 >= 250 GROUP BY page")
def _k12(t):
    held = rects(t).where("x0 <= 250 AND x1 >= 250")
    return held.groupBy("page").agg(F.min(F.struct(Box.of().area.alias("a"), "id")).getField("id").alias("region_id"))


@query("j19_duplicate_annotations", f"WITH {_ON_PAGE}, a AS (SELECT * FROM r WHERE kind <= 2), b AS (SELECT * FROM r WHERE kind > 2) SELECT page, id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.page = b.page AND a.kind % 2 = b.kind % 2 AND b.kind <> 5 AND greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) >= 0.5 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)))")
def _j19(t):
    r = rects(t).withColumns({"should_translate": F.col("kind") != 5})
    named = lambda d, s: d.withColumn("text", F.concat(F.lit(s), (F.col("kind") % 2).cast("string")))
    return spatial.duplicate_annotations(named(r.where("kind <= 2"), "T"), named(r.where("kind > 2"), "t")).select("page", "id")


@query("a15_collision_count", f"WITH {_ON_PAGE} SELECT a.page, a.id, count(b.id) AS n FROM r a LEFT JOIN r b ON a.page = b.page AND b.kind = 1 AND {_O1} WHERE a.kind > 1 GROUP BY a.page, a.id")
def _a15(t):
    r = rects(t)
    return spatial.collision_counts(r.where("kind > 1"), r.where("kind = 1"), layout.CLEARANCE)


_COLL = f"SELECT page % 10 AS page, id % 50 AS item_id, CASE WHEN kind > 3 THEN 'overlap' ELSE 'clearance' END AS kind, kind AS object_id, CAST(NULL AS INTEGER) AS dpi, x0 * 1000 + y0 + page / 1000.0 + id / 1000000.0 AS ord, x1 FROM ({RECT})"


@query("a16_distinct_collisions", f"SELECT page, item_id, kind, object_id, max(ord) AS ord FROM ({_COLL}) GROUP BY ALL")
def _a16(t):
    r = rects(t).select(
        (F.col("page") % 10).alias("page"), (F.col("id") % 50).alias("item_id"), F.when(F.col("kind") > 3, "overlap").otherwise("clearance").alias("kind"),
        F.col("kind").alias("object_id"), F.lit(None).cast("int").alias("dpi"), (F.col("x0") * 1000 + F.col("y0") + F.col("page") / 1000.0 + F.col("id") / 1000000.0).alias("ord"),
    )
    return spatial.distinct_collisions(r, F.col("ord")).select("page", "item_id", "kind", "object_id", "ord")


@query("u7_clipped_regions", f"SELECT DISTINCT page, greatest(x0, 100) AS x0, greatest(y0, 100) AS y0, least(x1, 300) AS x1, least(y1, 300) AS y1 FROM ({RECT}) WHERE greatest(x0, 100) < least(x1, 300) AND greatest(y0, 100) < least(y1, 300)")
def _u7(t):
    window = Box(*[F.lit(float(v)) for v in (100, 100, 300, 300)])
    cut = rects(t).select("page", Box.of().clipped(window).struct().alias("b")).select("page", "b.*")
    return cut.where(Box.of().valid()).distinct()


_G = f"SELECT page, id, {{}} FROM ({RECT})"


def _scalar(name: str, sql: str, make) -> None:
    @query(name, _G.format(sql))
    def _q(t):
        return rects(t).select("page", "id", *make(Box.of()))



def _lit(*v):
    return Box(*[F.lit(float(x)) for x in v])


_scalar("g1_box_validity", "x1 > x0 AND y1 > y0 AS ok, false AS inverted", lambda b: [b.valid().alias("ok"), Box(b.x1, b.y0, b.x0, b.y1).valid().alias("inverted")])
_scalar("g2_distance_ratio", "round(sqrt(((x0 + x1) / 2 - 225) ** 2 + ((y0 + y1) / 2 - 325) ** 2) / 1000, 9) AS ratio", lambda b: [F.round(geo.distance_ratio(b, _lit(50, 50, 400, 600), F.lit(1000.0)), 9).alias("ratio")])
_scalar("g3_rect_gap", "round(sqrt(greatest(200 - x1, x0 - 300, 0) ** 2 + greatest(200 - y1, y0 - 300, 0) ** 2), 9) AS gap", lambda b: [F.round(b.gap(_lit(200, 200, 300, 300)), 9).alias("gap")])
_scalar("g4_centre_distance", "round(sqrt(((x0 + x1) / 2 - 250) ** 2 + ((y0 + y1) / 2 - 250) ** 2), 9) AS d", lambda b: [F.round(b.centre_distance(_lit(200, 200, 300, 300)), 9).alias("d")])
_scalar("g5_overlap", "x0 < 302 AND 198 < x1 AND y0 < 302 AND 198 < y1 AS near, x0 < 300 AND 200 < x1 AND y0 < 300 AND 200 < y1 AS over", lambda b: [b.overlaps(_lit(200, 200, 300, 300), 2.0).alias("near"), b.overlaps(_lit(200, 200, 300, 300)).alias("over")])
_scalar("g6_expand_clip_contain", "greatest(x0 - 3, 100) AS cx0, least(x1 + 3, 300) AS cx1, x0 >= 100 AND y0 >= 100 AND x1 <= 400 AND y1 <= 600 AS inside", lambda b: [b.grown(3).clipped(_lit(100, 100, 300, 300)).x0.alias("cx0"), b.grown(3).clipped(_lit(100, 100, 300, 300)).x1.alias("cx1"), _lit(100, 100, 400, 600).contains(b).alias("inside")])
_scalar("g7_grid_cells", "((floor(x1 / 64) - floor(x0 / 64) + 1) * (floor(y1 / 64) - floor(y0 / 64) + 1))::INTEGER AS n", lambda b: [F.size(geo.grid_cells(b, 64.0)).alias("n")])
_scalar("g8_scaled_bbox", "round(x0 * 595 / 1000, 9) AS sx0, round(y1 * 842 / 1000, 9) AS sy1", lambda b: [F.round(geo.scaled(b, F.lit(595.0), F.lit(842.0)).x0, 9).alias("sx0"), F.round(geo.scaled(b, F.lit(595.0), F.lit(842.0)).y1, 9).alias("sy1")])
_scalar("g10_clamp", "greatest(0, least(x0, 300 - (x1 - x0))) AS cx0, greatest(0, least(y0, 300 - (y1 - y0))) AS cy0", lambda b: [b.clamped(_lit(0, 0, 300, 300)).x0.alias("cx0"), b.clamped(_lit(0, 0, 300, 300)).y0.alias("cy0")])
_scalar("g11_percent_style", "round(x0 * 100 / 800, 6) AS left_pct, round((x1 - x0) * 100 / 800, 6) AS width_pct", lambda b: [F.round(b.x0 * 100 / 800, 6).alias("left_pct"), F.round(b.width * 100 / 800, 6).alias("width_pct")])
_scalar("g12_segment_hits_box", "x0 <= 250 AND x1 >= 250 AND y0 <= 400 AND y1 >= 100 AS hit", lambda b: [geo.segment_hits_box((F.lit(250.0), F.lit(100.0)), (F.lit(250.0), F.lit(400.0)), b).alias("hit")])
_scalar("g13_bezier", "round((x0 + 3 * x0 + 3 * x1 + x1) / 8, 6) AS mx, round((y0 + 3 * y1 + 3 * y0 + y1) / 8, 6) AS my, 17 AS n", lambda b: [F.round((c := geo.bezier([(b.x0, b.y0), (b.x0, b.y1), (b.x1, b.y0), (b.x1, b.y1)]))[8]["x"], 6).alias("mx"), F.round(c[8]["y"], 6).alias("my"), F.size(c).alias("n")])
_scalar("g14_stroke_edges", "x0 - 1 AS left0, y1 + 1 AS bottom1", lambda b: [geo.stroke_edges(b, F.lit(2.0))[3]["x0"].alias("left0"), geo.stroke_edges(b, F.lit(2.0))[2]["y1"].alias("bottom1")])
_scalar("g15_light_neutral", "least(x0 / 500, 0.99, x1 / 550) >= 0.85 AND greatest(x0 / 500, 0.99, x1 / 550) - least(x0 / 500, 0.99, x1 / 550) <= 0.04 AS light", lambda b: [geo.light_neutral(b.x0 / 500, F.lit(0.99), b.x1 / 550).alias("light")])
_scalar("g16_bounded_font", "least(7.0, greatest(5.0, round_even(2 * x0 / 64, 0) / 2))::DOUBLE AS font", lambda b: [geo.bounded_font(b.x0 / 64).alias("font")])
_scalar("g17_resize_tolerance", "abs((x1 - x0) - 40) <= 0.1 AND abs((y1 - y0) - 12) <= 0.1 AS same_size", lambda b: [((F.abs(b.width - 40) <= 0.1) & (F.abs(b.height - 12) <= 0.1)).alias("same_size")])
_scalar("g20_edge_fallback", "greatest(least(x0, 595 - 72 - 2), 2) AS fx, CASE WHEN y0 > 421 THEN 2 ELSE 842 - 16 END::DOUBLE AS fy", lambda b: [F.greatest(F.least(b.x0, F.lit(595.0 - 72 - 2)), F.lit(2.0)).alias("fx"), F.when(b.y0 > 421, 2.0).otherwise(842.0 - 16).alias("fy")])
_scalar("g21_cell_remainder", "x1 - x0 - 25 >= 24 AND y1 - y0 - 5 >= 9.5 AS usable, x0 + 22.5 AS rx0", lambda b: [((b.width - 25 >= 24) & (b.height - 5 >= 9.5)).alias("usable"), (b.x0 + 22.5).alias("rx0")])
_scalar("f12_wrapped_lines", "greatest(ceil(kind * 10 / greatest(floor((x1 - x0) / (7 * 0.55)), 1)), 1)::BIGINT AS lines", lambda b: [layout.wrapped_lines(F.repeat(F.lit("x"), (F.col("kind") * 10).cast("int")), b.width, F.lit(7.0)).alias("lines")])


def _spans(t):
    """Words of part names as spans on lines, 20 parts a page."""
    p = t("part").select(F.floor(F.col("p_partkey") / 20).alias("page"), (F.col("p_partkey") % 20).alias("k"), F.posexplode(F.split("p_name", " ")).alias("w", "text"))
    x = F.col("w") * 45.0 + 10
    return p.select("page", (F.col("k") * 10 + F.col("w")).cast("int").alias("idx"), "text", x.alias("x0"), (F.col("k") * 40.0).alias("y0"), (x + 40).alias("x1"), (F.col("k") * 40.0 + 10).alias("y1"))


def _nodes(t):
    """Part names as nodes; every seventh is misspelt."""
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.col("p_name"), F.lit("s"))).otherwise(F.upper("p_name"))
    k = F.col("p_partkey") % 20
    return t("part").select(F.floor(F.col("p_partkey") / 20).alias("page"), k.cast("int").alias("idx"), name.alias("text"), F.lit(10.0).alias("x0"), (k * 40.0).alias("y0"), F.lit(95.0).alias("x1"), (k * 40.0 + 10).alias("y1"))


_SPAN_SQL = """
s AS (SELECT p_partkey // 20 AS page, ((p_partkey % 20) * 10 + w - 1)::INTEGER AS idx, string_split(p_name, ' ')[w] AS text, (w - 1) * 45.0::DOUBLE + 10 AS x0, (p_partkey % 20) * 40.0::DOUBLE AS y0
      FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS w FROM part)),
c AS (SELECT a.page, a.idx AS a, b.idx AS b FROM s a JOIN s b ON a.page = b.page AND b.idx > a.idx AND ((abs(b.x0 - a.x0) <= 3 AND b.y0 - a.y0 - 10 BETWEEN -1 AND 7.5) OR (abs(a.y0 - b.y0) <= 1.5 AND b.x0 - a.x0 - 40 BETWEEN -1 AND 14)))
"""


@query("k11_continuations", f"WITH {_SPAN_SQL} SELECT * FROM c")
def _k11(t):
    return matching.continuations(matching.with_neighbours(_spans(t)))


@query("w7_span_chains", f"WITH RECURSIVE {_SPAN_SQL}, p AS (SELECT page, [idx] AS path, text FROM s UNION ALL SELECT p.page, list_append(path, c.b), p.text || ' ' || s.text FROM p JOIN c ON c.page = p.page AND c.a = path[-1] JOIN s ON s.page = c.page AND s.idx = c.b WHERE len(path) < 4) SELECT page, array_to_string(path, '-') AS path, text FROM p")
def _w7(t):
    return matching.span_chains(matching.with_neighbours(_spans(t))).select("page", F.array_join("indices", "-").alias("path"), "text")


@query("w4_neighbour_context", f"WITH {_SPAN_SQL} SELECT page, idx, text AS norm, lag(text) OVER w AS before, lead(text) OVER w AS after FROM s WINDOW w AS (PARTITION BY page ORDER BY idx)")
def _w4(t):
    return matching.with_neighbours(_spans(t)).select("page", "idx", "norm", "before", "after")


_NODE_SQL = "n AS (SELECT p_partkey // 20 AS page, (p_partkey % 20)::INTEGER AS idx, CASE WHEN p_partkey % 7 = 0 THEN p_name || 's' ELSE p_name END AS text, (p_partkey % 20) * 40.0::DOUBLE AS y0 FROM part)"


@query("j10_exact_text_match", f"WITH {_SPAN_SQL}, {_NODE_SQL} SELECT n.page, n.idx, s.idx AS span_idx FROM n JOIN s ON n.page = s.page AND split_part(n.text, ' ', 1) = s.text")
def _j10(t):
    n = _nodes(t).select("page", "idx", F.lower(F.substring_index("text", " ", 1)).alias("norm"))
    s = matching.with_neighbours(_spans(t)).select("page", F.col("idx").alias("span_idx"), "norm")
    return n.join(s, ["page", "norm"]).select("page", "idx", "span_idx")


_CHAINED = f"WITH {_SPAN_SQL}, {_NODE_SQL}, ch AS (SELECT a.page, a.text || ' ' || b.text AS text, a.idx AS i, b.idx AS j, a.y0 FROM c JOIN s a ON a.page = c.page AND a.idx = c.a JOIN s b ON b.page = c.page AND b.idx = c.b)"


@query("j11_exact_sequence_match", _CHAINED + " SELECT n.page, n.idx, ch.i || '-' || ch.j AS path FROM n JOIN ch ON ch.page = n.page AND ch.text = n.text")
def _j11(t):
    chains = matching.span_chains(matching.with_neighbours(_spans(t)))
    n = matching.with_neighbours(_nodes(t))
    return n.join(chains.select("page", F.col("text").alias("norm"), "indices"), ["page", "norm"]).select("page", "idx", F.array_join("indices", "-").alias("path"))


def _diagonals(t):
    return _nodes(t).select("page", F.lit(1000.0).alias("diagonal")).distinct()


@query("w5_best_unless_tied", _CHAINED + ", r AS (SELECT n.page, n.idx, ch.i, ch.j, rank() OVER (PARTITION BY n.page, n.idx ORDER BY abs(ch.y0 - n.y0)) AS k FROM n JOIN ch ON ch.page = n.page AND ch.text = n.text) SELECT page, idx, i || '-' || j AS path, true AS \"unique\" FROM r WHERE k = 1")
def _w5(t):
    n = matching.with_neighbours(_nodes(t)).join(_diagonals(t), "page").drop("before", "after").withColumns({"before": F.lit(None).cast("string"), "after": F.lit(None).cast("string")})
    out = matching.exact_matches(n, matching.span_chains(matching.with_neighbours(_spans(t))))
    return out.select("page", "idx", F.array_join("indices", "-").alias("path"), "unique")


@query("j12_nearest_fuzzy")
def _j12(t):
    n = matching.with_neighbours(_nodes(t)).join(_diagonals(t), "page")
    return matching.nearest_fuzzy(n, matching.with_neighbours(_spans(t))).withColumns({"similarity": F.round("similarity", 6), "distance": F.round("distance", 6)})


@query("j13_neighbour_score", f"WITH {_SPAN_SQL}, x AS (SELECT page, idx, lag(text) OVER w AS b, lead(text) OVER w AS a FROM s WINDOW w AS (PARTITION BY page ORDER BY idx)) SELECT p.page, p.idx, coalesce((p.b = q.b)::INTEGER, 0) + coalesce((p.a = q.a)::INTEGER, 0) AS score FROM x p JOIN x q ON q.page = p.page + 1 AND q.idx = p.idx")
def _j13(t):
    s = matching.with_neighbours(_spans(t))
    q = s.select((F.col("page") - 1).alias("page"), "idx", F.col("before").alias("qb"), F.col("after").alias("qa"))
    score = matching._agreement(F.col("before"), F.col("qb")) + matching._agreement(F.col("after"), F.col("qa"))
    return s.join(q, ["page", "idx"]).select("page", "idx", score.alias("score"))


@query("c1_match_nodes", _CHAINED + ", r AS (SELECT n.page, n.idx, ch.i, ch.j, row_number() OVER (PARTITION BY n.page, n.idx ORDER BY abs(ch.y0 - n.y0)) AS k FROM n JOIN ch ON ch.page = n.page AND ch.text = n.text) SELECT page, idx, 'high' AS confidence, i || '-' || j AS path FROM r WHERE k = 1")
def _c1(t):
    out = matching.match_nodes(_nodes(t), _spans(t), _diagonals(t))
    return out.where("confidence = 'high'").select("page", "idx", "confidence", F.array_join("indices", "-").alias("path"))


def _cells(t):
    """Nations as three-column tables by region; some cells span."""
    n = t("nation").select(F.col("n_regionkey").alias("table_id"), F.expr("cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as int)").alias("row"), "n_name", "n_nationkey")
    cell = F.posexplode(F.array(F.when(F.col("row") == 0, "POM").otherwise(F.col("n_name")), F.when(F.col("row") == 0, "Description").otherwise(F.concat(F.lit("Notes: "), "n_name")), F.when(F.col("row") == 0, "Fabric").otherwise(F.lower("n_name")))).alias("ord", "text")
    return n.select("table_id", "row", cell, "n_nationkey").select("table_id", "row", "ord", "text", F.lit(1).alias("colspan"), F.when((F.col("n_nationkey") % 4 == 1) & (F.col("ord") == 0), 2).otherwise(1).alias("rowspan"))


@query("w10_place_cells", "WITH r AS (SELECT *, (row_number() OVER w - 1)::INTEGER AS row, coalesce(lag(n_nationkey) OVER w % 4 = 1, false) AS pushed FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)) SELECT n_regionkey AS table_id, row, o::INTEGER AS ord, o + pushed::INTEGER AS \"column\", CASE WHEN row = 0 THEN ['POM', 'Description', 'Fabric'][o + 1] ELSE [n_name, 'Notes: ' || n_name, lower(n_name)][o + 1] END AS text FROM r, range(3) t(o)")
def _w10(t):
    return tables.place_cells(_cells(t)).select("table_id", "row", "ord", "column", "text")


@query("w11_clip_rows", "WITH c AS (SELECT n_regionkey AS table_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row FROM nation) SELECT table_id, row::INTEGER AS row, least(3, 3 - row)::INTEGER AS rowspan FROM c WHERE row < 3")
def _w11(t):
    c = t("nation").select(F.col("n_regionkey").alias("table_id"), F.expr("cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as int)").alias("row")).withColumns({"ord": F.lit(0), "text": F.when(F.col("row") == 0, "Measurement Sheet").when(F.col("row") == 3, "Construction Detail").otherwise("x"), "colspan": F.lit(1), "rowspan": F.lit(3)})
    return tables.clip_rows(c, ["measurement sheet", "construction detail"]).select("table_id", "row", "rowspan")


@query("p12_column_role", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'retained_table_value' WHEN 1 THEN 'material' WHEN 2 THEN 'pom_description' ELSE 'table_cell' END AS role FROM part")
def _p12(t):
    k = F.col("p_partkey") % 4
    return t("part").select("p_partkey", tables.column_role(F.when(k == 0, " Tol  - :").when(k == 1, "FABRIC:").when(k == 2, "Measurement  Point").otherwise(F.col("p_name"))).alias("role"))


@query("p13_inline_role", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'description' ELSE 'retained_table_value' END WHEN 1 THEN 'note' WHEN 2 THEN 'action' WHEN 3 THEN 'retained_table_value' ELSE 'table_cell' END AS role FROM part")
def _p13(t):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "Description: x").when(k == 1, "Fit  Notes : y").when(k == 2, "Action:").when(k == 3, "Base size: M").otherwise("free: text")
    return t("part").select("p_partkey", tables.inline_role(text, F.when(F.col("p_size") % 2 == 0, "POM: A1").otherwise("A1")).alias("role"))


@query("p14_header_row", "SELECT DISTINCT n_regionkey AS table_id, 0 AS header_row FROM nation")
def _p14(t):
    return tables.header_rows(_cells(t))


@query("g9_table_nodes")
def _g9(t):
    boxes = t("region").select(F.col("r_regionkey").alias("table_id"), *[F.lit(float(v)).alias(s) for s, v in zip(SIDES, (0, 0, 300, 500), strict=True)])
    return tables.table_nodes(tables.place_cells(_cells(t)), boxes)


@query("f13_html_cells", "SELECT n_nationkey AS table_id, 0 AS row, 0 AS ord, n_name AS text, 2 AS colspan, 1 AS rowspan FROM nation UNION ALL SELECT n_nationkey, 1, 0, 'a & b', 1, 1 FROM nation UNION ALL SELECT n_nationkey, 1, 1, 'x y', 1, 3 FROM nation")
def _f13(t):
    html = F.concat(F.lit("<p>z</p><table><tr><th colspan='2'> "), "n_name", F.lit(" </th></tr><tr><td colspan=0>a &amp;\n b</td><td rowspan=3>x<br>y</td></tr></table><table><tr><td>no</td></tr></table>"))
    return t("nation").select(F.col("n_nationkey").alias("table_id"), F.explode(tables.html_cells(html)).alias("c")).select("table_id", "c.*")


def _items(t):
    return rects(t).where("kind = 1").select("page", F.format_string("i%05d", "id").alias("item_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"), *SIDES)


def _pages(t):
    return rects(t).select("page").distinct().select("page", F.lit(0.0).alias("p_x0"), F.lit(0.0).alias("p_y0"), F.lit(700.0).alias("p_x1"), F.lit(800.0).alias("p_y1"))


_CAND = f"""
WITH i AS (SELECT page, printf('i%05d', id) AS item_id, 'text of ' || id AS text, x0, y0, x1, y1 FROM ({RECT}) WHERE kind = 1),
f AS (SELECT *, least(greatest((x1 - x0) * 1.35, 72), 700 * 0.28, 690) AS bw FROM i),
g AS (SELECT *, fi, [7.0, 6.0, 5.0][fi + 1]::DOUBLE AS font, wi, CASE wi WHEN 0 THEN bw ELSE greatest(least(bw * 0.75, 690), 48) END AS w FROM f, range(3) a(fi), range(2) b(wi)),
h AS (SELECT *, greatest(font * 1.35 * greatest(ceil(length(text) / greatest(floor(greatest(w - 4, 1) / (font * 0.55)), 1)), 1) + 3, font + 4) AS h FROM g),
r AS (SELECT *, ring * greatest(w * 0.35, 18) AS dx, ring * greatest(h * 0.8, 10) AS dy FROM h, range(3) c(ring)),
o AS (SELECT *, CASE si WHEN 0 THEN x1 + 4 + dx WHEN 2 THEN x0 - 4 - dx - w ELSE x0 END AS a0, CASE si WHEN 1 THEN y1 + 4 + dy WHEN 3 THEN y0 - 4 - dy - h ELSE y0 END AS b0 FROM r, range(4) d(si)),
c AS (SELECT page, item_id, (((fi * 2 + wi) * 3 + ring) * 4 + si)::INTEGER AS candidate, font, a0, b0, a0 + w AS a1, b0 + h AS b1, x0, y0, x1, y1,
       sqrt(((a0 + a0 + w) / 2 - (x0 + x1) / 2) ** 2 + ((b0 + b0 + h) / 2 - (y0 + y1) / 2) ** 2) AS movement FROM o WHERE a0 >= 5 AND b0 >= 5 AND a0 + w <= 695 AND b0 + h <= 795)
"""


@query("g18_layout_candidates", _CAND + "SELECT page, item_id, candidate, font, round(a0, 6) AS x0, round(b1, 6) AS y1, round(movement, 6) AS movement FROM c")
def _g18(t):
    c = layout.candidates(_items(t), _pages(t))
    return c.select("page", "item_id", "candidate", "font", F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"), F.round("movement", 6).alias("movement"))


@query("k9_candidate_locality", _CAND + "SELECT page, item_id, count(*) AS n FROM (SELECT *, min(movement) OVER (PARTITION BY page, item_id) AS m FROM c) WHERE movement <= 96 OR m > 96 GROUP BY page, item_id")
def _k9(t):
    return layout.near_first(layout.candidates(_items(t), _pages(t))).groupBy("page", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("k8_fast_choice", _CAND + "SELECT page, item_id, candidate FROM (SELECT *, row_number() OVER (PARTITION BY page, item_id ORDER BY round_even(sqrt(greatest(x0 - a1, a0 - x1, 0) ** 2 + greatest(y0 - b1, b0 - y1, 0) ** 2), 6), -font, round_even(movement, 6), candidate) AS k FROM c) WHERE k = 1")
def _k8(t):
    c = layout.candidates(_items(t), _pages(t)).withColumn("collisions", F.lit(0))
    return layout.best_candidates(c).select("page", "item_id", "candidate")


@query("k7_placement_rank", _CAND + "SELECT page, item_id, candidate, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY page, item_id ORDER BY -font, round_even(movement, 6), candidate) AS k FROM c) WHERE k <= 3")
def _k7(t):
    c = layout.candidates(_items(t), _pages(t))
    w = Window.partitionBy("page", "item_id").orderBy(-F.col("font"), F.bround("movement", 6), "candidate")
    return c.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("page", "item_id", "candidate", "place")


def _tables(t):
    """Rectangles of kind 1 as sources, others as cells, five to a table row; every third kind is blank, all others are words too."""
    blank = F.col("kind") % 3 == 0
    header, text = F.when(F.col("id") % 4 == 0, " Fit Notes").otherwise("Size"), F.when(blank, " ").otherwise("x")
    word = F.when(~blank, F.struct("x0", "y0", (F.col("x0") + 12).alias("x1"), "y1"))
    return rects(t).select(
        "page", "id", *SIDES, (F.col("kind") == 1).alias("is_source"), (F.col("kind") > 1).alias("is_cell"),
        F.floor(F.col("id") / 5).alias("table_id"), F.lit(0).alias("row"), header.alias("header"), text.alias("text"), word.alias("word"),
    )


_FREE = f"""
WITH {_ON_PAGE}, c AS (SELECT *, id // 5 AS tb, CASE WHEN id % 4 = 0 THEN 0 ELSE 2 END AS choice FROM r WHERE kind > 1),
w AS (SELECT page, x0, y0, x0 + 12 AS x1, y1 FROM r WHERE kind % 3 <> 0),
h AS (SELECT a.page, a.id, b.tb, b.id AS cell, b.x0, b.y0, b.x1, b.y1 FROM r a JOIN c b ON a.page = b.page AND {_O0} WHERE a.kind = 1),
b AS (SELECT DISTINCT h.page, h.id, h.tb, choice, c.x0 + 2 AS x0, c.y0 + 2 AS y0, c.x1 - 2 AS x1, c.y1 - 2 AS y1 FROM h JOIN c USING (page, tb)
      WHERE c.kind % 3 = 0 AND c.x1 - c.x0 >= 28 AND c.y1 - c.y0 >= 13.5),
u AS (SELECT a.page, a.id AS cell, max(b.x1) AS till FROM c a JOIN w b ON a.page = b.page AND {_O0} GROUP BY a.page, a.id),
e AS (SELECT page, id, tb, 1 AS choice, till + 1.5 AS x0, y0 + 1.5 AS y0, x1 - 1.5 AS x1, y1 - 1.5 AS y1 FROM h JOIN u USING (page, cell) WHERE x1 - till >= 27 AND y1 - y0 >= 12.5)
SELECT DISTINCT page, id, x0, y0, x1, y1 FROM (SELECT *, min(choice) OVER (PARTITION BY page, id, tb) AS best FROM (SELECT * FROM b UNION ALL SELECT * FROM e)) WHERE choice = best"""


@query("g18_free_cells", _FREE)
def _g18_free(t):
    return spatial.free_cells_of(_tables(t))


@query("j16_leader_collisions", f"WITH {_ON_PAGE} SELECT DISTINCT a.page, a.id AS item_id, b.id AS object_id FROM r a JOIN r b ON a.page = b.page AND a.id <> b.id WHERE a.kind = 1 AND a.y0 BETWEEN b.y0 - 1 AND b.y1 + 1 AND a.x1 <= b.x1 + 1 AND a.x1 + 90 >= b.x0 - 1")
def _j16_leader(t):
    """Lines of two segments from the upper right corner of each rectangle of kind 1."""
    point = lambda x: F.struct(x.alias("x"), F.col("y0").alias("y"))
    points = F.array(point(F.col("x1")), point(F.col("x1") + 40), point(F.col("x1") + 90))
    return spatial.leader_collisions(rects(t).where("kind = 1").select("page", "id", points.alias("points")), rects(t).select("page", "id", *SIDES), layout.CLEARANCE)


@query("g20_page_edge", f"WITH i AS (SELECT page, printf('i%05d', id) AS item_id, length(concat('text of ', id)) AS n, y0 FROM ({RECT}) WHERE kind = 1), h AS (SELECT *, 5 * 1.35 * greatest(ceil(n / floor((690 * 0.24 - 4) / 2.75)), 1) + 3 AS h FROM i) SELECT page, item_id, 695 - 690 * 0.24::DOUBLE AS x0, least(greatest(y0, 5), 795 - greatest(h, 9)) AS y0, 695.0::DOUBLE AS x1, round(least(greatest(y0, 5), 795 - greatest(h, 9)) + greatest(h, 9), 9) AS y1 FROM h")
def _g20_edge(t):
    return layout.edge_fallback(_items(t), _pages(t)).select("page", "item_id", "x0", "y0", "x1", F.round("y1", 9).alias("y1"))


@query("c6_page_layout")
def _c6(t):
    item = lambda c: F.when(F.col("is_source"), c)
    rows = _tables(t).withColumns({"item_id": item(F.format_string("i%05d", "id")), "item_text": item(F.concat(F.lit("text of "), F.col("id").cast("string"))), "is_obstacle": F.col("is_cell")})
    out = layout.plan_page_layout_of(rows, _pages(t))
    return out.select("page", "item_id", "candidate", "strategy", "collisions", "status", "risk")


@query("w12_greedy_placement")
def _w12(t):
    return layout.place_items(_items(t), _pages(t)).select("page", "item_id", "candidate", "collisions")


@query("k13_sorted_collisions", f"SELECT page, string_agg(item_id || ':' || kind || ':' || object_id, ',' ORDER BY item_id, kind, object_id) AS listed FROM (SELECT DISTINCT page, item_id, kind, object_id FROM ({_COLL})) GROUP BY page")
def _k13(t):
    rows = _a16(t).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("item_id", "kind", "object_id"))).alias("a"))
    return rows.select("page", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["item_id"], x["kind"], x["object_id"])), ",").alias("listed"))


@query("v5_coverage_rules", "SELECT c_custkey AS page, CASE WHEN c_custkey % 7 = 0 THEN 'business_area' WHEN c_custkey % 5 = 0 THEN 'protected_items' WHEN c_custkey % 3 = 0 THEN 'groups_uncovered' ELSE 'outside_page' END AS code FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def _v5(t):
    k = F.col("c_custkey")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    none = F.array().cast("array<string>")
    pages = t("customer").select(
        k.alias("page"), F.lit("bom").alias("page_type"), F.lit("bulk").alias("stage"), F.when(k % 7 == 0, "supplemental").otherwise("bom_color_groups").alias("business_area"),
        F.when(k % 5 == 0, words("i1")).otherwise(none).alias("protected"), F.array(F.struct(F.lit("i1").alias("item_id"), F.lit(True).alias("should_translate"))).alias("existing"),
        words("red", "blue").alias("visible_groups"), F.when(k % 3 == 0, words("red")).otherwise(words("blue", "red")).alias("required_groups"),
        F.when(k % 3 == 0, words("red")).otherwise(words("red", "blue")).alias("checked_groups"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"),
        F.array(Box(F.lit(1.0), F.lit(1.0), F.when(k % 2 == 0, 101.0).otherwise(50.0), F.lit(9.0)).struct()).alias("boxes"),
    )
    return coverage.page_errors(pages)


@query("c4_supplements", f"WITH {_ON_PAGE}, e AS (SELECT page, max(id) AS last FROM r WHERE kind > 2 GROUP BY page), a AS (SELECT page, id FROM r WHERE kind <= 2) SELECT a.page, id, printf('p%03d-i%03d', a.page + 1, coalesce(last, 0) + row_number() OVER (PARTITION BY a.page ORDER BY id)) AS item_id FROM a LEFT JOIN e USING (page)")
def _c4(t):
    r = rects(t).withColumn("should_translate", F.lit(True))
    existing = r.where("kind > 2").withColumns({"text": F.lit("old"), "item_id": F.format_string("p%03d-i%03d", F.col("page") + 1, "id")})
    added = r.where("kind <= 2").withColumn("text", F.lit("new")).select("page", "id", "text", *SIDES)
    return coverage.supplements(added, existing).select("page", "id", "item_id")


@query("c3_analysis_snapshot")
def _c3(t):
    """Matched nodes with their page's class and the selection decision."""
    matched = staged(matching.match_nodes(_nodes(t), _spans(t), _diagonals(t)), "matched")
    nodes = _nodes(t).join(matched.select("page", "idx", "confidence").hint("merge"), ["page", "idx"])
    none = F.array().cast("array<string>")
    pages = nodes.select("page").distinct().select(
        "page", F.when(F.col("page") % 2 == 0, "Bill of Materials").otherwise("Cover").alias("title"), none.alias("headers"), none.alias("features"),
        F.lit(None).cast("struct<page_type:string,confidence:double,evidence:array<string>>").alias("agent"),
    )
    classed = classify.classify_pages(pages).select("page", "page_type", F.col("confidence").alias("sure"))
    rows = nodes.join(classed.hint("merge"), "page").select(
        F.col("page").alias("page_id"), F.col("idx").alias("pos"), "page_type", F.col("sure").alias("confidence"), F.lit("body").alias("role"), "text", F.col("confidence").alias("coordinate_confidence")
    )
    terms = t.spark.createDataFrame([("gizmo", "", "gizmo", 0, True)], "source_term string, target_term string, norm string, priority int, do_not_translate boolean")
    return selection.select_candidates(rows, terms).select("item_id", "page_type", "reason", "should_translate", "auto_approvable", "coordinate_confidence")


@query("c5_trusted_output")
def _c5(t):
    """Selected candidates with translation, and warnings and risk after placement."""
    chosen = staged(_c3(t), "analysis").where("should_translate").withColumn("text", F.col("item_id"))
    pairs = exchange.trusted_items(chosen, chosen.select("item_id", F.lower("item_id").alias("translated_text")))
    nodes = selection.item_ids(_nodes(t).withColumnsRenamed({"page": "page_id", "idx": "pos"}))
    items = nodes.join(chosen.select("item_id").hint("merge"), "item_id", "left_semi").select(F.col("page_id").alias("page"), "item_id", "text", *SIDES)
    pages = items.select("page").distinct().select("page", *[F.lit(v).alias(f"p_{s}") for s, v in zip(SIDES, (0.0, 0.0, 700.0, 800.0), strict=True)])
    obstacles = _spans(t).select("page", F.col("idx").alias("id"), *SIDES)
    placed = staged(layout.plan_page_layout(items, pages, obstacles), "layout").select("item_id", "status")
    warned = pairs.join(placed.hint("merge"), "item_id").withColumn(
        "w", review.warnings(F.lit(False), F.col("coordinate_confidence"), F.lit("m"), F.col("status") == "placed")
    )
    return warned.select("item_id", "translated_text", "status", F.array_join("w", ",").alias("warnings"), review.risk_level(F.col("w"), F.col("auto_approvable")).alias("risk"))

"""Placement of annotations near their source.

Candidates are plain expressions over a bounded grid of fonts, widths, rings and sides.
Choosing is sequential on a page, since each placement becomes an obstacle of the
next, so pages are the groups of a grouped map.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.geometry import Box
from marginalia.operators import greedy
from marginalia.operators import pages as page_groups
from marginalia.operators.spatial import free_cell_columns, free_offers

# Font sizes, the radius that counts as near, page margin, clearance between
# rectangles and gap to the source, in points.
FONTS = (7.0, 6.0, 5.0)
NEAR = 96.0
MARGIN = 5.0
CLEARANCE = 1.0
GAP = 4.0


def wrapped_lines(text: Column, width: Column, font: Column, advance: float = 0.55) -> Column:
    """Lines of a text of fixed advance per character; glyph widths are not modelled."""
    per_line = F.greatest(F.floor(width / (font * advance)), F.lit(1))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.greatest(F.ceil(F.char_length(p) / per_line), F.lit(1)))
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x)


def _widths() -> tuple[Column, Column]:
    """The two widths of a source's candidates."""
    page, source = Box.of("p_"), Box.of()
    most = F.greatest(page.width - 2 * MARGIN, F.lit(24.0))
    base = F.least(F.greatest(source.width * 1.35, F.lit(72.0)), page.width * 0.28, most)
    return base, F.greatest(F.least(base * 0.75, most), F.lit(48.0))


def candidates(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, item_id, candidate, font, strategy, x0..y1, movement, source_distance): at
    most 72 in-page rectangles per item.

    ``items``: page, item_id, text, sides of the source; ``pages``: page, p_x0..p_y1.
    """
    page, source = Box.of("p_"), Box.of()
    base, narrow = _widths()
    fonts = F.posexplode(F.array(*[F.lit(f) for f in FONTS])).alias("fi", "font")
    sized = items.join(pages, "page").select("*", fonts).select("*", F.posexplode(F.array_distinct(F.array(base, narrow))).alias("wi", "width"))
    n = wrapped_lines(F.col("text"), F.greatest(F.col("width") - 4, F.lit(1.0)), F.col("font"))
    sized = sized.withColumn("height", F.greatest(F.col("font") * 1.35 * n + 3, F.col("font") + 4))
    ringed = sized.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ring"))
    w, h = F.col("width"), F.col("height")
    dx, dy = F.col("ring") * F.greatest(w * 0.35, F.lit(18.0)), F.col("ring") * F.greatest(h * 0.8, F.lit(10.0))
    s = source
    sides = {
        "near_right": Box(s.x1 + GAP + dx, s.y0, s.x1 + GAP + dx + w, s.y0 + h),
        "near_below": Box(s.x0, s.y1 + GAP + dy, s.x0 + w, s.y1 + GAP + dy + h),
        "near_left": Box(s.x0 - GAP - dx - w, s.y0, s.x0 - GAP - dx, s.y0 + h),
        "near_above": Box(s.x0, s.y0 - GAP - dy - h, s.x0 + w, s.y0 - GAP - dy),
    }
    options = F.posexplode(F.array(*[F.struct(F.lit(k).alias("side"), b.struct().alias("box")) for k, b in sides.items()])).alias("si", "o")
    named = F.when(F.col("ring") == 0, F.col("o.side")).otherwise(F.concat_ws("_", "o.side", "ring"))
    box = Box(*[F.col(f"o.box.{k}") for k in ("x0", "y0", "x1", "y1")])
    safe = Box(page.x0 + MARGIN, page.y0 + MARGIN, page.x1 - MARGIN, page.y1 - MARGIN)
    return ringed.select("*", options).where(safe.contains(box)).select(
        "page", "item_id", (((F.col("fi") * 2 + F.col("wi")) * 3 + F.col("ring")) * 4 + F.col("si")).alias("candidate"), "font", named.alias("strategy"),
        *[c.alias(k) for k, c in box.columns().items()], box.centre_distance(source).alias("movement"), box.gap(source).alias("source_distance"),
    )


def _text_height(text: Column, width: Column, font: Column) -> Column:
    """Height that a text takes in a rectangle of this width."""
    return F.greatest(font * 1.35 * wrapped_lines(text, F.greatest(width - 4, F.lit(1.0)), font) + 3, font + 4)


def cell_candidates(items: DataFrame, pages: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows as of :func:`candidates` for the free cells (page, item_id, sides) beside each
    source, in every font in which the text fits. They count before all others."""
    own = cells.select("page", "item_id", *[F.col(s).alias(f"c_{s}") for s in ("x0", "y0", "x1", "y1")])
    box, source, page = Box.of("c_"), Box.of(), Box.of("p_")
    order = Window.partitionBy("page", "item_id").orderBy("c_x0", "c_y0", "c_x1", "c_y1")
    numbered = items.join(own, ["page", "item_id"]).join(pages, "page").withColumn("nth", F.row_number().over(order))
    fonts = numbered.select("*", F.posexplode(F.array(*[F.lit(f) for f in FONTS])).alias("fi", "font"))
    safe = Box(page.x0 + MARGIN, page.y0 + MARGIN, page.x1 - MARGIN, page.y1 - MARGIN)
    fits = _text_height(F.col("text"), box.width, F.col("font")) <= box.height + 1e-6
    return fonts.where(safe.contains(box) & fits).select(
        "page", "item_id", (F.col("fi") * 100_000 + F.col("nth") - 1_000_000).alias("candidate"), "font", F.lit("same_row_cell").alias("strategy"),
        *[c.alias(k) for k, c in box.columns().items()], box.centre_distance(source).alias("movement"), box.gap(source).alias("source_distance"),
    )


def edge_fallback(items: DataFrame, pages: DataFrame) -> DataFrame:
    """One row as of :func:`candidates` per item: a rectangle at the right edge of its page,
    level with the source, or all of the safe page where the text does not fit there."""
    source, valid, edge = Box.of(), *_edge(F.col("text"))
    sides = items.join(pages, "page").where(valid).select("*", *[c.alias(f"f_{k}") for k, c in edge.columns().items()])
    box = Box.of("f_")
    return sides.select(
        "page", "item_id", F.lit(0).alias("candidate"), F.lit(FONTS[-1]).alias("font"), F.lit("page_edge_fallback").alias("strategy"),
        *[c.alias(k) for k, c in box.columns().items()], box.centre_distance(source).alias("movement"), box.gap(source).alias("source_distance"),
    )


def _edge(text: Column) -> tuple[Column, Box]:
    """Whether a page has a safe part, and the rectangle of :func:`edge_fallback` there."""
    page, source = Box.of("p_"), Box.of()
    margin = F.least(F.lit(MARGIN), page.width / 4, page.height / 4)
    safe = Box(page.x0 + margin, page.y0 + margin, page.x1 - margin, page.y1 - margin)
    width = F.least(F.greatest(safe.width * 0.24, F.lit(72.0)), safe.width)
    wanted = _text_height(text, width, F.lit(FONTS[-1]))
    height = F.least(wanted, safe.height)
    top = F.least(F.greatest(source.y0, safe.y0), safe.y1 - height)
    fits = wanted <= height + 1e-6
    return safe.valid(), Box(F.when(fits, safe.x1 - width).otherwise(safe.x0), F.when(fits, top).otherwise(safe.y0), safe.x1, F.when(fits, top + height).otherwise(safe.y1))


def near_first(rows: DataFrame, limit: float = NEAR) -> DataFrame:
    """Candidates within the limit where an item has any, else all of them."""
    near = F.col("movement") <= limit
    any_near = F.max(near).over(Window.partitionBy("page", "item_id"))
    return rows.withColumn("_near", any_near).where(near | ~F.col("_near")).drop("_near")


def choice_order() -> list[Column]:
    """Fewest collisions, blank cell nearby, nearest, largest font, least moved, first."""
    cell = (F.col("strategy") == "same_row_cell") & (F.col("movement") <= NEAR)
    return [
        F.col("collisions"), ~cell, F.bround("source_distance", 6), -F.col("font"), F.bround("movement", 6), F.col("candidate"),
    ]


def best_candidates(rows: DataFrame) -> DataFrame:
    """The best candidate of each item when items do not see each other."""
    w = Window.partitionBy("page", "item_id").orderBy(*choice_order())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _overlaps(a, b, by: float) -> bool:
    return a[0] < b[2] + by and b[0] - by < a[2] and a[1] < b[3] + by and b[1] - by < a[3]


class _Grid:
    def __init__(self, cell: float = 64.0):
        self.cell, self.cells = cell, {}

    def _at(self, r):
        f = lambda v: math.floor(v / self.cell)
        return ((x, y) for x in range(f(r[0]), f(r[2]) + 1) for y in range(f(r[1]), f(r[3]) + 1))

    def add(self, r) -> None:
        for c in self._at(r):
            self.cells.setdefault(c, []).append(r)

    def count(self, r, by: float) -> int:
        grown = (r[0] - by, r[1] - by, r[2] + by, r[3] + by)
        near = {id(o): o for c in self._at(grown) for o in self.cells.get(c, ())}
        return sum(_overlaps(r, o, by) for o in near.values())


def _choose(group: pd.DataFrame) -> pd.DataFrame:
    rows = group.to_dict("records")
    placed, out = _Grid(), []
    by_item: dict[str, list[dict]] = {}
    for r in rows:
        by_item.setdefault(r["item_id"], []).append(r)
    for item in sorted(by_item):
        best = None
        for r in by_item[item]:
            rect = (r["x0"], r["y0"], r["x1"], r["y1"])
            n = r["collisions"] + placed.count(rect, CLEARANCE)
            cell = r["strategy"] == "same_row_cell" and r["movement"] <= NEAR
            key = (n, not cell, round(r["source_distance"], 6), -r["font"], round(r["movement"], 6), r["candidate"])
            if best is None or key < best[0]:
                best = (key, r, rect)
        placed.add(best[2])
        out.append(best[1] | {"collisions": best[0][0]})
    return pd.DataFrame(out, columns=group.columns)


def place(rows: DataFrame) -> DataFrame:
    """One candidate per item, items in id order, each seeing the placements before it.

    ``rows``: candidates with ``collisions``, their obstacles within the clearance.
    """
    return rows.groupBy("page").applyInPandas(_choose, rows.schema)


PLACED = "font double, strategy string, x0 double, y0 double, x1 double, y1 double, movement double, source_distance double"
RINGS = [side + (f"_{ring}" if ring else "") for ring in range(3) for side in ("near_right", "near_below", "near_left", "near_above")]


def place_items(items: DataFrame, pages: DataFrame, obstacles: DataFrame | None = None, cells: DataFrame | None = None, spare: DataFrame | None = None) -> DataFrame:
    """What :func:`place` chooses from :func:`near_first` of :func:`candidates` and
    :func:`cell_candidates`, and from the rows of ``spare`` for items without any.

    A page is one group; its candidates are made a block of items at a time and their
    collisions counted where they are, so only items, obstacles and cells are shuffled.
    """
    sides = [F.col(s).cast("double").alias(s) for s in page_groups.SIDES]
    none = lambda *names: {n: F.lit(None).cast(t) for n, t in names}
    extra = [("candidate", "int"), ("font", "double"), ("movement", "double"), ("source_distance", "double")]
    plan, lines = _plan(F.col("text"))
    rows = items.join(pages, "page").select("page", "item_id", *sides, plan.alias("plan"), lines.alias("lines"), F.lit(0).alias("part")).withColumns(none(*extra))
    of = dict(rows.dtypes)
    # Empty and not null: Spark's Arrow writer walks over all nulls of a list column again for each further row.
    arrays = {n: F.array().cast(of[n]) for n in ("plan", "lines")}
    if obstacles is not None:
        held = obstacles.where("page IS NOT NULL").select("page", *sides, F.lit(1).alias("part"))
        rows = rows.unionByName(held.withColumns(none(("item_id", of["item_id"]), *extra) | arrays))
    if cells is not None:
        rows = rows.unionByName(cells.select("page", "item_id", *sides, F.lit(2).alias("part")).withColumns(none(*extra) | arrays))
    if spare is not None:
        rows = rows.unionByName(spare.select("page", "item_id", *sides, *[n for n, _ in extra], F.lit(3).alias("part")).withColumns(arrays))
    return page_groups.by_group(rows, ["page"], _place_page, f"page {of['page']}, item_id {of['item_id']}, candidate int, {PLACED}, collisions bigint")


def _plan(text: Column) -> tuple[Column, Column]:
    """What a page's task needs of an item: the page, two widths, then a height for each font
    and width; and the lengths of the text's lines."""
    width = F.array(*[F.when(F.lit(k == 0) | (b != _widths()[0]), b) for k, b in enumerate(_widths())])
    heights = [_text_height(text, w, F.lit(f)) for f in FONTS for w in _widths()]
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.char_length(p).cast("double"))
    return F.concat(F.array(*[F.col(f"p_{s}").cast("double") for s in page_groups.SIDES]), width, F.array(*heights)), lines


def _coded(ids: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The different ids in order, and the place of each row's among them; null comes last."""
    ids = ids.combine_chunks().dictionary_encode()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    order = pc.array_sort_indices(ids.dictionary)
    place = np.full(len(order) + 1, len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return ids.dictionary.take(order), place[ids.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)]


def _place_page(group: pa.Table) -> Iterator[list]:
    part, (names, code) = group.column("part").to_numpy(), _coded(group.column("item_id"))
    box = page_groups.numbers(group, *page_groups.SIDES)
    own, given, spare = (np.flatnonzero(part == k) for k in (0, 2, 3))
    given, spare = (rows[np.argsort(code[rows], kind="stable")] for rows in (given, spare))
    if not len(own):
        return
    known = {k: page_groups.numbers(group, k)[0] for k in ("candidate", "font", "movement", "source_distance")}

    def cells(first: int, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = given[slice(*np.searchsorted(code[given], [first, first + greedy.ITEMS]))]
        rows = rows[np.lexsort((*box[::-1, rows], code[rows]))]
        return code[rows], box[:, rows]

    def spared(rows: np.ndarray) -> dict[str, np.ndarray]:
        return {"box": box[:, rows], **{k: v[rows] for k, v in known.items()}}

    for _, columns in _placements(group, names, code, box, own, box[:, part == 1], cells if len(given) else None, spare, spared):
        yield columns


def _placements(group: pa.Table, names: pa.Array, code: np.ndarray, box: np.ndarray, own: np.ndarray, obstacles: np.ndarray, cells, spare: np.ndarray, spared) -> Iterator[tuple[np.ndarray, list]]:
    """Codes of placed items and the columns of their placements, a block at a time. ``own``:
    the rows of items; ``cells`` gives the free cells of a block's items, by item and sides;
    ``spared`` the candidates of those rows of ``spare`` whose items have no other."""
    own = own[np.argsort(code[own], kind="stable")]
    plan = group.column("plan").combine_chunks().take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1).T
    length = group.column("lines").combine_chunks().take(pa.array(own))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(length).to_numpy())])
    length = length.flatten().to_numpy(zero_copy_only=False)

    def in_cells(item: np.ndarray, b: np.ndarray, met: np.ndarray) -> dict[str, np.ndarray]:
        """The candidates of :func:`cell_candidates` for a block's cells. Cells that are not
        near are left out for items that have a candidate nearby, ``met`` or in a cell."""
        low, high = (np.searchsorted(code[own], item, side) for side in ("left", "right"))
        n = high - low
        rows, at = np.repeat(np.arange(len(item)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        if (n > 1).any():
            order = np.lexsort((*b[::-1, rows], item[rows]))
            rows, at = rows[order], at[order]
        item, b = item[rows], b[:, rows]
        nth, page = np.arange(len(item)) - np.searchsorted(item, item, "left") + 1, plan[:4, at]
        safe = (b[0] >= page[0] + MARGIN) & (b[1] >= page[1] + MARGIN) & (b[2] <= page[2] - MARGIN) & (b[3] <= page[3] - MARGIN)
        item, at, nth, b = item[safe], at[safe], nth[safe], b[:, safe]
        movement, distance = greedy.apart(b, box[:, own[at]])
        some = (movement <= NEAR) | ~np.isin(item, met)
        item, at, nth, b, movement, distance = item[some], at[some], nth[some], b[:, some], movement[some], distance[some]
        count = ends[at + 1] - ends[at]
        start = np.cumsum(count) - count
        line = np.repeat(ends[at] - start, count) + np.arange(count.sum())
        keep, fonts = [], []
        for font in FONTS:
            fit = np.maximum(np.floor(np.maximum(b[2] - b[0] - 4, 1.0) / (font * 0.55)), 1.0)
            n = np.add.reduceat(np.maximum(np.ceil(length[line] / np.repeat(fit, count)), 1.0), start) if len(at) else np.zeros(0)
            keep.append(np.flatnonzero(np.maximum(font * 1.35 * n + 3, font + 4) <= b[3] - b[1] + 1e-6))
            fonts.append(np.full(len(keep[-1]), font))
        fi, k = np.repeat(np.arange(len(FONTS)), [len(v) for v in keep]), np.concatenate(keep)
        return {
            "item": item[k], "kind": np.ones(len(k), int), "box": b[:, k], "candidate": fi * 100_000 + nth[k] - 1_000_000,
            "font": np.concatenate(fonts), "movement": movement[k], "source_distance": distance[k],
        }

    def blocks() -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
        held = code[spare]
        for first in range(0, len(names), greedy.ITEMS):
            at = np.arange(*np.searchsorted(code[own], [first, first + greedy.ITEMS]))
            last, mine = spare[slice(*np.searchsorted(held, [first, first + greedy.ITEMS]))], own[at]
            item, candidate, font, around, movement, distance = greedy.ringed(box[:, mine], plan[4:, at], plan[:4, at], MARGIN, GAP, FONTS)
            pool = {"item": code[mine][item], "kind": np.zeros(len(item), int), "box": around, "candidate": candidate, "font": font, "movement": movement, "source_distance": distance}
            joined = lambda a, b: {k: np.concatenate([a[k], b[k]], axis=-1) for k in a}
            if cells is not None:
                pool = joined(pool, in_cells(*cells(first, mine), pool["item"][movement <= NEAR]))
            near = pool["movement"] <= NEAR
            some = np.bincount(pool["item"][near] - first, minlength=greedy.ITEMS) > 0
            has = np.bincount(pool["item"] - first, minlength=greedy.ITEMS) > 0
            keep = near | ~some[pool["item"] - first]
            last = last[~has[code[last] - first]]
            pool = joined({k: v[..., keep] for k, v in pool.items()}, {"item": code[last], "kind": np.full(len(last), 2), **spared(last)})
            yield pool["item"], pool | {"distance": pool["source_distance"], "cell": (pool["kind"] == 1) & (pool["movement"] <= NEAR)}

    page = group.column("page").slice(0, 1).combine_chunks()
    ring = pa.array([*RINGS, "same_row_cell", "page_edge_fallback"])
    for c, n in greedy.choose(blocks(), obstacles, CLEARANCE):
        which = np.where(c["kind"] == 0, c["candidate"].astype(int) % 12, 11 + c["kind"])
        yield c["item"], [
            page.take(pa.array(np.zeros(len(n), int))), names.take(pa.array(c["item"])), pa.array(c["candidate"].astype(np.int32)), pa.array(c["font"]), ring.take(pa.array(which)),
            *[pa.array(v) for v in c["box"]], pa.array(c["movement"]), pa.array(c["source_distance"]), pa.array(n),
        ]


def plan_page_layout(items: DataFrame, pages: DataFrame, obstacles: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Placements of all items with strategy, collisions, status and risk.

    ``cells`` are the free cells beside each source (see ``spatial.free_cells``). An item
    without any candidate goes to the edge of its page and to manual review; one whose
    source is empty or leaves its page is ``candidate_exhausted`` and has no rectangle.
    """
    source, page = Box.of(), Box.of("p_")
    sound = items.join(pages, "page").where(source.valid() & page.contains(source)).select(*items.columns)
    placed = place_items(sound, pages, obstacles, cells, edge_fallback(sound, pages))
    every = items.select("page", "item_id").join(placed, ["page", "item_id"], "left")
    return _judged(every)


def _judged(rows: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("strategy").isNull(), "candidate_exhausted").when(F.col("strategy") == "page_edge_fallback", "manual_review_fallback")
        .when(F.col("collisions") > 0, "manual_placement_required").otherwise("placed")
    )
    return rows.withColumn("status", status).withColumn("risk", F.when(F.col("status") == "placed", "low").otherwise("high"))


def plan_page_layout_of(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """:func:`plan_page_layout` of one table, whose rows may be several of these: page,
    item_id (unique on its page, null for what is no item), item_text, sides, is_obstacle, and
    what ``spatial.free_cells_of`` reads of cells and words.

    A page's free cells are found in its task, for a block of items at a time, so that they
    are neither written nor shuffled. Rows that are dealt out by page stay there.
    """
    source, page, text = Box.of(), Box.of("p_"), F.col("item_text")
    sound = F.coalesce(F.col("item_id").isNotNull() & source.valid() & page.contains(source), F.lit(False))
    valid, edge = _edge(text)
    spare = F.array(*[c.cast("double") for c in (*edge.columns().values(), edge.centre_distance(source), edge.gap(source))])
    plan, lines = _plan(text)
    some = lambda here, value: F.when(here, value).otherwise(F.array().cast("array<double>"))
    parts = {"plan": some(sound, plan), "lines": some(sound, lines), "spare": some(sound & F.coalesce(valid, F.lit(False)), spare)}
    sides = {s: F.col(s).cast("double") for s in page_groups.SIDES}
    held = rows.join(pages, "page", "left").select("page", "item_id", *[c.alias(k) for k, c in sides.items()], F.coalesce("is_obstacle", F.lit(False)).alias("is_obstacle"), *free_cell_columns(), *[c.alias(k) for k, c in parts.items()])
    held = held.where("item_id IS NOT NULL OR page IS NOT NULL")
    of = dict(held.dtypes)
    return _judged(page_groups.by_group(held, ["page"], _plan_page, f"page {of['page']}, item_id {of['item_id']}, candidate int, {PLACED}, collisions bigint"))


def _plan_page(group: pa.Table) -> Iterator[list]:
    names, code = _coded(group.column("item_id"))
    box, items = page_groups.numbers(group, *page_groups.SIDES), np.flatnonzero(pc.is_valid(group.column("item_id")).to_numpy())
    size = {k: pc.list_value_length(group.column(k)).to_numpy() for k in ("plan", "spare")}
    own, spare = np.flatnonzero(size["plan"]), np.flatnonzero(size["spare"])
    spare = spare[np.argsort(code[spare], kind="stable")]
    left = np.ones(len(names), bool)
    if len(own):
        boxes, beside = free_offers(group)
        values = group.column("spare").combine_chunks()

        def cells(first: int, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = [(code[mine[i[who]]], b) for i, who, b in beside(box[:, mine])] or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            item, b = (np.concatenate(v) for v in zip(*found))
            order = np.argsort(item, kind="stable")
            return item[order], boxes[:, b[order]]

        def spared(rows: np.ndarray) -> dict[str, np.ndarray]:
            v = values.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).T if len(rows) else np.empty((6, 0))
            return {"box": v[:4], "candidate": np.zeros(len(rows), int), "font": np.full(len(rows), FONTS[-1]), "movement": v[4], "source_distance": v[5]}

        obstacles = box[:, group.column("is_obstacle").to_numpy()]
        for item, columns in _placements(group, names, code, box, own, obstacles, cells, spare, spared):
            left[item] = False
            yield columns
    rows = pa.array(items[left[code[items]]])
    if len(rows):
        none = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.float64(), pa.string(), *[pa.float64()] * 6, pa.int64())]
        yield [group.column("page").take(rows), group.column("item_id").take(rows), *none]

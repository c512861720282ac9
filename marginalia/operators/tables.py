"""Table cells: parsing, placement with spans, header rows and roles."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Role of a column by its header.
COLUMN_ROLES = {
    "placement": "placement", "location": "placement", "position": "placement", "part": "component", "component": "component",
    "material": "material", "fabric": "material", "composition": "composition", "fiber content": "composition", "weight": "weight",
    "usage": "use", "use": "use", "point": "pom_description", "measurement point": "pom_description",
    "pom description": "pom_description", "description": "description", "fit notes": "note", "notes": "note", "comments": "note",
    "remarks": "note", "instruction": "instruction", "instructions": "instruction", "action": "action", "issue": "issue",
    "correction": "correction", "conclusion": "conclusion", "caption": "caption",
}
# Headers whose columns are kept as they are.
RETAINED = (
    "image", "component size", "size", "pom", "spec", "tolerance", "tol -", "tol +", "target", "factory", "actual", "actual diff",
    "revised", "uom", "unit", "article number", "supplier", "vendor", "color", "colour", "quantity", "qty", "code", "number",
    "status", "date", "revision", "request number", "sample id", "dimension", "label",
)
# Labels before a colon whose cells are kept as they are.
RETAINED_LABELS = (
    "style", "season", "division", "category", "designer", "tech designer", "sourcing", "stage", "measurement",
    "measurement type", "size class", "base size", "grade rule", "sample type", "requested on", "required by", "approval status",
)


def _plain(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"(?U)\s+", " ")))


def column_role(text: Column) -> Column:
    header = F.btrim(_plain(text), F.lit(" :"))
    roles = F.create_map(*[F.lit(x) for kv in COLUMN_ROLES.items() for x in kv])
    return F.when(header.isin(*RETAINED), "retained_table_value").otherwise(F.coalesce(roles[header], F.lit("table_cell")))


def inline_role(text: Column, previous: Column) -> Column:
    """Role of a 'label: value' cell, given the text of the cell before it."""
    label = _plain(F.substring_index(text, ":", 1))
    before = F.when(F.contains(previous, F.lit(":")), _plain(F.substring_index(previous, ":", 1))).otherwise("")
    return (
        F.when(~F.contains(text, F.lit(":")), "table_cell")
        .when(label == "description", F.when(before == "pom", "description").otherwise("retained_table_value"))
        .when(label.isin("notes", "fit notes", "comments", "remarks"), "note")
        .when(label.isin("instruction", "instructions", "construction detail"), "instruction")
        .when(label.isin("action", "issue", "correction", "conclusion", "caption"), label)
        .when(label.isin(*RETAINED, *RETAINED_LABELS), "retained_table_value")
        .otherwise("table_cell")
    )


class _Cells(HTMLParser):
    """Cells of the outer table, row by row; nested tables only add text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.rows, self.cell = 0, False, [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        elif self.done or self.depth != 1:
            return
        elif tag == "tr":
            self._close()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append([])
            size = {k: self._span(v) for k, v in attrs if k in ("rowspan", "colspan")}
            self.cell = [[], size.get("colspan", 1), size.get("rowspan", 1)]
        elif tag == "br" and self.cell:
            self.cell[0].append(" ")

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            if self.depth == 1:
                self._close()
                self.done = True
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._close()

    def handle_data(self, data):
        if self.cell and not self.done:
            self.cell[0].append(data)

    def _close(self):
        if self.cell:
            self.rows[-1].append((" ".join("".join(self.cell[0]).split()), self.cell[1], self.cell[2]))
            self.cell = None

    @staticmethod
    def _span(value) -> int:
        try:
            n = int(value)
        except (TypeError, ValueError):
            return 1
        return n if 1 <= n <= 1000 else 1


_CELL = T.StructType(
    [T.StructField("row", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("text", T.StringType())]
    + [T.StructField("colspan", T.IntegerType()), T.StructField("rowspan", T.IntegerType())]
)


@F.pandas_udf(T.ArrayType(_CELL))
def html_cells(html: pd.Series) -> pd.Series:
    """Cells of the first table of each page, with spans from 1 to 1000, else 1."""

    def one(value):
        p = _Cells()
        p.feed(value or "")
        p.close()
        return [
            {"row": r, "ord": o, "text": t, "colspan": c, "rowspan": s}
            for r, row in enumerate(p.rows)
            for o, (t, c, s) in enumerate(row)
        ]

    return html.map(one)


def clip_rows(cells: DataFrame, titles: list[str]) -> DataFrame:
    """Cells above the first row that names a second logical table; row spans end there."""
    w = Window.partitionBy("table_id")
    t = cells.withColumn("_title", F.when(_plain(F.col("text")).isin(*titles), _plain(F.col("text"))))
    t = t.withColumn("_first", F.min_by(F.col("_title"), F.when(F.col("_title").isNotNull(), F.struct("row", "ord"))).over(w))
    t = t.withColumn("_end", F.min(F.when(F.col("_title") != F.col("_first"), F.col("row"))).over(w))
    kept = t.where("_end IS NULL OR row < _end")
    span = F.when(F.col("_end").isNotNull(), F.least("rowspan", F.col("_end") - F.col("row"))).otherwise(F.col("rowspan"))
    return kept.withColumn("rowspan", span).select(*cells.columns)


def _place(group: pd.DataFrame) -> pd.DataFrame:
    taken: dict[int, set[int]] = {}
    columns = []
    at, column = None, 0
    rows = group.sort_values(["row", "ord"])
    for row, wide, tall in zip(rows["row"], rows["colspan"], rows["rowspan"], strict=True):
        if row != at:
            at, column = row, 0
        busy = taken.get(row, set())
        while any(c in busy for c in range(column, column + wide)):
            column += 1
        columns.append(column)
        for r in range(row, row + tall):
            taken.setdefault(r, set()).update(range(column, column + wide))
        column += wide
    return rows.assign(column=columns)


def place_cells(cells: DataFrame) -> DataFrame:
    """``cells`` (table_id, row, ord, text, colspan, rowspan) plus column.

    Each cell takes the first free columns of its row, given the spans of all cells
    before it: state that runs through a table, so tables are the groups.
    """
    schema = T.StructType([*cells.schema.fields, T.StructField("column", T.LongType())])
    return cells.groupBy("table_id").applyInPandas(_place, schema)


def header_rows(placed: DataFrame) -> DataFrame:
    """(table_id, header_row): the earliest row with most headers of known role, else the
    first with two texts, else that of the first cell."""
    filled = F.col("text") != ""
    by_row = placed.groupBy("table_id", "row").agg(
        F.count_if(filled & (column_role(F.col("text")) != "table_cell")).alias("known"), F.count_if(filled).alias("texts")
    )
    return by_row.groupBy("table_id").agg(
        F.when(F.max("known") > 0, F.max_by("row", F.struct("known", -F.col("row"))))
        .otherwise(F.coalesce(F.min(F.when(F.col("texts") > 1, F.col("row"))), F.min("row")))
        .alias("header_row")
    )


def table_nodes(placed: DataFrame, boxes: DataFrame) -> DataFrame:
    """(table_id, row, column, text, role, x0, y0, x1, y1): texts of a uniform grid over the
    table's box, with the role of their label, else of their column."""
    w = Window.partitionBy("table_id")
    sized = placed.withColumns(
        {"_rows": F.max(F.col("row") + F.col("rowspan")).over(w), "_cols": F.max(F.col("column") + F.col("colspan")).over(w)}
    ).join(header_rows(placed), "table_id")
    heads = sized.where("row = header_row").select(
        "table_id", F.explode(F.sequence(F.col("column"), F.col("column") + F.col("colspan") - 1)).alias("column"),
        F.struct("ord", column_role(F.col("text")).alias("role")).alias("h"),
    ).groupBy("table_id", "column").agg(F.max("h").getField("role").alias("head"))
    texts = sized.where("text <> ''").withColumn("_prev", F.coalesce(F.lag("text").over(w.orderBy("row", "ord")), F.lit("")))
    inline = inline_role(F.col("text"), F.col("_prev"))
    role = F.when(F.col("row") <= F.col("header_row"), "table_header").otherwise(
        F.when(inline != "table_cell", inline).otherwise(F.coalesce("head", F.lit("table_cell")))
    )
    b = boxes.select("table_id", *[F.col(s).alias(f"b_{s}") for s in ("x0", "y0", "x1", "y1")])
    cw, ch = (F.col("b_x1") - F.col("b_x0")) / F.col("_cols"), (F.col("b_y1") - F.col("b_y0")) / F.col("_rows")
    return texts.join(heads, ["table_id", "column"], "left").join(b, "table_id").select(
        "table_id", "row", "column", "text", role.alias("role"),
        (F.col("b_x0") + F.col("column") * cw).alias("x0"), (F.col("b_y0") + F.col("row") * ch).alias("y0"),
        (F.col("b_x0") + (F.col("column") + F.col("colspan")) * cw).alias("x1"), (F.col("b_y0") + (F.col("row") + F.col("rowspan")) * ch).alias("y1"),
    )

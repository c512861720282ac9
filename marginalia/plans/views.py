"""Views over the driver tables that feed the operators, in both SQL dialects."""

from __future__ import annotations

from marginalia.plans.registry import Tables

#: Style specifications made from parts: codes, colours, percentages, units, tolerances.
SPEC = """
SELECT p_partkey AS text_id,
       concat('Style No: SK', CAST(p_partkey AS STRING), ' ', p_name, ' ', CAST(p_size AS STRING), ' cm PANTONE 19-',
              lpad(CAST(p_partkey % 10000 AS STRING), 4, '0'), ' TCX ', CAST(p_size % 100 AS STRING), '% ±0.5 due ',
              CAST(2000 + p_size AS STRING), '-', CAST(1 + p_size % 12 AS STRING), '-', CAST(1 + p_size % 28 AS STRING),
              ' Material: AB-', CAST(p_size AS STRING), 'X POM CODE: P', CAST(p_size AS STRING)) AS text
FROM part
"""

#: Rectangles on 200 pages; id is unique within a page.
RECT = """
SELECT CAST(row_number() OVER (PARTITION BY l_orderkey % 200 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS id,
       l_orderkey % 200 AS page, CAST((l_partkey * 7) % 500 AS DOUBLE) AS x0, CAST((l_suppkey * 13) % 700 AS DOUBLE) AS y0,
       CAST((l_partkey * 7) % 500 AS DOUBLE) + 20 + l_quantity AS x1, CAST((l_suppkey * 13) % 700 AS DOUBLE) + 8 + 2 * l_linenumber AS y1,
       l_linenumber AS kind
FROM lineitem
"""

#: The same for Spark, which sees from a column named page that its rows are already dealt out by page.
RECT_SPARK = RECT.replace("l_orderkey % 200 AS page", "page").replace("BY l_orderkey % 200", "BY page").replace("FROM lineitem", "FROM (SELECT *, l_orderkey % 200 AS page FROM lineitem)")

#: Items under review.
REVIEW = """
SELECT o_orderkey AS item_id, o_custkey % 500 AS page, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'approved_edited' WHEN 'P' THEN 'skipped' END AS status,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS risk,
       o_orderkey % 3 = 0 AS open, concat('text ', CAST(o_custkey AS STRING)) AS suggested,
       concat('text ', CAST(o_custkey + o_orderkey % 2 AS STRING)) AS reviewed, o_totalprice AS price
FROM orders
"""

#: Job states: user as job, events in time order as revisions.
STATE = """
SELECT user_id AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS revision,
       CASE event_type WHEN 'signup' THEN 'initialized' WHEN 'view' THEN 'parsed' WHEN 'click' THEN 'translation_requested'
                       WHEN 'purchase' THEN 'translation_validated' ELSE 'failed' END AS state, event_id
FROM events
"""

#: Corrections: a user turn as source, the assistant turn that follows as corrected text.
MEMORY = """
SELECT u.text AS source_text, a.text AS corrected, CASE u.conv_id % 3 WHEN 0 THEN 'bom' WHEN 1 THEN 'measurement' ELSE 'sample_review' END AS page_type,
       CAST(u.turn % 2 AS STRING) AS context, u.conv_id * 1000 + u.turn AS seq
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
"""

_LINE_COLUMNS = """
       CASE pos % 9 WHEN 0 THEN 'body' WHEN 1 THEN 'note' WHEN 2 THEN 'Description' WHEN 3 THEN 'header' WHEN 4 THEN 'issue'
                    WHEN 5 THEN 'callout' WHEN 6 THEN 'material' WHEN 7 THEN 'special note' ELSE 'label text' END AS role,
       CASE page_id % 12 WHEN 0 THEN 'general_info' WHEN 1 THEN 'bom' WHEN 2 THEN 'measurement' WHEN 3 THEN 'technical_drawing'
                         WHEN 4 THEN 'print_artwork' WHEN 5 THEN 'label_pack' WHEN 6 THEN 'sample_review' WHEN 7 THEN 'style_sample'
                         WHEN 8 THEN 'how_to_measure' WHEN 9 THEN 'construction_detail' WHEN 10 THEN 'category_fields' ELSE 'unknown' END AS page_type,
       CASE WHEN page_id % 7 = 0 THEN 0.5 ELSE 0.9 END AS confidence, text
"""
#: Lines of documents as the nodes of pages.
LINE_SPARK = f"""
SELECT page_id, CAST(pos AS BIGINT) AS pos, {_LINE_COLUMNS}
FROM (SELECT doc_id AS page_id, posexplode(split(text, '\\n')) AS (pos, text) FROM documents)
"""
LINE_DUCK = f"""
SELECT page_id, CAST(pos AS BIGINT) AS pos, {_LINE_COLUMNS}
FROM (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS text,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
"""

# Glossary rows: number, term, target, aliases, flag, priority.
GLOSSARY_ROWS = [
    (2, "anvil", "amboss", "", "no", "0"), (3, "bolt", "bolzen", "rod|ring", "false", "1"), (4, "hot anvil", "heissamboss", "", "", "0"),
    (5, "blue bolt", "blaubolzen", "", "0", "2"), (6, "gizmo", "", "", "yes", "0"), (7, "small-widget", "kleinteil", "tiny widget", "n", ""),
    (8, "plate", "platte", "", "n", "0"), (9, "Plate", "teller", "", "n", "0"), (10, "large gear", "grossrad", "", "no", "3"),
    (11, "gear", "rad", "", "1", "0"), (12, "old rod", "altstange", "", "no", "0"), (13, "cold", "kalt", "", "no", "0"),
]
GLOSSARY_BAD = [
    (14, " ", "x", "", "no", "0"), (15, "steel", "", "", "no", "0"), (16, "cloth", "stoff", "", "maybe", "0"), (17, "thread", "faden", "", "no", "1.5"),
]
_GLOSSARY_SCHEMA = "row_number int, source_term string, target_term string, aliases string, do_not_translate string, priority string"


def glossary_rows(t: Tables, bad: bool = False):
    return t.spark.createDataFrame(GLOSSARY_ROWS + (GLOSSARY_BAD if bad else []), _GLOSSARY_SCHEMA)


def values(rows: list[tuple]) -> str:
    """Rows as a SQL VALUES list."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


def view(t: Tables, text: str):
    """A view's SQL over the driver tables it names."""
    names = ("part", "lineitem", "orders", "events", "conversations", "documents", "customer", "supplier", "nation", "region", "pages", "benchmark")
    frames = {n: t(n) for n in names if f" {n}" in text}
    for n in frames:
        for before in ("FROM ", "JOIN "):
            text = text.replace(f"{before}{n}\n", f"{before}{{{n}}}\n").replace(f"{before}{n} ", f"{before}{{{n}}} ").replace(f"{before}{n})", f"{before}{{{n}}})")
    used = {n: f for n, f in frames.items() if "{" + n + "}" in text}
    return t.sql(text, **used)

"""Queries of the text, token, glossary, classification and selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text, tokens
from marginalia.operators import classify, glossary, selection
from marginalia.plans import views
from marginalia.plans.registry import Catalog
from marginalia.plans.views import GLOSSARY_BAD, GLOSSARY_ROWS, LINE_DUCK, LINE_SPARK, SPEC, values, view

catalog = Catalog()
query = catalog.query

_P_FROM = "".join(text.PUNCTUATION)
_P_TO = "".join(text.PUNCTUATION.values()).replace("'", "''")


def norm_sql(x: str) -> str:
    return rf"replace(lower(trim(regexp_replace(translate({x}, '{_P_FROM}', '{_P_TO}'), '\s+', ' ', 'g'))), 'ß', 'ss')"


@query("f1_normalize_term", f"SELECT page_id, pos, {norm_sql('text')} AS norm FROM ({LINE_DUCK})")
def _f1(t):
    return view(t, LINE_SPARK).select("page_id", "pos", text.normalize_term(F.col("text")).alias("norm"))


@query("f1_normalize_term_exact", f"SELECT page_id, pos, CASE pos % 4 WHEN 0 THEN concat({norm_sql('text')}, ' fit ab-1') WHEN 1 THEN concat({norm_sql('text')}, ' strasse 2/3') ELSE {norm_sql('text')} END AS norm FROM ({LINE_DUCK})")
def _f1x(t):
    """Ligatures, full-width letters and blanks, fractions and sharp s."""
    more = F.when(F.col("pos") % 4 == 0, "\u3000ﬁt\u3000ＡＢ–１").when(F.col("pos") % 4 == 1, " STRAẞE ⅔").otherwise("")
    return view(t, LINE_SPARK).select("page_id", "pos", text.normalize_term(F.concat("text", more)).alias("norm"))


@query(
    "f10_source_key",
    r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS source_key FROM conversations",
)
def _f10(t):
    return t("conversations").select("conv_id", "turn", text.source_key(F.col("text")).alias("source_key"))


@query(
    "f11_similarity",
    """
WITH n AS (SELECT DISTINCT p_name AS s FROM part),
p AS (SELECT a.s AS a, b.s AS b FROM n a JOIN n b ON a.s < b.s),
l AS (SELECT a, b, list_reduce(list_prepend(list_transform(range(0, len(b) + 1), lambda x: 0), list_transform(string_split(a, ''), lambda c: [ascii(c)])),
        lambda prev, c: list_reduce(list_prepend([0], list_transform(range(1, len(b) + 1), lambda j: [j])),
          lambda done, j: list_append(done, CASE WHEN ascii(substr(b, j[1], 1)) = c[1] THEN prev[j[1]] + 1
                                               ELSE greatest(prev[j[1] + 1], done[-1]) END))) AS t FROM p)
SELECT a, b, 2.0::DOUBLE * t[-1] / (len(a) + len(b)) AS similarity FROM l
""",
)
def _f11(t):
    names = t("part").select(F.col("p_name").alias("a")).distinct()
    pairs = names.join(F.broadcast(names.withColumnRenamed("a", "b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", text.similarity(F.col("a"), F.col("b")).alias("similarity"))


@query(
    "f15_occurrences",
    "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::INTEGER AS n FROM documents",
)
def _f15(t):
    return t("documents").select("doc_id", text.occurrences(F.col("text"), F.lit("the")).alias("n"))


@query(
    "f16_target_containment",
    f"SELECT conv_id, turn, contains({norm_sql('text')}, 'the') AS held FROM conversations",
)
def _f16(t):
    held = F.contains(text.normalize_term(F.col("text")), text.normalize_term(F.lit("The")))
    return t("conversations").select("conv_id", "turn", held.alias("held"))


@query(
    "f17_markdown_cell",
    "SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '|', '&#124;'), chr(10), '<br>'), chr(13), '&#13;') AS cell, true AS round_trip FROM conversations",
)
def _f17(t):
    cell = text.escape_cell(F.col("text"))
    return t("conversations").select("conv_id", "turn", cell.alias("cell"), (text.unescape_cell(cell) == F.col("text")).alias("round_trip"))


# RE2 has no lookarounds: beside a word character they are word boundaries, elsewhere their complement.
_RE2 = {
    "style_code": (r"(?i)\bSTYLE(?:\s*(?:NO\.?|NUMBER|#))?\s*[:#-]?\s*([A-Z0-9]*[A-Z][A-Z0-9._/-]*\d[A-Z0-9._/-]*)", 1),
    "pom_code": (r"(?i)\bPOM\s*(?:(?:NO\.?|CODE)\s*[:#]?\s*)?[A-Z][A-Z0-9._/-]*\d[A-Z0-9._/-]*\b", 0),
    "material_code": (r"(?i)\b(?:MATERIAL|ARTICLE|SUPPLIER)(?:\s*(?:NO\.?|NUMBER|#))?\s*[:#-]?\s*([A-Z0-9]*[A-Z][A-Z0-9._/-]*\d[A-Z0-9._/-]*)", 1),
    "date": (r"\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b", 0),
    "person": (r"\b(?:DESIGNER|REVIEWER|CUSTOMER|NAME)\s*:\s*([A-Z][A-Za-z'’-]+(?:\s+[A-Z][A-Za-z'’-]+){1,3})", 1),
    "tolerance": (r"\B±\s*\d+(?:\.\d+)?\b", 0),
    "percentage": (r"(?:\B[+-])?\b\d+(?:\.\d+)?%\B", 0),
    "unit": (r"(?i)\b(?:mm|cm|inch|gsm|oz)\b", 0),
    "number": (r"(?:\B[+-])?\b\d+(?:\.\d+)?\b", 0),
}


def _kind_query(kind: str, pattern: str, group: int) -> None:
    quoted = pattern.replace("'", "''")

    @query(f"f4_{kind}", f"SELECT text_id, array_to_string(regexp_extract_all(text, '{quoted}', {group}), '~') AS found FROM ({SPEC})")
    def _f4(t):
        return view(t, SPEC).select("text_id", F.array_join(tokens.extract_kind(F.col("text"), kind), "~").alias("found"))


for _kind, (_pattern, _group) in _RE2.items():
    _kind_query(_kind, _pattern, _group)


@query(
    "f4_color_code",
    rf"SELECT text_id, array_to_string(list_concat(regexp_extract_all(text, '(?i)\b\d{{2}}-\d{{4}}\s+TCX\b'), regexp_extract_all(text, '(?i)\bPANTONE(?:\s+[A-Z])?\s+\d{{2}}-\d{{4}}(?:\s+TCX)?\b')), '~') AS found FROM ({SPEC})",
)
def _f4_color(t):
    return view(t, SPEC).select("text_id", F.array_join(tokens.extract_kind(F.col("text"), "color_code"), "~").alias("found"))


@query(
    "f4_generic_code",
    rf"SELECT text_id, array_to_string(list_filter(regexp_extract_all(text, '\b[A-Z0-9]+(?:[-_/][A-Z0-9.]+)*\b'), lambda x: regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]')), '~') AS found FROM ({SPEC})",
)
def _f4_generic(t):
    return view(t, SPEC).select("text_id", F.array_join(tokens.extract_kind(F.col("text"), "generic_code"), "~").alias("found"))


#: What a specification is locked to: (kind, value), and the words between, in text order.
_SPEC_LOCKS = """
SELECT p_partkey AS text_id, text, [
  ['style_code', concat('SK', p_partkey)], ['number', p_size::VARCHAR], ['unit', 'cm'], ['color_code', concat('19-', lpad((p_partkey % 10000)::VARCHAR, 4, '0'), ' TCX')],
  ['percentage', concat(p_size % 100, '%')], ['tolerance', '±0.5'], ['date', concat(2000 + p_size, '-', 1 + p_size % 12, '-', 1 + p_size % 28)],
  ['material_code', concat('AB-', p_size, 'X')], ['pom_code', concat('POM CODE: P', p_size)]] AS locks
FROM part JOIN spec ON p_partkey = text_id"""


@query(
    "f4_lock_tokens",
    f"""
WITH RECURSIVE spec AS ({SPEC}), l AS ({_SPEC_LOCKS}),
walk AS (
  SELECT text_id, text, locks, 0 AS n, 0 AS till, '' AS tokens FROM l
  UNION ALL
  SELECT text_id, text, locks, n + 1, till + instr(substr(text, till + 1), locks[n + 1][2]) - 1 + length(locks[n + 1][2]),
         concat(tokens, CASE WHEN n > 0 THEN '|' ELSE '' END, locks[n + 1][1], ':', till + instr(substr(text, till + 1), locks[n + 1][2]) - 1, ':',
                till + instr(substr(text, till + 1), locks[n + 1][2]) - 1 + length(locks[n + 1][2]), ':', locks[n + 1][2])
  FROM walk WHERE n < len(locks))
SELECT text_id, tokens FROM walk WHERE n = len(locks)""",
)
def _f4_lock(t):
    found = view(t, SPEC).withColumn("tokens", tokens.lock_tokens(F.col("text")))
    show = F.transform("tokens", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"], x["value"]))
    return found.select("text_id", F.array_join(show, "|").alias("tokens"))


#: Specifications with translated labels; some lose a value, change one or swap two.
_TRANSLATED = "replace(replace(replace(text, 'Style No:', '款号'), 'Material:', '面料'), 'due', '交期')"
_TRANSLATED = f"CASE text_id % 5 WHEN 1 THEN replace({_TRANSLATED}, ' cm', '') WHEN 2 THEN replace({_TRANSLATED}, '±0.5', '±0.6') WHEN 3 THEN replace({_TRANSLATED}, '款号 SK', 'cm 款号 SK') ELSE {_TRANSLATED} END"


@query(
    "f6_validate_tokens",
    f"""
WITH RECURSIVE spec AS ({SPEC}), l AS ({_SPEC_LOCKS}), tr AS (SELECT text_id, locks, {_TRANSLATED} AS t FROM l),
walk AS (
  SELECT text_id, locks, t, 0 AS n, true AS fits FROM tr
  UNION ALL
  SELECT text_id, locks, substr(t, instr(t, locks[n + 1][2]) + length(locks[n + 1][2])), n + 1,
         fits AND instr(t, locks[n + 1][2]) > 0 AND NOT regexp_matches(left(t, instr(t, locks[n + 1][2]) - 1), '\\bcm\\b')
  FROM walk WHERE n < len(locks))
SELECT text_id, fits AS kept FROM walk WHERE n = len(locks)""",
)
def _f6(t):
    rows = t.spread(view(t, SPEC), "text_id").withColumn("translated", F.expr(_TRANSLATED))
    return rows.select("text_id", tokens.same_tokens(tokens.lock_tokens(F.col("text")), F.col("translated")).alias("kept"))


@query(
    "k2_merged_occurrences",
    "SELECT p_partkey AS text_id, concat('AB ', p_size, ':0|', p_size, ':', 4 + length(p_size::VARCHAR), '|cm:', 5 + 2 * length(p_size::VARCHAR)) AS merged FROM part",
)
def _k2(t):
    """A value of the source wins over the shorter tokens found inside it."""
    size = F.col("p_size").cast("string")
    rows = t("part").select(F.col("p_partkey").alias("text_id"), F.concat(F.lit("AB "), size).alias("value"), size.alias("size")).withColumn(
        "text", F.concat(F.col("value"), F.lit(" "), F.col("size"), F.lit(" cm"))
    )
    found = tokens.source_occurrences(F.array("value"), F.col("text"))
    merged = tokens.merged_occurrences(found, tokens.lock_tokens(F.col("text")))
    return rows.select("text_id", F.array_join(F.transform(merged, lambda x: F.concat_ws(":", x["value"], x["start"])), "|").alias("merged"))


_COMPILED_SQL = f"""
g AS (SELECT * FROM (VALUES {values(GLOSSARY_ROWS)}) v(row_number, source_term, target_term, aliases, flag, priority)),
parsed AS (SELECT row_number, source_term, target_term, flag IN ('yes', '1') AS dnt, coalesce(try_cast(nullif(priority, '') AS INTEGER), 0) AS priority,
                  list_prepend(source_term, list_filter(string_split(aliases, '|'), lambda a: a <> '')) AS names FROM g),
spelled AS (SELECT *, lower(unnest(names)) AS norm, generate_subscripts(names, 1) - 1 AS alias_pos FROM parsed),
term AS (SELECT * FROM spelled QUALIFY row_number() OVER (PARTITION BY norm, target_term, priority, dnt ORDER BY row_number, alias_pos) = 1)
"""


def _compiled(t):
    return glossary.terms(glossary.entries(views.glossary_rows(t)))


@query("a8_compiled_terms", f"WITH {_COMPILED_SQL} SELECT source_term, target_term, norm, priority, dnt AS do_not_translate FROM term")
def _a8(t):
    return _compiled(t)


@query(
    "a7_glossary_conflicts",
    f"WITH {_COMPILED_SQL}, l AS (SELECT *, lag(target_term) OVER (PARTITION BY norm, priority, dnt ORDER BY row_number, alias_pos) AS b FROM spelled) SELECT DISTINCT norm, priority, dnt AS do_not_translate, row_number FROM l WHERE b <> target_term",
)
def _a7(t):
    return glossary.conflicts(glossary.entries(views.glossary_rows(t)))


@query(
    "v11_glossary_rows",
    f"""
WITH g AS (SELECT * FROM (VALUES {values(GLOSSARY_ROWS + GLOSSARY_BAD)}) v(row_number, s, t, a, f, p))
SELECT row_number, CASE WHEN trim(s) = '' THEN 'source_term_empty' WHEN lower(trim(f)) NOT IN ('', 'true', 'yes', 'y', '1', 'false', 'no', 'n', '0') THEN 'do_not_translate_invalid'
  WHEN lower(trim(f)) NOT IN ('true', 'yes', 'y', '1') AND trim(t) = '' THEN 'target_term_empty'
  WHEN NOT regexp_matches(trim(p), '^([+-]?[0-9]+)?$') THEN 'priority_invalid' END AS error_code
FROM g WHERE error_code IS NOT NULL""",
)
def _v11(t):
    return glossary.row_errors(views.glossary_rows(t, bad=True))


_HITS_SQL = f"""
WITH {_COMPILED_SQL},
txt AS (SELECT p_partkey AS text_id, {norm_sql('p_name')} AS s FROM part),
raw AS (SELECT text_id, norm, priority, dnt, source_term, target_term,
               regexp_extract_all(s, '\\b' || replace(norm, '-', '[\\s\\-/]*') || '\\b') AS m, string_split_regex(s, '\\b' || replace(norm, '-', '[\\s\\-/]*') || '\\b') AS gap
        FROM txt, term),
one AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw WHERE len(m) > 0),
placed AS (SELECT *, (list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER AS st, m[i] AS w FROM one),
ranked AS (SELECT *, st + length(w) AS en, row_number() OVER (PARTITION BY text_id ORDER BY st, -length(w), NOT dnt, -priority, lower(source_term), target_term) AS r FROM placed)
"""


@query(
    "f3_glossary_match",
    # Terms here have at most two words: a hit is hidden only by an earlier start or a better rank at its start.
    _HITS_SQL
    + """,
free AS (SELECT * FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.text_id = a.text_id AND b.r < a.r AND b.en > a.st))
SELECT text_id, st AS start, en::INTEGER AS "end", w AS matched_text, source_term, target_term, priority, dnt AS do_not_translate FROM free
""",
)
def _f3(t):
    return glossary.hits(
        t("part").select(F.col("p_partkey").alias("text_id"), text.normalize_term(F.col("p_name")).alias("norm_text")), _compiled(t)
    )


@query("f3_glossary_hits", _HITS_SQL + """,
free AS (SELECT * FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.text_id = a.text_id AND b.r < a.r AND b.en > a.st))
SELECT source_term, count(*) AS hits FROM free GROUP BY source_term""")
def _hits(t):
    return _f3(t).groupBy("source_term").agg(F.count(F.lit(1)).alias("hits"))


@query("j23_required_target", _HITS_SQL + """,
free AS (SELECT * FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.text_id = a.text_id AND b.r < a.r AND b.en > a.st)),
tab AS (SELECT norm, min(target_term) AS t FROM term GROUP BY norm)
SELECT text_id, w AS matched_text, coalesce(x.t, y.t, free.target_term) AS target FROM free LEFT JOIN tab x ON x.norm = lower(source_term) LEFT JOIN tab y ON y.norm = w""")
def _j23(t):
    return glossary.required_target(_f3(t), _compiled(t))


_TITLE = r"regexp_extract(html, '<title>(.*?)</title>', 1)"
_PAGES = """
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'Bill of Materials' WHEN 1 THEN 'Measurement Sheet / BOM' WHEN 2 THEN 'bombard' WHEN 3 THEN 'Fit  Page – 2'
       WHEN 4 THEN '' ELSE url END AS title, page_id % 3 AS h, page_id % 4 AS v, CAST(page_id % 10 AS DOUBLE) / 10 AS c FROM pages
"""


@query(
    "p1_classify_page",
    f"""
WITH p AS ({_PAGES}), n AS (SELECT *, {norm_sql('title')} AS t FROM p),
s AS (SELECT *, list_filter([CASE WHEN regexp_matches(t, '\\b(bill of materials|bom)\\b') THEN 'bom' END, CASE WHEN regexp_matches(t, '\\b(measurement sheet|size chart)\\b') THEN 'measurement' END,
        CASE WHEN regexp_matches(t, '\\b(style sample|fit page)\\b') THEN 'style_sample' END], lambda x: x IS NOT NULL) AS a,
        CASE h WHEN 0 THEN ['measurement'] WHEN 1 THEN ['bom'] ELSE [] END AS b, CASE WHEN v = 0 THEN ['sample_review'] ELSE [] END AS d FROM n),
f AS (SELECT *, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE d END AS m, CASE WHEN len(a) > 0 THEN 'title' WHEN len(b) > 0 THEN 'table' WHEN len(d) > 0 THEN 'visual' END AS g FROM s)
SELECT page_id, CASE WHEN len(m) = 1 THEN m[1] WHEN c >= 0.8 THEN 'label_pack' ELSE 'unknown' END AS page_type,
       CASE WHEN len(m) = 1 THEN CASE g WHEN 'title' THEN 1.0 WHEN 'table' THEN 0.95 ELSE 0.9 END ELSE c END::DOUBLE AS confidence,
       CASE WHEN len(m) = 1 THEN g WHEN c >= 0.8 THEN 'agent' WHEN len(m) > 1 THEN 'conflict' ELSE 'pending' END AS stage FROM f
""",
)
def _p1(t):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    none = F.array().cast("array<string>")
    pages = view(t, _PAGES).select(
        "page_id", "title",
        F.when(F.col("h") == 0, words("POM", "Description", "Tolerance")).when(F.col("h") == 1, words("Material", "Weight", "Supplier")).otherwise(none).alias("headers"),
        F.when(F.col("v") == 0, words("Sample photos", "review annotations")).otherwise(none).alias("features"),
        F.struct(F.lit("label_pack").alias("page_type"), F.col("c").alias("confidence"), words("seen").alias("evidence")).alias("agent"),
    )
    return classify.classify_pages(pages).select("page_id", "page_type", F.col("confidence").cast("double").alias("confidence"), "stage")


@query("p2_title_phrase", r"SELECT doc_id, regexp_matches(lower(text), '(^|[^\pL\pM\pN_])(the|der)($|[^\pL\pM\pN_])') AS found FROM documents")
def _p2(t):
    return t("documents").select("doc_id", classify.has_phrase(F.lower("text"), "the", "der").alias("found"))


_GROUPS = "SELECT n_regionkey, array_agg(DISTINCT lower(substr(n_name, 1, 1))) AS g FROM nation GROUP BY n_regionkey"


@query("p3_table_rule", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'measurement' WHEN 1 THEN 'bom' ELSE '' END AS types FROM pages")
def _p3(t):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    h = F.when(F.col("page_id") % 3 == 0, words("Tolerance", "POM", "DESCRIPTION")).when(F.col("page_id") % 3 == 1, words("material", "weight", "component")).otherwise(words("material", "weight"))
    return t("pages").select("page_id", F.array_join(classify.header_types(h), ",").alias("types"))


@query("p4_visual_rule", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'technical_drawing' ELSE '' END AS types FROM pages")
def _p4(t):
    f = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("Callout  arrows"), F.lit("technical drawing"))).otherwise(F.array(F.lit("technical drawing")))
    return t("pages").select("page_id", F.array_join(classify.visual_types(f), ",").alias("types"))


@query("p16_known_jobs", "SELECT o_custkey AS job_id, bool_or(o_orderstatus <> 'P' AND o_orderpriority LIKE '1%') AS accepted FROM orders GROUP BY o_custkey")
def _p16(t):
    pages = t("orders").select(
        F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("bom").alias("page_type"),
        F.array(F.lit(" "), F.when(F.col("o_orderpriority").startswith("1"), "seen").otherwise("")).alias("evidence"),
    )
    return classify.known_jobs(pages)


_NAMED = """SELECT o_custkey % 50 AS job_id, o_orderkey AS ord, CASE WHEN o_orderkey % 41 = 0 AND o_custkey % 50 < 30 THEN 'Stage: Development' WHEN o_orderkey % 37 = 0 AND o_custkey % 50 > 20 THEN 'bulk-production phase' ELSE 'bulky stages' END AS text FROM orders"""


@query(
    "p17_stage_binding",
    f"WITH n AS ({_NAMED}), x AS (SELECT job_id, bool_or(text LIKE 'Stage%') AS d, bool_or(text LIKE 'bulk-%') AS b FROM n GROUP BY job_id) SELECT job_id, CASE WHEN d AND NOT b THEN 'development' WHEN b AND NOT d THEN 'bulk' ELSE 'ambiguous' END AS stage, concat_ws('|', CASE WHEN d THEN 'Stage: Development' END, CASE WHEN b THEN 'bulk-production phase' END) AS evidence FROM x",
)
def _p17(t):
    nodes = view(t, _NAMED.replace("FROM orders", "FROM orders "))
    return classify.stage_binding(nodes).withColumn("evidence", F.array_join("evidence", "|"))


@query("p18_business_area", "SELECT page_id, pos, CASE page_type WHEN 'technical_drawing' THEN 'cad_technical_details' WHEN 'construction_detail' THEN 'cad_technical_details' WHEN 'bom' THEN 'bom_color_groups' WHEN 'measurement' THEN 'measurement_table' WHEN 'sample_review' THEN 'customer_comments' WHEN 'style_sample' THEN 'customer_comments' WHEN 'print_artwork' THEN 'print_artwork' WHEN 'label_pack' THEN 'packaging_information' ELSE 'supplemental' END AS area FROM (" + LINE_DUCK + ")")
def _p18(t):
    return view(t, LINE_SPARK).select("page_id", "pos", classify.business_area(F.col("page_type")).alias("area"))


@query("p9_pure_dimension", rf"SELECT text_id, regexp_matches(s, '(?i)^\s*[+-]?\d+(?:\.\d+)?\s*(?:mm|cm|in(?:ch(?:es)?)?|ft|yd|\"\")?(?:\s*[x×]\s*[+-]?\d+(?:\.\d+)?\s*(?:mm|cm|in(?:ch(?:es)?)?|ft|yd|\"\")?)+\s*$') AS pure FROM (SELECT p_partkey AS text_id, concat(p_size, CASE p_partkey % 3 WHEN 0 THEN ' cm x ' WHEN 1 THEN ' × 2.5mm X' ELSE ' by ' END, p_size) AS s FROM part)".replace('\\"\\"', '"').replace('""', '"'))
def _p9(t):
    s = F.concat("p_size", F.when(F.col("p_partkey") % 3 == 0, " cm x ").when(F.col("p_partkey") % 3 == 1, " × 2.5mm X").otherwise(" by "), "p_size")
    return t("part").select(F.col("p_partkey").alias("text_id"), tokens.is_pure_dimension(s).alias("pure"))


@query("p10_code_only", "SELECT p_partkey AS text_id, p_partkey % 3 <> 0 AS code_only FROM part")
def _p10(t):
    spec = view(t, SPEC)
    s = F.when(F.col("text_id") % 3 == 0, F.col("text")).when(F.col("text_id") % 3 == 1, F.concat(F.lit("AB-"), "text_id", F.lit("X / 5 cm"))).otherwise(F.lit("IMG_\\front-1.PNG"))
    rows = spec.select("text_id", s.alias("text")).withColumn("locked", tokens.lock_tokens(F.col("text")))
    return rows.select("text_id", tokens.is_code_only(F.col("text"), F.col("locked"), text.normalize_term(F.col("text"))).alias("code_only"))


_ROLE_SQL = "replace(lower(role), ' ', '_')"


@query("p11_normal_role", f"SELECT page_id, pos, {_ROLE_SQL} AS role FROM ({LINE_DUCK})")
def _p11(t):
    return view(t, LINE_SPARK).select("page_id", "pos", selection.normal_role(F.col("role")).alias("role"))


_LABELS = ", ".join(f"'{x}'" for x in selection.ADMIN_LABELS)
_ADMIN_CASES = """SELECT p_partkey AS text_id, CASE p_partkey % 9 WHEN 0 THEN 'season ss25:' WHEN 1 THEN 'description: ' || p_name WHEN 2 THEN 'notes:' WHEN 3 THEN p_name
  WHEN 4 THEN ': x' WHEN 5 THEN 'color : red' WHEN 6 THEN 'fit notes' WHEN 7 THEN 'vendor' ELSE 'notes: ' || p_name END AS norm, CASE p_size % 2 WHEN 0 THEN 'description' ELSE 'body' END AS role FROM part"""


@query(
    "p7_administrative_text",
    f"""SELECT text_id, norm = 'fit notes' OR norm LIKE ':%' OR rtrim(rtrim(norm, ':')) IN ({_LABELS}) OR (trim(split_part(norm, ':', 1)) = 'notes' AND trim(split_part(norm, ':', 2)) = '')
 OR (trim(split_part(norm, ':', 1)) IN ({_LABELS}) AND NOT (trim(split_part(norm, ':', 1)) = 'description' AND role = 'description' AND trim(split_part(norm, ':', 2)) <> '')) OR (norm LIKE '%:' AND norm LIKE 'season %') AS admin FROM ({_ADMIN_CASES})""",
)
def _p7(t):
    rows = view(t, _ADMIN_CASES.replace("FROM part", "FROM part "))
    return rows.select("text_id", selection.is_administrative(F.col("norm"), F.col("role")).alias("admin"))


@query("p8_protected_mark", "SELECT p_partkey AS text_id, p_partkey % 3 = 0 AND p_size % 2 = 0 OR p_partkey % 3 = 1 AND p_size % 5 = 0 AS protected FROM part")
def _p8(t):
    page = F.when(F.col("p_partkey") % 3 == 0, "technical_drawing").when(F.col("p_partkey") % 3 == 1, "print_artwork").otherwise("bom")
    role = F.when(page == "technical_drawing", "body").when(F.col("p_size") % 5 == 0, "logo").otherwise("note")
    mark = F.when(F.col("p_size") % 2 == 0, " CB. ").otherwise("CB. x")
    return t("part").select(F.col("p_partkey").alias("text_id"), selection.is_protected_mark(page, role, mark).alias("protected"))


def _decided(t):
    rows = view(t, LINE_SPARK).withColumns({"norm": text.normalize_term(F.col("text")), "role": selection.normal_role(F.col("role"))})
    number = F.size(F.regexp_extract_all("text", F.lit(r"\b\d+\b"), F.lit(0)))
    return selection.decide(
        rows.withColumns(
            {
                "code_only": F.regexp_replace("text", r"[^A-Za-zÀ-ÿ]", "") == "", "pure_dimension": F.lit(False),
                "n_tokens": number, "n_hits": F.when(F.col("norm").contains("tion"), 1).otherwise(0),
            }
        )
    )


_RULES = ", ".join(
    [f"('{p}', '{r}', '{'page_rule' if r == 'body' else 'field_rule'}')" for p, rs in selection.ROLES.items() for r in rs]
    + [f"('{p}', '{r}', '{'actionable_review' if r in selection.ACTIONABLE else 'page_rule'}')" for p in selection.REVIEW_PAGES for r in selection.REVIEW_ROLES]
)
_DECIDE_SQL = rf"""
WITH l AS (SELECT page_id, pos, page_type, confidence, {_ROLE_SQL} AS role, text, {norm_sql('text')} AS norm, regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g') = '' AS code_only,
                  len(regexp_extract_all(text, '\b\d+\b')) AS n_tokens, contains({norm_sql('text')}, 'tion') AS hit FROM ({LINE_DUCK})),
r AS (SELECT l.*, base FROM l LEFT JOIN (VALUES {_RULES}) v(p, o, base) ON p = page_type AND o = role),
e AS (SELECT *, CASE WHEN page_type = 'unknown' OR confidence < 0.8 THEN 'low_confidence' WHEN norm = '' OR role = 'header' THEN 'skipped_admin' WHEN code_only THEN 'skipped_code'
        WHEN norm LIKE ':%' OR rtrim(norm, ':') IN ({_LABELS}) OR trim(split_part(norm, ':', 1)) IN ({_LABELS}) THEN 'skipped_admin' WHEN page_type IN ('how_to_measure', 'category_fields') THEN 'skipped_admin'
        WHEN page_type = 'general_info' AND role = 'special_note' THEN '+' WHEN page_type = 'general_info' THEN 'skipped_admin' END AS early FROM r),
d AS (SELECT *, sum(CASE WHEN early = '+' OR (early IS NULL AND base IS NOT NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, norm ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS dup FROM e),
f AS (SELECT *, CASE WHEN early = '+' THEN 'up' WHEN early IS NOT NULL THEN early WHEN dup THEN 'skipped_duplicate' WHEN base IS NULL THEN 'manual_candidate' ELSE 'up' END AS k FROM d),
g AS (SELECT *, CASE WHEN k <> 'up' THEN k WHEN hit THEN 'glossary_hit' WHEN n_tokens > 0 AND NOT code_only THEN 'mixed_text' ELSE coalesce(base, 'field_rule') END AS reason FROM f)
"""


@query("p5_candidate_decision", _DECIDE_SQL + "SELECT page_id, pos, reason, k = 'up' AS should_translate FROM g")
def _p5(t):
    return _decided(t).select("page_id", "pos", "reason", "should_translate")


@query("p6_reason_upgrade", _DECIDE_SQL + "SELECT reason, count(*) AS n FROM g WHERE k = 'up' GROUP BY reason")
def _p6(t):
    return _decided(t).where("should_translate").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("w2_first_selected", _DECIDE_SQL + "SELECT page_id, pos FROM g WHERE reason = 'skipped_duplicate'")
def _w2(t):
    return _decided(t).where("reason = 'skipped_duplicate'").select("page_id", "pos")


@query("w1_item_ids", f"SELECT page_id, pos, printf('p%03d-i%03d', page_id + 1, pos + 1) AS item_id FROM ({LINE_DUCK})")
def _w1(t):
    return selection.item_ids(view(t, LINE_SPARK)).select("page_id", "pos", "item_id")


@query("c2_select_candidates")
def _c2(t):
    nodes = view(t, LINE_SPARK).withColumn("coordinate_confidence", F.when(F.col("pos") % 2 == 0, "high").otherwise("low"))
    out = selection.select_candidates(nodes, _compiled(t))
    return out.select("item_id", "reason", "should_translate", "auto_approvable", F.size("locked").alias("n_locked"), "n_hits")


@query("p19_auto_approvable", _DECIDE_SQL + "SELECT page_id, pos, k = 'up' AND pos % 2 = 0 AS auto FROM g")
def _p19(t):
    return _decided(t).select("page_id", "pos", (F.col("should_translate") & (F.col("pos") % 2 == 0) & (F.col("confidence") >= 0.8) & (F.col("page_type") != "unknown")).alias("auto"))


_PREFIXED = "SELECT p_partkey AS text_id, '  Hot — ' || upper(p_name) AS text, length(p_name) AS n FROM part"


@query("f7_project_span", "SELECT p_partkey AS text_id, 8 AS start, (8 + length(p_name))::INTEGER AS \"end\" FROM part")
def _f7(t):
    rows = view(t, _PREFIXED.replace("FROM part", "FROM part "))
    span = tokens.project_span(F.col("text"), F.lit(6), (F.col("n") + 6).cast("int"))
    return rows.select("text_id", span.alias("s")).select("text_id", "s.start", "s.end")


def _flagged_hits(t):
    found = _f3(t).groupBy("text_id").agg(F.collect_list(F.struct("start", "end", "matched_text", "do_not_translate")).alias("hits"))
    return found.join(t("part").select(F.col("p_partkey").alias("text_id"), F.upper("p_name").alias("text")), "text_id")


@query("f8_glossary_locks", "SELECT p_partkey AS text_id, CASE WHEN contains(p_name, 'gizmo') THEN 'glossary:' || (instr(p_name, 'gizmo') - 1) || '|number:90' ELSE 'glossary:' || (instr(p_name, 'gear') - 1) || '|number:90' END AS locks FROM part WHERE (contains(p_name, 'gizmo') OR (contains(p_name, 'gear') AND NOT contains(p_name, 'large gear')))")
def _f8(t):
    token = lambda v, a, b: F.struct(F.lit(v).alias("value"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("number").alias("kind"))
    spread = F.array(token("x", 0, 80), token("y", 90, 91))
    locked = _flagged_hits(t).where(F.exists("hits", lambda h: h["do_not_translate"])).withColumn("l", tokens.lock_glossary(spread, F.col("hits")))
    return locked.select("text_id", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["kind"], x["start"])), "|").alias("locks"))


@query("f9_restored_spelling", _HITS_SQL + """,
free AS (SELECT * FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.text_id = a.text_id AND b.r < a.r AND b.en > a.st))
SELECT text_id, string_agg(upper(w), ',' ORDER BY st) AS spelling FROM free GROUP BY text_id""")
def _f9(t):
    order = F.array_sort("hits")
    return _flagged_hits(t).select("text_id", F.array_join(F.transform(order, lambda h: F.substring(F.col("text"), h["start"] + 1, h["end"] - h["start"])), ",").alias("spelling"))


@query("k1_hit_order", _HITS_SQL + " SELECT text_id, string_agg(w, ',' ORDER BY r) AS ranked FROM ranked GROUP BY text_id")
def _k1(t):
    """All hits by start, length, flag, priority, term and target, before overlaps go."""
    unit = _compiled(t)
    rows = t("part").select(F.col("p_partkey").alias("text_id"), text.normalize_term(F.col("p_name")).alias("s"))
    pairs = rows.join(F.broadcast(unit.withColumn("regex", glossary.pattern(F.col("norm")))), F.regexp_like("s", F.col("regex")))
    placed = pairs.select("text_id", F.explode(text.placed(F.col("s"), F.col("regex"))).alias("m"), "source_term", "target_term", "priority", "do_not_translate")
    order = F.struct(F.col("m.start"), F.col("m.start") - F.col("m.end"), ~F.col("do_not_translate"), -F.col("priority"), F.lower("source_term"), F.col("target_term"), F.col("m.found").alias("w"))
    return placed.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["w"]), ",").alias("ranked"))

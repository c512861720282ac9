"""Files in and out: binary inputs, glossary and memory tables, canonical JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.text import escape_cell, unescape_cell

#: Largest artifact that is read.
ARTIFACT_BYTES = 8 << 20
GLOSSARY_FORMATS = (".csv",)


def binary_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(path, name, length, sha256, place): files directly in a folder, suffix in any case,
    in order of case-folded name."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    named = rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    return named.orderBy(F.lower("name"), "name")


def bounded(files: DataFrame, limit: int = ARTIFACT_BYTES) -> DataFrame:
    return files.where(F.col("length") <= limit)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV glossary with row_number from 2, missing optional columns as null.

    Columns are found by header; a byte order mark is dropped. Other formats are refused.
    One file is one task: quoted line breaks and row numbers need the file's order.
    """
    if not path.lower().endswith(GLOSSARY_FORMATS):
        raise ValueError(f"unsupported glossary format: {path}")
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    renamed = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    for required in ("source_term", "target_term"):
        if required not in renamed.columns:
            raise ValueError(f"glossary lacks the column {required}")
    optional = {c: F.lit(None).cast("string") for c in ("aliases", "category", "context", "do_not_translate", "priority", "notes") if c not in renamed.columns}
    numbered = renamed.coalesce(1).withColumn("row_number", (F.monotonically_increasing_id() + 2).cast("int"))
    return numbered.withColumns(optional)


MEMORY_COLUMNS = ("source_text", "original_translation", "corrected_translation", "page_type", "context", "reviewed_at", "source_file", "job_id", "item_id")


def memory_lines(records: DataFrame, *columns: str) -> DataFrame:
    """(value): one Markdown table row per record."""
    cells = [escape_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return records.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def parse_memory_lines(lines: DataFrame, *columns: str) -> DataFrame:
    """Records of Markdown rows (value); rows of another arity, headers and rules are left out."""
    inner = F.regexp_extract("value", r"(?s)^\| (.*) \|\z", 1)
    cells = lines.where(F.col("value").startswith("| ")).select(F.split(inner, r" \| ", -1).alias("c")).where(F.size("c") == len(columns))
    rows = cells.where(~F.forall("c", lambda x: x.rlike("^:?-+:?$")) & (F.col("c") != F.array(*[F.lit(x) for x in columns])))
    return rows.select(*[unescape_cell(F.get("c", F.lit(i))).alias(n) for i, n in enumerate(columns)])


def write_memory(records: DataFrame, path: str, *columns: str) -> None:
    """One Markdown table, header first; the file appears only when it is complete."""
    spark = records.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "| " + " | ".join("---" for _ in columns) + " |")], "n int, value string")
    body = memory_lines(records, *columns).withColumn("n", F.lit(2))
    head.unionByName(body.select("n", "value")).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def read_memory(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return parse_memory_lines(spark.read.text(path, lineSep="\n"), *columns)


def write_canonical_json(rows: DataFrame, path: str) -> None:
    """One canonical object per line: keys sorted, no blanks, nulls kept."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def complete_pages(pages: DataFrame) -> DataFrame:
    """(job_id, complete): page numbers are 0..n-1, each once."""
    return pages.groupBy("job_id").agg(
        ((F.count("page") == F.count_distinct("page")) & (F.min("page") == 0) & (F.max("page") == F.count("page") - 1)).alias("complete")
    )


def parse_or_degrade(pages: DataFrame) -> DataFrame:
    """(job_id, mode, first_incomplete): native text serves a job whose parser failed only if
    no page needs recognition."""
    g = pages.groupBy("job_id").agg(F.bool_and(F.col("n_missing") == 0).alias("native"), F.bool_or("parser_failed").alias("failed"), F.min(F.when(F.col("n_missing") > 0, F.col("page"))).alias("first"))
    mode = F.when(~F.col("failed"), "parsed").when(F.col("native"), "native_only").otherwise("error")
    return g.select("job_id", mode.alias("mode"), F.when(mode == "error", F.col("first")).alias("first_incomplete"))


def native_titles(spans: DataFrame) -> DataFrame:
    """(page, title): largest font among spans of the upper 30 %, else of all; ties by place and text."""
    order = Window.partitionBy("page").orderBy(F.col("upper").desc(), F.col("font").desc(), "y0", "x0", "text")
    upper = spans.withColumn("upper", (F.col("y0") <= 0.3 * F.col("height")).cast("int"))
    return upper.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("page", F.col("text").alias("title"))


def native_headers(spans: DataFrame, known: list[str]) -> DataFrame:
    """(page, headers): distinct known words in first-seen order."""
    words = spans.select("page", "idx", F.posexplode(F.split(F.translate(F.lower("text"), "/,", "  "), r"\s+")).alias("w", "word")).where(F.col("word").isin(*known))
    first = words.groupBy("page", "word").agg(F.min(F.struct("idx", "w")).alias("at"))
    return first.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("headers"))


def flat_spans(pages: DataFrame) -> DataFrame:
    """(page, block, line, span, text): nonblank spans of blocks of lines of spans."""
    b = pages.select("page", F.posexplode("blocks").alias("block", "lines"))
    ln = b.select("page", "block", F.posexplode("lines").alias("line", "spans"))
    return ln.select("page", "block", "line", F.posexplode("spans").alias("span", "text")).where(F.btrim("text") != "")


def nested_tables(documents: DataFrame, depth: int = 32) -> DataFrame:
    """(id, path, html): objects of type table at any depth of a JSON text, up to ``depth``
    levels, in document order of their paths."""
    spark = documents.sparkSession
    return spark.sql(
        f"""
        WITH RECURSIVE walk MAX RECURSION LEVEL {depth} AS (
          SELECT id, CAST('' AS STRING) AS path, try_parse_json(json) AS v FROM {{documents}}
          UNION ALL
          SELECT w.id, concat(w.path, '/', lpad(CAST(e.pos AS STRING), 6, '0')), e.value
          FROM walk w, LATERAL variant_explode(w.v) e)
        SELECT id, path, try_variant_get(v, '$.html', 'string') AS html FROM walk
        WHERE schema_of_variant(v) LIKE 'OBJECT%' AND try_variant_get(v, '$.type', 'string') = 'table'""",
        documents=documents,
    )

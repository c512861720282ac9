"""Job state log: legal steps, invariants, batch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States that may follow a state; the first is initialized.
FOLLOWS = {
    "": ("initialized",),
    "initialized": ("parsed", "failed"),
    "parsed": ("translation_requested", "failed"),
    "translation_requested": ("translation_requested", "translation_validated", "failed"),
    "translation_validated": ("review_ready", "failed"),
    "review_ready": ("review_ready", "review_completed", "failed"),
    "review_completed": ("applying", "failed"),
    "applying": ("applying", "succeeded", "failed"),
}
# Artifacts that a state needs, and wait reasons that it allows.
_REVIEWED = ("analysis", "request", "response", "expected_output", "review_html")
NEEDS = {
    "parsed": ("analysis",),
    "translation_requested": ("analysis", "request"),
    "translation_validated": ("analysis", "request", "response"),
    "review_ready": _REVIEWED,
    "review_completed": (*_REVIEWED, "review"),
    "applying": (*_REVIEWED, "review"),
    "succeeded": (*_REVIEWED, "review", "apply_result"),
}
WAITS = {
    "parsed": ("", "agent_classification"),
    "translation_requested": ("host_translation", "host_correction", "agent_failure", "human_review_required"),
    "review_ready": ("human_review",),
}
#: Exit codes, most severe first.
SEVERITY = (3, 2, 5, 4, 0)


def steps(log: DataFrame) -> DataFrame:
    """``log`` (job_id, revision, state) plus legal: the step is allowed and revisions count up
    by one from 0."""
    w = Window.partitionBy("job_id").orderBy("revision")
    before = F.coalesce(F.lag("state").over(w), F.lit(""))
    expected = F.coalesce(F.lag("revision").over(w) + 1, F.lit(0))
    allowed = F.lit(False)
    for state, following in FOLLOWS.items():
        allowed = allowed | ((F.col("_before") == state) & F.col("state").isin(*following))
    return log.withColumns({"_before": before, "_expected": expected}).withColumn(
        "legal", allowed & (F.col("revision") == F.col("_expected"))
    ).drop("_before", "_expected")


def _by_state(table: dict[str, tuple[str, ...]], default: tuple[str, ...]) -> Column:
    out = F.array(*[F.lit(x) for x in default]).cast("array<string>")
    for state, values in table.items():
        out = F.when(F.col("state") == state, F.array(*[F.lit(v) for v in values])).otherwise(out)
    return out


def invariant_errors(snapshots: DataFrame) -> DataFrame:
    """(job_id, revision, code): the first broken invariant of each snapshot.

    ``snapshots``: job_id, revision, state, attempt, wait_reason ('' for none), artifacts map.
    """
    held = F.map_keys("artifacts")
    early = F.col("state").isin("initialized", "parsed")
    code = (
        F.when(F.size(F.array_except(_by_state(NEEDS, ()), held)) > 0, "artifact_missing")
        .when(~F.array_contains(_by_state(WAITS, ("",)), F.col("wait_reason")), "wait_reason")
        .when(early & (F.col("attempt") != 0), "attempt")
        .when(((F.col("state") == "initialized") & (F.col("revision") != 0)) | ((F.col("state") == "parsed") & (F.col("revision") < 1)), "revision")
    )
    return snapshots.select("job_id", "revision", code.alias("code")).where("code IS NOT NULL")


def exit_code(state: Column) -> Column:
    return F.when(state == "succeeded", 0).when(state == "failed", 3).when(state.isin("review_ready", "translation_requested"), 4).otherwise(5)


def batch_exit(jobs: DataFrame, *by: str) -> DataFrame:
    """The most severe exit code of each batch."""
    rank = F.array_position(F.array(*[F.lit(c) for c in SEVERITY]), F.col("code"))
    return jobs.groupBy(*by).agg(F.min_by("code", rank).alias("exit_code"))


def unchanged_rounds(rounds: DataFrame) -> DataFrame:
    """``rounds`` (job_id, round, signature) plus streak: rounds since the signature changed."""
    w = Window.partitionBy("job_id").orderBy("round")
    changed = F.coalesce(F.lag("signature").over(w) != F.col("signature"), F.lit(True)).cast("int")
    run = rounds.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w))
    return run.withColumn("streak", F.row_number().over(Window.partitionBy("job_id", "_run").orderBy("round")) - 1).drop("_c", "_run")


def job_id(digest: Column, at: Column) -> Column:
    """First 12 hex digits of the source digest and the UTC time to the second."""
    return F.concat(F.substring(digest, 1, 12), F.lit("-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def problem_paths(problems: DataFrame) -> DataFrame:
    """(root, id, depth, path): every problem below its root, from (id, parent_id, ord) rows."""
    spark = problems.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE p AS (
          SELECT id AS root, id, 0 AS depth, CAST(id AS STRING) AS path FROM {problems} WHERE parent_id IS NULL
          UNION ALL
          SELECT p.root, c.id, p.depth + 1, concat(p.path, '/', c.id) FROM p JOIN {problems} c ON c.parent_id = p.id)
        SELECT * FROM p""",
        problems=problems,
    )

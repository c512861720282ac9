"""Streaming forms: job states by key, and idempotent learning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.operators import memory
from marginalia.operators.state import FOLLOWS

_OUT = "job_id long, revision long, state string, legal boolean"
_STATE = "state string, revision long, attempt int"


def _advance(key: tuple, rows: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    state, revision, attempt = kept.get if kept.exists else ("", -1, 0)
    out = []
    for row in pd.concat(list(rows)).sort_values("revision").itertuples():
        legal = row.state in FOLLOWS.get(state, ()) and row.revision == revision + 1
        if legal:
            # Asking again is the one correction that a job may have.
            attempt += state == row.state == "translation_requested"
            legal = attempt <= 1
        if legal:
            state, revision = row.state, row.revision
        out.append((key[0], row.revision, row.state, legal))
    kept.update((state, int(revision), int(attempt)))
    yield pd.DataFrame(out, columns=["job_id", "revision", "state", "legal"])


def track_jobs(log: DataFrame) -> DataFrame:
    """A stream of (job_id, revision, state) plus legal; illegal steps do not move a job."""
    return log.groupBy("job_id").applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def learn_stream(corrections: DataFrame, store: str, checkpoint: str):
    """Start a query that adds each batch's new corrections to a Parquet store once.

    Every batch is a folder named by its number that a replay overwrites, and what earlier
    batches hold is not added again.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        reader = spark.read.schema(batch.schema)
        known = reader.option("recursiveFileLookup", "true").parquet(store) if number else spark.createDataFrame([], batch.schema)
        earlier = known if not number else known.where(~known["_metadata.file_path"].contains(f"/batch-{number:010d}/"))
        memory.additions(earlier, batch).write.mode("overwrite").parquet(f"{store}/batch-{number:010d}")

    return corrections.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

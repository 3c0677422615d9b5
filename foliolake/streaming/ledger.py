"""Stage ledger: which input passed which stage.  Keyed by (file_hash, stage), the newest mark wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["file_hash", "stage"]


def mark(ledger: DataFrame, marks: DataFrame) -> DataFrame:
    """Ledger with ``marks(file_hash, stage, result_path, completed_at)`` applied."""
    both = ledger.unionByName(marks)
    # of marks with one time, the one with the larger path
    newest = F.max_by(F.struct("result_path", "completed_at"), F.struct("completed_at", "result_path"))
    return both.groupBy(*KEY).agg(newest.alias("_r")).select(*KEY, "_r.*")


def is_processed(ledger: DataFrame, file_hash: str, stage: str) -> DataFrame:
    return ledger.filter((F.col("file_hash") == file_hash) & (F.col("stage") == stage))


def unprocessed(inputs: DataFrame, ledger: DataFrame, stage: str) -> DataFrame:
    """Inputs without a mark for the stage; an input listed twice stays listed twice."""
    done = ledger.filter(F.col("stage") == stage).select("file_hash")
    return inputs.join(done, "file_hash", "left_anti")


def clear_stage(ledger: DataFrame, stage: str) -> DataFrame:
    return ledger.filter(F.col("stage") != stage)


def stage_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("stage").agg(F.count("*").alias("n"))

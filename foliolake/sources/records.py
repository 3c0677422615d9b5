"""Extraction records (JSON), person registries and case-store tables."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_records(spark: SparkSession, folder: str, *, one_per_file: bool = True) -> DataFrame:
    """Extraction records, nested or bare, one JSON file per document or one line each; bad ones keep their text."""
    raw = spark.read.schema(schemas.RECORD).option("multiLine", one_per_file).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True).json(folder)
    return raw.withColumn("path", F.col("_metadata.file_path"))


def record_documents(records: DataFrame) -> DataFrame:
    """Documents of nested records and of bare ones; the source path fills in for a missing file path."""

    def field(name: str) -> Column:
        return F.coalesce(F.col(f"document.{name}"), F.col(name)) if name in records.columns else F.col(f"document.{name}")

    names = [f.name for f in schemas.RECORD_DOCUMENT.fields]
    docs = records.select(*[field(n).alias(n) for n in names if n != "pdfUrl"],
                          F.coalesce(F.nullif(field("pdfUrl"), F.lit("")), F.when(F.col("document").isNotNull(), F.col("source_path")))
                          .alias("pdfUrl"))
    return docs.filter(F.col("id").isNotNull() & F.col("title").isNotNull()).select(
        F.col("id").alias("doc_id"), "title", "date", "source", "category", "summary", F.col("ocrText").alias("text"),
        F.array_join("tags", "; ").alias("tags"), F.col("pageCount").alias("page_count"), F.col("pdfUrl").alias("file_path"),
        F.col("batesRange").alias("number_range"))


def record_pages(records: DataFrame) -> DataFrame:
    return records.select(F.explode("pages").alias("p")).select(
        F.col("p.document_id").alias("doc_id"), "p.page_number", "p.text_content", "p.char_count")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``persons(person_id, slug, name, aliases, category, short_bio, ord)`` from a JSON array of persons, or a folder of such files.

    ``ord`` decides which entry wins a shared name: the file, then the place in its array, whatever task reads it.
    What is no array of persons has none.
    """
    listed = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.from_json("value", T.ArrayType(schemas.PERSON_JSON)).alias("_all"))
    person = F.col("_person")
    return listed.select("_file", F.posexplode("_all").alias("_at", "_person")).filter(person.isNotNull()).select(
        person["id"].alias("person_id"), person["slug"].alias("slug"), person["name"].alias("name"), person["aliases"].alias("aliases"),
        person["category"].alias("category"), person["shortBio"].alias("short_bio"), F.struct("_file", "_at").alias("ord"))


def read_store(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A store table under its declared schema; nothing is inferred."""
    return spark.read.schema(schemas.STORE[table]).parquet(f"{folder}/{table}")


def _writes(plan) -> bool:
    """Any node of a parsed statement is a command or puts rows somewhere."""
    if re.search("Insert|Delete|Update|Merge|Create|Replace|Drop|Alter|Truncate|Set|Command|Statement", plan.getClass().getSimpleName()):
        return True
    children = plan.children()
    return any(_writes(children.apply(i)) for i in range(children.size()))


def sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], *, page_size: int = 50, offset: int = 0,
        args: Mapping[str, object] | None = None) -> DataFrame:
    """Read-only ad-hoc SQL over case tables, one page of the result.  What writes is told by its parsed plan."""
    statement = text.strip().rstrip(";")
    if _writes(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)):
        raise ValueError("only queries are allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement, args=dict(args or {})).offset(offset).limit(page_size)


def run_limited(df: DataFrame, seconds: float = 15.0) -> list[T.Row]:
    """Collect one page, cancelling the job when it takes longer than ``seconds``."""
    import threading
    import uuid

    context = df.sparkSession.sparkContext
    tag = f"limited-{uuid.uuid4()}"
    context.addJobTag(tag)
    timer = threading.Timer(seconds, lambda: context.cancelJobsWithTag(tag))
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()
        context.removeJobTag(tag)

"""Files on shared storage: discovery, plain text, images, web pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import (
    base_name, blank_to_null, bytes_id, content_id, date_from_text, html_to_text, image_stub_text, strip, subject_from_text, suffix,
    title_from_path,
)
from ..functions.text import html_title as page_title


def discover(spark: SparkSession, folder: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """``(path, length, modified, extension)`` of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    listed = files.select("path", "length", F.col("modificationTime").alias("modified"), suffix("path").alias("extension"))
    return listed.filter(F.col("extension").isin(list(extensions))) if extensions else listed


def text_documents(spark: SparkSession, folder: str, extensions: Sequence[str] = tuple(V.TEXT_INGEST_EXTENSIONS)) -> DataFrame:
    """Plain files, one document each: ``(doc_id, title, text, tags, path)``; blank files are skipped."""
    raw = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    named = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return text_to_documents(named.filter(suffix("path").isin(list(extensions))))


def text_to_documents(files: DataFrame) -> DataFrame:
    """The same from rows ``(path, text)``."""
    return files.filter(strip("text") != "").select(
        content_id("text", "txt-").alias("doc_id"), title_from_path("path", capitalise=True).alias("title"), "text",
        F.lit("text-ingest").alias("tags"), "path")


def image_stubs(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """A stub document per standalone image: placeholder text, one page."""
    name = base_name(path)
    return files.filter(suffix(path).isin(V.STUB_IMAGE_EXTENSIONS)).select(
        bytes_id(content, "img-").alias("doc_id"), title_from_path(path).alias("title"), image_stub_text(name).alias("text"),
        F.concat(F.lit("image; "), suffix(path)).alias("tags"), F.lit(1).alias("page_number"), (F.length(name) + 14).alias("char_count"))


def html_documents(pages: DataFrame, *, key: str = "page_id", path: str = "url", html: str = "html") -> DataFrame:
    """Web pages as documents: ``(key, doc_id, title, date, text, tags)``.

    A subject line inside the text wins, then the page's own title, then the file name.
    """
    # fragments and queries are not part of the file name
    bare = F.regexp_replace(path, r"[?#].*$", "")
    body = pages.select(key, bare.alias("_path"), F.col(html), html_to_text(html).alias("text"))
    title = F.coalesce(subject_from_text("text"), blank_to_null(page_title(html)), title_from_path("_path"))
    return body.select(key, bytes_id(html, "doc-").alias("doc_id"), title.alias("title"), date_from_text("text").alias("date"),
                       "text", F.lit("markitdown; html").alias("tags"))

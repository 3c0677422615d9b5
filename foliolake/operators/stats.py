"""Counts, timelines, directories and roll-ups over the store tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed_values as V
from ..functions import noise
from ..functions.text import file_family, suffix


def spelling() -> Column:
    """Smallest (text, type) of a group: stands for the arbitrary row a bare column would show."""
    return F.min(F.struct("text", "entity_type"))


# --- documents --------------------------------------------------------------------------------


def document_sizes(documents: DataFrame, pages: DataFrame, *, text: str = "text", declared_pages: str | None = None) -> DataFrame:
    """Pages and characters per document; without pages the declared count and the body length stand in."""
    counted = pages.groupBy("doc_id").agg(F.count("*").alias("_pages"), F.sum("char_count").alias("_chars"))
    declared = F.coalesce(F.col(declared_pages).cast("long"), F.lit(0)) if declared_pages else F.lit(0)
    slim = documents.select("doc_id", F.coalesce(F.length(text), F.lit(0)).alias("_body"), declared.cast("long").alias("_declared"))
    return slim.join(counted, "doc_id", "left").select(
        "doc_id", F.coalesce("_pages", "_declared").alias("total_pages"), F.coalesce("_chars", F.col("_body").cast("long")).alias("total_chars"))


def per_year(documents: DataFrame, date: str | Column = "date") -> DataFrame:
    day = F.col(date) if isinstance(date, str) else date
    return documents.select(F.year(day).alias("year")).filter("year is not null").groupBy("year").agg(F.count("*").alias("n"))


def per_year_text(documents: DataFrame, date: str = "date") -> DataFrame:
    """The raw variant: the first four characters of a date kept as text."""
    return documents.filter(F.length(date) >= 4).groupBy(F.substring(date, 1, 4).alias("year")).agg(F.count("*").alias("n"))


def date_range(documents: DataFrame, date: str = "date") -> DataFrame:
    return documents.agg(F.min(date).alias("date_min"), F.max(date).alias("date_max"))


def peak_year(years: DataFrame) -> DataFrame:
    """Year with most documents, the last one on ties."""
    return years.agg(F.max_by("year", F.struct("n", "year")).alias("peak_year"), F.max("n").alias("n"))


def sqrt_share(counts: DataFrame, n: str = "n", output: str = "share") -> DataFrame:
    """Square root of each count's share of the largest count."""
    top = counts.agg(F.max(n).alias("m")).scalar()
    return counts.withColumn(output, F.sqrt(F.col(n) / top))


def file_census(files: DataFrame, path: str = "path", *, keep_unknown: bool = False) -> DataFrame:
    """Files per family with a ``total`` row."""
    counted = files.select(file_family(suffix(path), keep_unknown=keep_unknown).alias("family")).rollup("family").agg(
        F.count("*").alias("n"))
    return counted.select(F.coalesce("family", F.lit("total")).alias("family"), "n")


def corpus_counts(**tables: DataFrame) -> DataFrame:
    """One row with a count per table, each its own scan of no columns."""
    spark = next(iter(tables.values())).sparkSession
    one = spark.range(1)
    return one.select(*[df.agg(F.count("*").alias("n")).scalar().alias(name) for name, df in tables.items()])


def distinct_entities(mentions: DataFrame, *, approximate: bool = False) -> DataFrame:
    if approximate:
        return mentions.agg(F.approx_count_distinct(F.struct(F.lower("text"), "entity_type")).alias("n"))
    return mentions.agg(F.countDistinct(F.lower("text"), F.col("entity_type")).alias("n"))


def corpus_type(documents: DataFrame, tags: str | Column = "tags") -> DataFrame:
    """``email`` when at least half of the documents carry a mail tag, else ``government``."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    share = F.avg(F.coalesce(F.lower(tags).rlike("email|eml"), F.lit(False)).cast("int"))
    return documents.agg(F.when(F.coalesce(share, F.lit(0.0)) >= 0.5, "email").otherwise("government").alias("corpus_type"))


def sample_titles(documents: DataFrame, *, order: str = "doc_id", title: str = "title") -> DataFrame:
    """First six titles longer than 20 characters."""
    return documents.filter(F.length(title) > 20).select(order, title).orderBy(order).limit(6)


# --- entities ---------------------------------------------------------------------------------


def _by_document(mentions: DataFrame, *keys: Column) -> DataFrame:
    """One row per (key, document): distinct documents become plain counts afterwards."""
    return mentions.groupBy(*keys, F.col("doc_id")).agg(F.count("*").alias("_mentions"), spelling().alias("_first"))


def entity_directory(mentions: DataFrame, *, category: str | None = None) -> DataFrame:
    """``(id, name, type, mentions)`` for entities that pass the directory filter, counted by distinct documents."""
    kept = mentions.filter(noise.directory("text") & noise.entity_type_filter(category))
    grouped = _by_document(kept, F.lower("text").alias("id")).groupBy("id").agg(
        F.count("*").alias("mentions"), F.min("_first").alias("first"))
    return grouped.select("id", F.col("first.text").alias("name"), F.upper("first.entity_type").alias("type"), "mentions")


def directory_page(directory: DataFrame, *, offset: int = 0, limit: int = 50) -> DataFrame:
    return directory.orderBy(F.desc("mentions"), "id").offset(offset).limit(limit)


def map_points(mentions: DataFrame, places: DataFrame) -> DataFrame:
    """Location mentions with coordinates from ``places(place, lat, lng)``; unknown places drop out."""
    kept = mentions.filter(noise.location())
    counted = kept.groupBy(F.lower("text").alias("key")).agg(F.count("*").alias("mentions"), F.min("text").alias("location"))
    return geocode(counted, places, name="location").filter(F.col("lat").isNotNull()).select("location", "lat", "lng", "mentions")


def geocode(df: DataFrame, places: DataFrame, *, name: str = "location") -> DataFrame:
    """``lat``/``lng`` by name; a trailing state suffix is taken off for a second try."""
    key = F.trim(F.lower(name))
    known = places.select(F.col("place").alias("_p"), F.struct("lat", "lng").alias("_c"))
    ending = "|".join(s.replace(".", r"\.") for s in V.GEOCODE_SUFFIXES)
    shorter = F.when(key.rlike(f"(?:{ending})$"), F.regexp_replace(key, f"(?:{ending})$", ""))
    direct = df.withColumn("_k", key).join(known, F.col("_k") == F.col("_p"), "left").drop("_p").withColumnRenamed("_c", "_direct")
    second = direct.withColumn("_s", shorter).join(known, F.col("_s") == F.col("_p"), "left").drop("_p")
    place = F.coalesce("_direct", "_c")
    return second.withColumn("lat", place["lat"]).withColumn("lng", place["lng"]).drop("_k", "_s", "_c", "_direct")


def case_persons(mentions: DataFrame, *, limit: int = 12) -> DataFrame:
    """Leading person names, less the names that more documents know as places."""
    persons = mentions.filter((F.col("entity_type") == "PERSON") & noise.case_person("text"))
    pc = _by_document(persons, F.lower("text").alias("key")).groupBy("key").agg(
        F.count("*").alias("n"), F.min("_first.text").alias("name"))
    places = mentions.filter(F.col("entity_type") == "GPE").select(F.lower("text").alias("key"), "doc_id").distinct()
    gc = places.groupBy("key").agg(F.count("*").alias("places"))
    kept = pc.join(gc, "key", "left").filter(F.col("places").isNull() | (F.col("n") > F.col("places")))
    return kept.select("name", F.lit("PERSON").alias("type"), "n").orderBy(F.desc("n"), "name").limit(limit)


def drop_name_variants(names: DataFrame, *, name: str = "name", n: str = "n", keep: int = 8) -> DataFrame:
    """Walk names by count; a name whose words contain or are contained in a kept name's words goes.

    The input is a top list of a dozen rows (``case_persons``), so one small fold settles it.
    """
    listed = F.sort_array(F.collect_list(F.struct((-F.col(n)).alias("o"), F.col(name).alias("name"), F.col(n).alias("n"))))
    kind = names.schema[n].dataType.simpleString()

    def words(text: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(text), "(?U)\\s+"), lambda w: w != ""))

    def covered(a: Column, b: Column) -> Column:
        return F.size(F.array_except(words(a), words(b))) == 0

    empty = F.array().cast(f"array<struct<name:string,n:{kind}>>")
    folded = F.aggregate(listed, empty, lambda kept, x: F.when(
        F.exists(kept, lambda k: covered(x["name"], k["name"]) | covered(k["name"], x["name"])), kept
    ).otherwise(F.concat(kept, F.array(F.struct(x["name"].alias("name"), x["n"].alias("n"))))))
    return names.agg(F.slice(folded, 1, keep).alias("_k")).select(F.explode("_k").alias("_k")).select("_k.*")


def case_top_entities(mentions: DataFrame) -> DataFrame:
    """Eight persons after variant removal, then the four leading organisations and places."""
    persons = drop_name_variants(case_persons(mentions)).select("name", F.lit("PERSON").alias("type"), "n")
    others = mentions.filter(F.col("entity_type").isin("ORG", "GPE") & noise.case("text"))
    grouped = _by_document(others, F.lower("text").alias("key")).groupBy("key").agg(
        F.count("*").alias("n"), F.min("_first").alias("first"))
    top = grouped.select(F.col("first.text").alias("name"), F.col("first.entity_type").alias("type"), "n").orderBy(
        F.desc("n"), "name").limit(4)
    return persons.unionByName(top)


def project_entities(mentions: DataFrame, *, dataset: str = "dataset", per_dataset: int | None = None, limit: int = 30) -> DataFrame:
    """Leading entities of a project, over all entities of its datasets; ``per_dataset`` sums only the best so many of each."""
    kept = mentions.filter(noise.project("text"))
    grouped = _by_document(kept, F.col(dataset), F.col("entity_type").alias("etype"), F.lower("text").alias("key")).groupBy(
        dataset, "etype", "key").agg(F.count("*").alias("docs"), F.min("_first.text").alias("text"))
    if per_dataset is not None:
        order = W.partitionBy(dataset).orderBy(F.desc("docs"), "etype", "key")
        grouped = grouped.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_dataset)
    summed = grouped.groupBy(F.col("etype").alias("type"), F.trim("text").alias("name")).agg(F.sum("docs").alias("doc_count"))
    return summed.orderBy(F.desc("doc_count"), "type", "name").limit(limit)


def entity_detail(persons: DataFrame, document_persons: DataFrame, *, keys: Sequence[str] = ("person_id", "name")) -> DataFrame:
    """One row per (person, document): linked documents stay rows, however many a person has."""
    return persons.select(*keys).join(document_persons.select("person_id", "doc_id").distinct(), "person_id", "left")


# --- projects and runs ------------------------------------------------------------------------


def project_datasets(projects: DataFrame, datasets: DataFrame) -> DataFrame:
    return projects.join(datasets, "project_id")


def project_totals(projects: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets and documents per project; ``datasets(project_id, name, document_count)``."""
    totals = datasets.groupBy("project_id").agg(F.count("*").alias("dataset_count"), F.sum("document_count").alias("total_documents"))
    return projects.join(totals, "project_id", "left").na.fill(0, ["dataset_count", "total_documents"])


def latest_run(runs: DataFrame, *, case: str = "case_id", run: str = "run_id", status: str = "status") -> DataFrame:
    return runs.groupBy(case).agg(F.max_by(status, run).alias("ingest_status"), F.max(run).alias("run_id"))


def run_status(cases: DataFrame, runs: DataFrame, *, case: str = "case_id") -> DataFrame:
    """Status of a case's latest run; without runs ``completed`` if it has documents, else ``never_run``."""
    fallback = F.when(F.coalesce("document_count", F.lit(0)) > 0, "completed").otherwise("never_run")
    return cases.join(latest_run(runs, case=case).select(case, "ingest_status"), case, "left").withColumn(
        "ingest_status", F.coalesce("ingest_status", fallback))


# --- redactions and images --------------------------------------------------------------------


def redaction_rollup(regions: DataFrame) -> DataFrame:
    """Regions per document by class."""
    kind = F.col("classification")
    return regions.groupBy("doc_id").agg(
        F.count("*").alias("total_redactions"),
        F.count_if(kind == "proper").alias("proper"),
        F.count_if(kind == "bad_overlay").alias("bad_overlay"),
        F.count_if(kind == "recoverable").alias("recoverable"),
    )


def recovered_texts(regions: DataFrame) -> DataFrame:
    """Texts found under recoverable redactions, one row each, so that a document may hold any number."""
    found = (F.col("classification") == "recoverable") & (F.coalesce("recovered_text", F.lit("")) != "")
    return regions.filter(found).select("doc_id", "page", F.col("recovered_text").alias("text"))


def redaction_totals(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.count("*").alias("files"), F.sum("total_redactions").alias("total_redactions"),
                      F.sum("recoverable").alias("recoverable"))


def image_verdict(min_size: int = 50, min_bytes: int = 5120, scan_ratio: float = 0.8) -> Column:
    """``small``, ``page_scan`` or ``kept`` from width, height, size_bytes, page_width, page_height."""
    page_area = F.col("page_width") * F.col("page_height")
    small = (F.col("width") < min_size) | (F.col("height") < min_size) | (F.col("size_bytes") < min_bytes)
    scan = F.coalesce(F.col("width") * F.col("height") / F.nullif(page_area, F.lit(0)) > scan_ratio, F.lit(False))
    return F.when(small, "small").when(scan, "page_scan").otherwise("kept")


def keep_images(images: DataFrame, **rules: float) -> DataFrame:
    return images.filter(image_verdict(**rules) == "kept")


def image_tallies(images: DataFrame, **rules: float) -> DataFrame:
    verdict = image_verdict(**rules)
    return images.agg(F.count_if(verdict == "kept").alias("new"), F.count_if(verdict == "small").alias("skipped_small"),
                      F.count_if(verdict == "page_scan").alias("skipped_pagescan"))


def merge_descriptions(images: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved descriptions put back on (document, page, index) where the image has none."""
    on = ["doc_id", "page_number", "image_index"]
    found = saved.select(*on, F.nullif("description", F.lit("")).alias("_saved"))
    return images.join(found, on, "left").withColumn("description", F.coalesce("_saved", "description")).drop("_saved")

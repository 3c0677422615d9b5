"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """``mapInArrow`` for row-wise work: ``make()`` runs once per task, its result turns a batch into column lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            # a piece of the batch at a time, so that lists of long texts stay small
            for at in range(0, batch.num_rows, 1024):
                arrays = [a if isinstance(a, pa.Array) else pa.array(a[0], a[1]) for a in work(batch.slice(at, 1024))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = df.sparkSession.createDataFrame([], schema).columns
    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    folder = f"{work_folder(df.sparkSession, name)}/rows"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, shared_folder  # noqa: F401

#: Words of the contracts: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that one of our own steps wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def crc32_mod(column, n: int):
    """crc32 of an integer's decimal text, modulo n; a null id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null"))), F.lit(n))


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: about max_bytes of ``column`` each, so that Python objects stay few."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index(column)
        each = max(1, int(batch.num_rows * max_bytes / max(1, batch.column(at).nbytes)))
        for i in range(0, batch.num_rows, each):
            yield batch.slice(i, each)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that the operator is about to set itself (case-insensitively, as Spark resolves names)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])

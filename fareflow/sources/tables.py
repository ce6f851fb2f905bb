"""Readers and writers: conforming to a schema, ordered fallbacks, partitioned output, run reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def conform(df: DataFrame, schema: StructType, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The schema's columns, found whatever their case or under the first alias that the table has. Absent columns are null, others
    go, and values that can't be read as the type become null."""
    have = {c.lower(): c for c in df.columns}

    def pick(field):
        names = [field.name, *(aliases or {}).get(field.name, ())]
        found = next((have[n.lower()] for n in names if n.lower() in have), None)
        if found is None:
            return F.lit(None).cast(field.dataType).alias(field.name)
        return F.col(f"`{found}`").try_cast(field.dataType).alias(field.name)

    return df.select(*[pick(f) for f in schema.fields])


def first_source(spark: SparkSession, candidates: Sequence[tuple[str, str]], schema: StructType | None = None) -> DataFrame:
    """The first (format, path) that Spark can read; paths may be globs. An error names all that were tried."""
    for kind, path in candidates:
        reader = spark.read.format(kind)
        if kind == "csv":
            reader = reader.option("header", True)
        if schema is not None:
            reader = reader.schema(schema)
        try:
            df = reader.load(path)
        except AnalysisException:
            continue
        return df
    raise FileNotFoundError(f"none of {[p for _, p in candidates]} can be read")


def read_folder(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder, its partitions (``year=2024/...``) included. recursive: files of any subfolders, whatever their names; those give no columns then."""
    reader = spark.read.option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", True).parquet(path) if recursive else reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_months(spark: SparkSession, path: str, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Files partitioned by year and month, from one month to another: only their folders are read."""
    month = F.col("year") * 100 + F.col("month")
    return spark.read.parquet(path).where(month.between(first[0] * 100 + first[1], last[0] * 100 + last[1]))


def monthly(df: DataFrame, time: str) -> DataFrame:
    """df with the partition columns year and month."""
    return df.withColumns({"year": F.year(time), "month": F.month(time)})


def write_single(df: DataFrame, path: str) -> None:
    """One Parquet file: for results that are small by nature."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def up_to_date(found: DataFrame, known: DataFrame) -> DataFrame:
    """One row: whether two tables of snapshots hold the same set, and how many are new or gone."""
    a, b = found.distinct().withColumn("_f", F.lit(1)), known.distinct().withColumn("_k", F.lit(1))
    same = F.lit(True)
    for c in found.columns:
        same = same & a[c].eqNullSafe(b[c])
    joined = a.join(b, same, "full") if found.columns else a
    counts = joined.agg(F.count_if(F.col("_k").isNull()).alias("n_new"), F.count_if(F.col("_f").isNull()).alias("n_gone"))
    return counts.select(((F.col("n_new") == 0) & (F.col("n_gone") == 0)).alias("fresh"), "n_new", "n_gone")


def zip_arrays(payload: DataFrame, columns: Mapping[str, str], body: str = "body") -> DataFrame:
    """Rows from JSON with parallel arrays, as weather services send them. columns: name to element type."""
    kind = "struct<hourly: struct<" + ", ".join(f"{c}: array<{t}>" for c, t in columns.items()) + ">>"
    parsed = payload.select(F.from_json(body, kind).alias("p"))
    return parsed.select(F.explode(F.arrays_zip(*[F.col(f"p.hourly.{c}") for c in columns])).alias("r")).select("r.*")


def latest_snapshot(index: DataFrame, pattern: str, page: str = "html") -> DataFrame:
    """The newest dated link of a pattern with one date group (ISO) in a page of links."""
    links = index.select(F.explode(F.regexp_extract_all(page, F.lit(f"({pattern})"), 1)).alias("link"))
    dated = links.withColumn("snapshot", F.regexp_extract("link", pattern, 1).try_cast("date")).where("snapshot is not null")
    return dated.agg(F.max("snapshot").alias("snapshot"), F.max_by("link", F.struct("snapshot", "link")).alias("link"))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Overwrites only the partitions that df has rows of, so a rerun doesn't double them. Each partition's rows are gathered
    first, split where they are many, so that files are few and no task writes to all partitions."""
    missing = [c for c in by if c not in df.columns]
    if missing:
        raise ValueError(f"no partition column {missing}")
    df.hint("rebalance", *by).write.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy(*by).parquet(path)


def missing_partitions(df: DataFrame, existing: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of partitions that aren't there yet."""
    return df.join(existing.select(*by).distinct(), list(by), "left_anti")


def audit(df: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Rows and set flags by key: the report of a run."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.sum(F.col(f)).alias(f"n_{f}") for f in flags])


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    writer = report.write.mode("overwrite").format(kind)
    (writer.option("header", True) if kind == "csv" else writer).save(path)

"""File sources and sinks: JSON lines, CSV, Parquet, packaged result sets."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from grainsift.session import shared_folder

CORRUPT = "_corrupt_record"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:10]}"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType | str) -> DataFrame:
    """Strict scan; a malformed line fails the query, blank lines are skipped. Paths may be globs."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def read_jsonl_tolerant(spark: SparkSession, paths: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(well-formed rows, malformed lines)."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def with_file_order(df: DataFrame) -> DataFrame:
    """H6: adds file and ord, a key that orders rows of a line-wise scan within each file."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))


def read_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """CSV with a header, quoted fields over several lines included."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(paths)


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document per file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def write_jsonl(df: DataFrame, path: str, *, append_new_by: str | None = None) -> None:
    """K1, K2: overwrite, or append only rows whose key is not there yet, so that a repeated run adds nothing."""
    if append_new_by is None:
        df.write.mode("overwrite").json(path)
        return
    spark = df.sparkSession
    try:
        old = spark.read.schema(df.select(append_new_by).schema).json(path)
        df = df.join(old, append_new_by, "left_anti")
    except Exception as e:  # noqa: BLE001 - the first run has nothing to read
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").json(path)


def write_parquet(df: DataFrame, path: str, *, json_columns: Sequence[str] = (), by: Sequence[str] = ()) -> None:
    """K3, K7: Parquet, nested columns as JSON text on request, partitioned on request."""
    w = df.withColumns({c: F.to_json(c) for c in json_columns}).write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K4: CSV with a header; nested columns must be flattened before."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def numbered(df: DataFrame, order: Sequence[str], pattern: str, start: int = 0) -> DataFrame:
    """K5: generated ids such as item_00042 in the given order (nulls last), without a global window: a range sort and the sizes of its parts.

    Places in the parts are written to the shared folder first. Sizes and rows must be of one sort, as the cuts and the
    joined parts of a second one differ.
    """
    spark, path, by = df.sparkSession, scratch(df.sparkSession, "numbered"), [F.col(c).asc_nulls_last() for c in order]
    df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    ranged = spark.read.parquet(path).withColumn("_p", F.shiftright("_m", 33))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    base = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    place = F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1) + start  # base has one row for each part
    return ranged.join(F.broadcast(base), "_p").withColumn("id", F.format_string(pattern, place)).drop("_p", "_m", "_b")


def quarantine(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """K8: (kept rows, removed rows with quarantine_reason); together they are the input."""
    marked = df.withColumn("quarantine_reason", reason)
    return marked.where("quarantine_reason IS NULL").drop("quarantine_reason"), marked.where("quarantine_reason IS NOT NULL")


def blind_sheets(df: DataFrame, order: Sequence[str], shown: Sequence[str], hidden: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """An annotation sheet and its key, sharing row_id."""
    rows = numbered(df, order, "%d", 1).withColumnRenamed("id", "row_id")
    return rows.select("row_id", *shown), rows.select("row_id", *hidden)


def result_set(per_task: DataFrame, summary: DataFrame, aggregated: DataFrame, traces: DataFrame, folder: str) -> None:
    """K6: the four parts of a result set."""
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")  # one row
    write_csv(per_task, f"{folder}/per_task")
    write_csv(aggregated, f"{folder}/aggregated")
    write_jsonl(traces, f"{folder}/traces")


def embedding_cache_misses(docs: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """Rows whose text has no cached embedding, matched on a hash of the text rather than on row counts."""
    return docs.withColumn("text_hash", F.sha2(text, 256)).join(cache.select("text_hash"), "text_hash", "left_anti")

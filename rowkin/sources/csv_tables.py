"""Bronze ingest of CSV files: every column stays text, a blank field stays blank."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the source files.
CRM_COLUMNS = ("crm_id", "first_name", "last_name", "email", "phone", "birth_date", "address", "city", "updated_at")
BILLING_COLUMNS = ("billing_id", "full_name", "email", "phone", "billing_address", "city", "updated_at")
TRUTH_COLUMNS = ("entity_key", "true_entity_id", "split")


CORRUPT = "_corrupt_record"


def _reader(spark: SparkSession, columns: tuple[str, ...], header: bool) -> DataFrameReader:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    return spark.read.schema(schema).option("header", header).option("multiLine", True).option("escape", '"').option("enforceSchema", False)


def _finished(rows: DataFrame, columns: tuple[str, ...], stamp: bool) -> DataFrame:
    rows = rows.na.fill("", list(columns))
    return rows.withColumn("_ingested_at", F.current_timestamp()) if stamp else rows


def read_text_csv(spark: SparkSession, path: str, columns: tuple[str, ...], stamp: bool = True) -> DataFrame:
    """Read ``path`` with a declared all-text schema, optionally with the time of ingestion."""
    return _finished(_reader(spark, columns, True).csv(path), columns, stamp)


def read_checked_csv(spark: SparkSession, path: str, columns: tuple[str, ...], stamp: bool = True,
                     header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): rows with as many fields as columns, and the others as they stand.

    The quarantine has ``file`` and ``record``, the raw text of a row with too few or too many
    fields. A quote that is never closed takes the rest of its file into one such record. Every
    record is in one of the two; both read all columns, since a pruned scan does not count fields.
    """
    marked = T.StructType([T.StructField(name, T.StringType()) for name in (*columns, CORRUPT)])
    read = _reader(spark, columns, header).schema(marked).option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)
    # Always true; Spark refuses to scan the raw text without any other column.
    read = read.where(F.length(F.coalesce(columns[0], F.lit(""))) >= 0)
    rows = _finished(read.where(F.col(CORRUPT).isNull()).drop(CORRUPT), columns, stamp)
    odd = read.where(F.col(CORRUPT).isNotNull())
    return rows, odd.select(F.col("_metadata.file_path").alias("file"), F.col(CORRUPT).alias("record"))


def write_text_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)

"""File scans and sinks.

CSV is read with an explicit schema (no inference pass); gzip is handled by the
codec from the file extension.  Plain files are split among tasks; only files
with quoted line breaks need ``multiline``, which reads a file in one task.
Sinks write Parquet (or CSV) with ``mode('overwrite')``; written tables live
under the shared folder named by ``spark.checkpoint.dir``, never a
machine-local temp folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodgelens.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def scan_csv(spark: SparkSession, path, schema: StructType | str, header: bool = True,
             multiline: bool = False) -> DataFrame:
    """CSV (optionally .gz) with a declared schema."""
    return (spark.read.schema(schema).option("header", header).option("multiLine", multiline)
            .option("escape", '"').option("mode", "PERMISSIVE").csv(path))


def scan_snapshots(spark: SparkSession, paths, schema: StructType | str, date_pattern: str = r"(\d{4}-\d{2}-\d{2})"
                   ) -> DataFrame:
    """Several snapshot files in one scan, the snapshot date taken from
    each row's file name."""
    df = scan_csv(spark, paths, schema)
    return df.withColumn("snapshot", F.to_date(F.regexp_extract(F.input_file_name(), date_pattern, 1)))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Parquet sink (optionally partitioned, e.g. the panel by month)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None) -> str:
    """CSV sink with a header, no index column, quotes doubled as
    ``scan_csv`` reads them."""
    w = (df.write.mode("overwrite").option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def sources_present(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """G1: (source, present) for named Parquet sources.  Only their schema is
    looked up; any other failure than a missing path is raised."""
    from pyspark.errors import AnalysisException

    def there(path: str) -> bool:
        try:
            spark.read.parquet(path).schema
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True
    return spark.createDataFrame([(n, there(p)) for n, p in paths.items()], "source string, present boolean")


def decode_list_text(c) -> "F.Column":
    """Python-literal list text "['a', 'b']" -> array<string>; null or
    unparsable -> empty array."""
    col = F.col(c) if isinstance(c, str) else c
    quoted = F.regexp_extract_all(col, F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""), F.lit(0))
    bare = F.transform(quoted, lambda x: F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    return F.coalesce(bare, F.array().cast("array<string>"))

"""Helpers shared by the operators: tables, checkpoint tables, folds and word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python regular expression of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only in local mode, where one
    process does everything, an unset folder is replaced by a temporary one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return spark.conf.get("spark.checkpoint.dir")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut,
    row ids made by it are fixed, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_with_id(docs: DataFrame) -> DataFrame:
    """(rid, row): a row id fixed by writing, and all columns of docs nested in ``row``,
    so that no column of theirs can clash with one that an operator adds."""
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "rows")


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(4))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that nothing may be learnt from; false for a null id."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def words(text: Column) -> Column:
    """Words of a text, JVM-side; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True if df has at most max_rows rows, found without reading more than that."""
    return df.limit(max_rows + 1).count() <= max_rows

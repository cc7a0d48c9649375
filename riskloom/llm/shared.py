"""Small helpers of the operators: tables, stored intermediate results, batch sizes, column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import enable_checkpoints, staged

ROWS_PER_BATCH = 256
WORD = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches sent to Python workers; texts can be long, so few rows go at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; later plans start from the files."""
    return staged(df, name)


def checkpointed(df: DataFrame) -> DataFrame:
    enable_checkpoints(df.sparkSession)
    return df.checkpoint()


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def keyed_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text (null becomes empty); other columns, whatever their names, stay outside."""
    require(df, (key, text))
    return df.select(df[key].alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, without empty entries."""
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")

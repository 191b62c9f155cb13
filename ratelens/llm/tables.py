"""Input and output shapes that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ratelens.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, row): the id as a long, the text with null as empty, and all columns
    but the text as one struct, so that extra columns clash with nothing."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.struct(*others).alias("row"))


def result_schema(rows: DataFrame, **columns: DataType) -> StructType:
    """``row`` as it came, and the columns that an operator adds."""
    return StructType([rows.schema["row"], *(StructField(n, t) for n, t in columns.items())])


def restored(result: DataFrame, like: DataFrame, **replaced) -> DataFrame:
    """The columns of ``like``, in their order, some of them replaced."""
    return result.select(*(replaced[c].alias(c) if c in replaced else F.col(f"row.`{c}`").alias(c) for c in like.columns))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, as they are, whose id is not among ``gone``, a table of one
    column. The rows are one struct in the join, so that their names clash with nothing."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("key"))
    return rows.join(gone.toDF("key"), "key", "left_anti").select("row.*")

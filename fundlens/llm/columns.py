"""Names of columns that may be anything: quoted, and new ones that clash with none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def all_of(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as the struct ``row``."""
    return F.struct(*all_of(df)).alias("row")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in columns]


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it if it is taken; Spark ignores case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` by position, for columns of any names: dots in them would be read as fields."""
    place = [f"c{i}" for i in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work(batches):
            yield batch.rename_columns(place)

    safe = T.StructType([T.StructField(p, f.dataType) for p, f in zip(place, schema)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(renamed, safe).toDF(*schema.fieldNames())

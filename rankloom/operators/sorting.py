"""Sorts by fields of a struct value. Ties keep insertion order; a missing or unsortable field is an error at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

from rankloom.operators.frame import POS

SORTABLE = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, StringType, DecimalType)


@dataclass(frozen=True)
class OrderBy:
    field: str
    descending: bool = False


def order_columns(df: DataFrame, order: list[OrderBy]) -> list:
    kind = df.schema["value"].dataType
    if not isinstance(kind, StructType):
        raise TypeError("values must be structs to be sorted by field")
    out = []
    for o in order:
        if o.field not in kind.fieldNames():
            raise ValueError(f"no field {o.field!r}")
        if not isinstance(kind[o.field].dataType, SORTABLE):
            raise TypeError(f"field {o.field!r} can't be sorted")
        c = F.col("value").getField(o.field)
        out.append(c.desc() if o.descending else c.asc())
    return [*out, F.col(POS).asc()]


def sort_by_field(df: DataFrame, order: OrderBy) -> DataFrame:
    return sort_by_fields(df, [order])


def sort_by_fields(df: DataFrame, order: list[OrderBy]) -> DataFrame:
    return df.orderBy(*order_columns(df, order))

"""Schemas of this package's tables, made without a running session, as workers need them."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

KINDS = {"long": LongType, "int": IntegerType, "string": StringType, "boolean": BooleanType, "double": DoubleType}


def _kind(name: str) -> DataType:
    return ArrayType(_kind(name[6:-1])) if name.startswith("array<") else KINDS[name]()


def struct_of(columns: str) -> StructType:
    """The schema of ``name type, name type`` with the kinds above and arrays of them."""
    return StructType([StructField(name, _kind(kind)) for name, kind in (c.split() for c in columns.split(", "))])

"""Element types: Python types and annotations to Spark types."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import types
import typing

from pyspark.sql import types as T

#: Sizes that Python's own types do not tell apart.
NAMED = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "complex64": T.StructType([T.StructField("re", T.FloatType()), T.StructField("im", T.FloatType())]),
    "complex128": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
    "time": T.TimestampType(),
    "duration": T.DayTimeIntervalType(),
}
PLAIN = {
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    complex: NAMED["complex128"],
    str: T.StringType(),
    bytes: T.BinaryType(),
    bytearray: T.BinaryType(),
    datetime.datetime: T.TimestampType(),
    datetime.date: T.DateType(),
    datetime.timedelta: T.DayTimeIntervalType(),
    decimal.Decimal: T.DecimalType(38, 18),
}


def spark_type(of: object) -> T.DataType:
    """The Spark type of a Python type, annotation, dataclass, or size name.

    ``X | None`` is X (every Spark column may be null); lists, dicts and dataclasses
    become arrays, maps and structs.  A type without a counterpart raises ``TypeError``.
    """
    if isinstance(of, T.DataType):
        return of
    if isinstance(of, str):
        if of in NAMED:
            return NAMED[of]
        raise TypeError(f"unknown element type {of!r}")
    if of in PLAIN:
        return PLAIN[of]
    origin, args = typing.get_origin(of), typing.get_args(of)
    if origin in (typing.Union, types.UnionType):
        inner = [a for a in args if a is not type(None)]
        if len(inner) == 1:
            return spark_type(inner[0])
    if origin in (list, tuple, set) and args:
        return T.ArrayType(spark_type(args[0]))
    if origin is dict:
        return T.MapType(spark_type(args[0]), spark_type(args[1]))
    if dataclasses.is_dataclass(of):
        hints = typing.get_type_hints(of)
        return T.StructType([T.StructField(f.name, spark_type(hints[f.name])) for f in dataclasses.fields(of)])
    raise TypeError(f"no Spark type for {of!r}")


def key_type(of: T.DataType) -> T.DataType:
    """Check that a type can be grouped by: maps cannot."""
    if isinstance(of, T.MapType):
        raise TypeError("a map cannot be a key")
    if isinstance(of, T.StructType):
        for field in of:
            key_type(field.dataType)
    if isinstance(of, T.ArrayType):
        key_type(of.elementType)
    return of

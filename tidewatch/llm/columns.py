"""Carrying the input's columns through tasks, whatever their names.

Names may hold blanks, dots, colons and backticks.  Names that differ in case only are
ambiguous to Spark itself, unless the session tells cases apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_row(names: Sequence[str]) -> Column:
    """The columns as a struct, row."""
    return F.struct(*[F.col(quoted(c)) for c in names]).alias("row")


def with_row(rows: DataFrame, ddl: str) -> StructType:
    """The schema of a result: the rows' column ``row`` and further columns."""
    return StructType([StructField("row", rows.schema["row"].dataType), *StructType.fromDDL(ddl).fields])


def with_id(docs: DataFrame, ddl: str, name: str = "doc_id") -> StructType:
    """The schema of a result: the documents' id and further columns."""
    return StructType([StructField(name, docs.schema[name].dataType), *StructType.fromDDL(ddl).fields])

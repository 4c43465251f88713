"""Writers, and the guards that keep labels out of what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of label fields that no input or output may hold.
FORBIDDEN = ["root_cause", "root_cause_node", "root_cause_diagram", "root_cause_pattern", "impacted_nodes", "impacted_diagrams", "impact_paths", "expected_behavior", "label_is_root"]


def field_names(kind: T.DataType) -> list[str]:
    """All names in a schema, at any depth."""
    if isinstance(kind, T.StructType):
        return [n for f in kind for n in (f.name, *field_names(f.dataType))]
    if isinstance(kind, T.ArrayType):
        return field_names(kind.elementType)
    if isinstance(kind, T.MapType):
        return field_names(kind.keyType) + field_names(kind.valueType)
    return []


def guarded(df: DataFrame, forbidden: list[str] | None = None) -> DataFrame:
    """``df``, if its schema holds none of the forbidden names."""
    bad = sorted(set(field_names(df.schema)) & set(FORBIDDEN if forbidden is None else forbidden))
    if bad:
        raise ValueError(f"label fields in the output: {', '.join(bad)}")
    return df


def stripped(df: DataFrame, forbidden: list[str] | None = None) -> DataFrame:
    return df.drop(*(FORBIDDEN if forbidden is None else forbidden))


def required(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def json_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def csv(df: DataFrame, path: str) -> None:
    """Rows with a header; nested columns as JSON text."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Nested columns stay nested."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def text_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)

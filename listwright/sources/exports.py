"""Writing the curated table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType


def _flat(df: DataFrame) -> DataFrame:
    """Lists of text joined by a pipe, other nested values as JSON text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType):
            c = F.concat_ws("|", c)
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def table_export(df: DataFrame, path: str, fmt: str) -> None:
    """Writes CSV, JSON lines or Parquet."""
    if fmt == "csv":
        _flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt in ("json", "parquet"):
        df.write.mode("overwrite").format(fmt).save(path)
    else:
        raise ValueError(f"unknown format: {fmt}")

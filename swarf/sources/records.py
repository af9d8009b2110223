"""Record tables in CSV, Parquet, JSON and JSON-lines form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

FORMATS = ("csv", "parquet", "json", "jsonl")


def read_records(spark: SparkSession, path: str, fmt: str, schema: StructType | str | None = None, nested: dict[str, str] | None = None) -> DataFrame:
    """Read records; ``nested`` maps text columns to the type their JSON cells hold.

    CSV columns are text unless a schema is given; ``json`` is an array document, ``jsonl`` one per line.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown record format {fmt!r}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        out = reader.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    elif fmt == "parquet":
        out = reader.parquet(path)
    else:
        out = reader.option("multiLine", fmt == "json").json(path)
    return decode_cells(out, nested or {})


def decode_cells(df: DataFrame, nested: dict[str, str]) -> DataFrame:
    """Parse text cells that start with a bracket; other cells become null in the typed column."""
    typed = lambda c, t: F.when(F.col(c).rlike(r"^[\[{]"), F.from_json(c, t))
    return df.withColumns({c: typed(c, t) for c, t in nested.items()}) if nested else df


def encode_cells(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for flat file formats."""
    complex_types = (ArrayType, MapType, StructType)
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, complex_types)]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def write_records(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write records through Spark's output committer: readers see all of a table or the old one."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown record format {fmt!r}")
    writer = (encode_cells(df) if fmt == "csv" else df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        writer.json(path)


def truthy(column: str):
    """Text flags of CSV records: 1, true and yes."""
    return F.lower(F.col(column).cast(StringType())).isin("1", "true", "yes")

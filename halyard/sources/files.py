"""Files as sources and sinks, and records as rows.

Parquet is the native format; JSON lines, CSV and ORC are read and written too. A record has an id, a vector and metadata, which
come as typed columns, as a map or as JSON (then a variant column, whose fields predicates address as column.key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from halyard.contract import InvalidConfig

FORMATS = ("parquet", "json", "csv", "orc")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | StructType | None = None) -> DataFrame:
    if format not in FORMATS:
        raise InvalidConfig(f"unknown format {format!r}")
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), bloom_on: tuple[str, ...] = ()) -> None:
    """CSV has no arrays: they are written as JSON texts. Parquet files get Bloom filters on the columns bloom_on, for lookups by id."""
    if format not in FORMATS:
        raise InvalidConfig(f"unknown format {format!r}")
    if format == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    writer = df.write.format(format).mode(mode)
    if format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if format == "parquet":
        for c in bloom_on:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_bucketed(df: DataFrame, table: str, id: str, buckets: int) -> None:
    """A table bucketed and sorted by id: joins and upserts on id then need no shuffle of it."""
    df.write.mode("overwrite").bucketBy(buckets, id).sortBy(id).saveAsTable(table)


def with_variant(df: DataFrame, column: str) -> DataFrame:
    """A JSON text column as a variant; a text that is no JSON is null."""
    return df.withColumn(column, F.try_parse_json(F.col(column)))


def records(df: DataFrame, id: str, vector: str, metadata: list[str] | None = None) -> DataFrame:
    """Any frame as records: id as text, vector as floats, and the metadata columns."""
    rest = metadata if metadata is not None else [c for c in df.columns if c not in (id, vector)]
    return df.select(F.col(id).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"), *rest)


def record_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text, as on the wire."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def from_record_json(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    return df.select(F.from_json(column, schema).alias("r")).select("r.*")

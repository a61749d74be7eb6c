"""LOAD DATA and EXPORT DATA: Parquet, JSON lines and CSV files to and from DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("PARQUET", "JSON", "NEWLINE_DELIMITED_JSON", "CSV")


def load(spark: SparkSession, uris: list[str], kind: str, schema: StructType, delimiter: str = ",", skip_rows: int = 0, null_marker: str = "") -> DataFrame:
    """Files as rows of ``schema``: Parquet and JSON by name (case ignored), CSV by position, short rows padded."""
    kind = kind.upper()
    if kind not in FORMATS:
        raise ValueError(f"format {kind} is not supported")
    if kind == "PARQUET":
        df = spark.read.parquet(*uris)
        have = {c.lower(): c for c in df.columns}
        return df.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    if kind != "CSV":
        return spark.read.schema(schema).json(uris)
    reader = spark.read.schema(schema).option("sep", delimiter).option("nullValue", null_marker).option("mode", "PERMISSIVE")
    if skip_rows <= 1:
        return reader.option("header", bool(skip_rows)).csv(uris)
    # Spark skips one header line per file; more are dropped by their number within the file.
    lines = spark.read.text(uris, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where((F.col("n") >= skip_rows) & (F.col("line") != ""))
    row = F.from_csv("line", F.lit(schema.simpleString()[7:-1].replace(":", " ")), {"sep": delimiter, "nullValue": null_marker})
    return lines.select(row.alias("r")).select("r.*")


def export(df: DataFrame, uri: str, kind: str, overwrite: bool = False, header: bool = True, delimiter: str = ",") -> None:
    """A query's rows as files; a cloud scheme without a connector fails instead of doing nothing."""
    kind = kind.upper()
    if kind not in FORMATS:
        raise ValueError(f"format {kind} is not supported")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if kind == "PARQUET":
        writer.parquet(uri)
    elif kind == "CSV":
        writer.option("header", header).option("sep", delimiter).csv(uri)
    else:
        writer.json(uri)

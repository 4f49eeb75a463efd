"""Settings that lie in files, one a shop or one for all: read as tables, so that they join like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, schema: str, code: str = "code", glob: str = "*.json") -> DataFrame:
    """A row for each JSON file below the path, whatever lines it spans, with its name in _file. Files that are no JSON
    object, or whose code is empty, are left out; of several with one code the last by name counts. Fields that the schema
    does not have are ignored, missing ones are null."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select("value", F.col("_metadata.file_path").alias("_file"))
    read = raw.withColumn("_row", F.from_json("value", schema)).filter(F.ltrim("value").startswith("{")).select("_row.*", "_file").filter(F.coalesce(F.col(code) != "", F.lit(False)))
    others = [c for c in read.columns if c != code]
    return read.groupBy(code).agg(F.max_by(F.struct(*others), "_file").alias("_v")).select(code, "_v.*")


def with_settings(rows: DataFrame, settings: DataFrame, code: str, columns: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Rows with columns of the settings of their code; where the code has none, or a column is null, the default."""
    joined = rows.join(settings.select(code, *(F.col(c).alias(f"_s_{c}") for c in columns)), code, "left")
    value = lambda c: F.coalesce(f"_s_{c}", F.lit((defaults or {}).get(c)))
    return joined.withColumns({c: value(c) for c in columns}).drop(*(f"_s_{c}" for c in columns))


def enabled(settings: DataFrame, flag: str = "enabled") -> Column:
    """A shop without the flag is on."""
    return F.coalesce(settings[flag], F.lit(True))

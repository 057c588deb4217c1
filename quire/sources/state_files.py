"""Stored state as tables: JSON lists of checkpoints and history rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "SourcePath string, Status string, Progress int, UnitIndex int, SubUnitIndex int, ErrorMessage string, UpdatedAt timestamp"
HISTORY = "Timestamp timestamp, SourcePath string, OutputPath string, ProviderType string, Model string, Status string, Progress int, DurationSeconds double, ErrorMessage string"


def read_state(spark: SparkSession, path: str, schema: str = CHECKPOINT) -> DataFrame:
    """Rows of a JSON list; a missing file, and one that is no JSON, is an empty table. Absent fields are null, others are left out."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)

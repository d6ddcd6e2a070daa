"""Label files as they arrive. The batch engine has no streaming semantics to match; this is its label loop, incremental."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.io import RESULTS


def read_label_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """(pair_id, verdict, file, arrived): valid rows of new result files; arrived is the file's time."""
    raw = spark.readStream.schema(RESULTS).option("header", True).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).csv(path)
    rows = raw.select(F.expr("try_cast(pair_id AS bigint)").alias("pair_id"), F.expr("try_cast(verdict AS int)").alias("verdict"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("arrived"))
    return rows.filter(F.col("pair_id").isNotNull() & F.col("verdict").isin(0, 1))


def first_verdicts(stream: DataFrame, within: str | None = None) -> DataFrame:
    """Each pair's verdict once: the one that arrives first; within a trigger any of them.

    With ``within``, for example "30 days", a pair is remembered for that long after its file's time, which bounds the state; without
    it the state holds every pair id, as label sets are far smaller than the corpus.
    """
    if within is None:
        return stream.dropDuplicates(["pair_id"])
    return stream.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["pair_id"])


def score_stream(stream: DataFrame, items: DataFrame) -> DataFrame:
    """Arriving pairs joined with the static catalogue."""
    return stream.join(items, "item_id", "left")

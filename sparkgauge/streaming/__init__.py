"""Reports for a stream of documents. A report depends on its document alone, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.plans.analyze import analyze


def read_document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, content) of the files that arrive in ``folder``."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def analyze_stream(docs: DataFrame, criteria: dict | None = None, preset: str | None = None, **options) -> DataFrame:
    """analyze() of a streaming ``docs``; write it with any sink in append mode."""
    return analyze(docs, criteria, preset, **options)

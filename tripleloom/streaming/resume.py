"""Incremental classification: what arrived since the last run, each record once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripleloom.operators.classification import classify, remaining
from tripleloom.sources.readers import SAMPLE, records, write_json


def resume(spark: SparkSession, samples: DataFrame, path: str, make, first: bool = False) -> None:
    """Classify the samples whose id has no record yet and append the records."""
    todo = samples if first else remaining(samples, records(spark, path))
    write_json(classify(todo, make), path, "append")


def follow(spark: SparkSession, folder: str, path: str, checkpoint: str, make):
    """Classify JSON lines of samples as files arrive in a folder; stops when all present files are done."""
    stream = classify(spark.readStream.schema(SAMPLE).json(folder), make)
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Facts kept up to date by a stream of re-analysed files.

Each micro-batch of a file source holds the fresh facts of changed files; the
batch replaces the facts of its (analyzer, file) pairs. A batch writes a new
version of the table and then its number, so a batch that runs again after a
failure starts from the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "analyzer string, subject_id string, fact_type string, source_file string, value string"


def replace_scope(facts: DataFrame, fresh: DataFrame) -> DataFrame:
    """The facts without those of any (analyzer, file) in ``fresh``, and ``fresh``."""
    scope = fresh.select("analyzer", "source_file").distinct()
    return facts.join(scope, ["analyzer", "source_file"], "left_anti").select(*facts.columns).unionByName(fresh.select(*facts.columns))


def version(spark: SparkSession, table: str, number: int) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{table}/v{number}")


def keep_current(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Runs over the files in ``source`` once, batch by batch; version 0 is the table before the first batch."""

    def apply(batch: DataFrame, number: int) -> None:
        before = version(batch.sparkSession, table, number)
        replace_scope(before, batch).write.mode("overwrite").parquet(f"{table}/v{number + 1}")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

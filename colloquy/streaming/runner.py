"""Running a stream to the end of its present input into the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.session import staging_path


def read_table_stream(spark: SparkSession, sf_dir: str, table: str,
                      files_per_trigger: int = 64) -> DataFrame:
    """A stream over one Parquet table of a folder of tables."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # a glob finds the table whether it is one file or a folder of them
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger)
            .parquet(f"{sf_dir}/{table}.parque[t]"))


def drain_append(stream: DataFrame, name: str,
                 check: Callable[[SparkSession, str], None] | None = None) -> DataFrame:
    """Run an append-mode stream until its input is used up, into Parquet.

    ``check`` gets the session and the folder of the stream's state at the end.
    """
    spark = stream.sparkSession
    path = staging_path(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{path}-state")
             .trigger(availableNow=True).start(path))
    query.awaitTermination()
    if check and spark.read.format("binaryFile").load(f"{path}-state/offsets").count():
        check(spark, f"{path}-state")
    return spark.read.schema(stream.schema).parquet(path)


def _raise_on_dropped(query: StreamingQuery) -> None:
    """Raise if the watermark has dropped rows in one of the last batches."""
    for progress in query.recentProgress:
        for operator in progress["stateOperators"]:
            if operator.get("numRowsDroppedByWatermark", 0):
                raise ValueError(f"rows later than the watermark in batch "
                                 f"{progress['batchId']}; choose a longer delay")


def drain_update(stream: DataFrame, name: str) -> DataFrame:
    """Run an update-mode stream likewise; every row carries its ``batch``.

    A batch overwrites its own folder, so a repeated batch counts once. Rows that
    come too late for the watermark fail the run.
    """
    spark = stream.sparkSession
    path = staging_path(spark, name)
    running: list[StreamingQuery] = []

    def write(rows: DataFrame, batch: int) -> None:
        for query in running:
            _raise_on_dropped(query)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    running.append(stream.writeStream.foreachBatch(write).outputMode("update")
                   .option("checkpointLocation", f"{path}-state")
                   .trigger(availableNow=True).start())
    running[0].awaitTermination()
    _raise_on_dropped(running[0])
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("bigint"))

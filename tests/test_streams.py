"""Streams over many files in adverse order against their batch twins."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from colloquy.operators import turns as T
from colloquy.streaming.context import check_nothing_waits, stream_context
from colloquy.streaming.metrics import latest, stream_epoch_means
from colloquy.streaming.runner import drain_append, drain_update, read_table_stream


def in_files(rows, order, path, files):
    """Write ``rows`` as one file per range, the first of ``order`` first."""
    ranges = rows.repartitionByRange(files, *order)
    parts = [r["p"] for r in ranges.select(F.spark_partition_id().alias("p"))
             .distinct().orderBy("p").collect()]
    data = ranges.withColumn("p", F.spark_partition_id()).toPandas()
    import os
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema
    os.makedirs(path)
    schema = to_arrow_schema(rows.schema)
    for n, p in enumerate(parts):
        part = data[data.p == p].drop(columns="p")
        file = f"{path}/part-{n:04}.parquet"
        pq.write_table(pa.Table.from_pandas(part, schema, preserve_index=False), file)
        os.utime(file, (1_600_000_000 + n, 1_600_000_000 + n))
    return len(parts)


def test_contexts_from_turns_in_falling_order(spark, tmp_path):
    turns = spark.range(2600).select(
        (F.col("id") % 4).alias("conv_id"), F.floor(F.col("id") / 4).alias("turn"),
        F.concat(F.lit("t"), "id").alias("text"))
    files = in_files(turns, [F.desc("turn"), "conv_id"],
                     str(tmp_path / "conversations.parquet"), 130)
    assert files > 64
    stream = read_table_stream(spark, str(tmp_path), "conversations", 20)
    got = {(r.conv_id, r.turn): list(r.context) for r in drain_append(
        stream_context(stream, 3), "test", check_nothing_waits).collect()}
    want = {(r.conv_id, r.turn): list(r.context)
            for r in T.rolling_context(turns, 3).collect()}
    assert got == want and len(want) == 2600


def test_missing_and_repeated_turns_are_reported(spark, tmp_path):
    rows = [(1, t, "x") for t in (0, 1, 3)] + [(2, 0, "y")]
    ddl = "conv_id bigint, turn bigint, text string"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "gap.parquet"))
    with pytest.raises(ValueError, match="did not come"):
        drain_append(stream_context(read_table_stream(spark, str(tmp_path), "gap"), 2),
                     "test", check_nothing_waits)
    twice = spark.createDataFrame(rows[:2] + rows[:1], ddl)
    twice.write.parquet(str(tmp_path / "twice.parquet"))
    with pytest.raises(StreamingQueryException, match="came twice"):
        drain_append(stream_context(read_table_stream(spark, str(tmp_path), "twice"), 2),
                     "test")


def steps_table(spark):
    return spark.range(3000).select(
        (F.col("id") % 7).alias("run_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3000).alias("ts"),
        (F.col("id") % 10).cast("double").alias("loss"))


def test_means_from_days_in_falling_order(spark, tmp_path):
    steps = steps_table(spark)
    assert in_files(steps, [F.desc("ts")], str(tmp_path / "steps.parquet"), 130) > 64
    stream = read_table_stream(spark, str(tmp_path), "steps", 20)
    got = latest(drain_update(stream_epoch_means(stream), "test")).collect()
    want = stream_epoch_means(steps).collect()
    assert sum(r.n_steps for r in got) == 3000
    assert {(r.run_id, r.day.start): (r.n_steps, round(r.loss, 9)) for r in got} == {
        (r.run_id, r.day.start): (r.n_steps, round(r.loss, 9)) for r in want}


def test_rows_behind_the_watermark_fail_the_run(spark, tmp_path):
    in_files(steps_table(spark), [F.desc("ts")], str(tmp_path / "steps.parquet"), 20)
    stream = read_table_stream(spark, str(tmp_path), "steps", 5)
    with pytest.raises((ValueError, StreamingQueryException), match="longer delay"):
        drain_update(stream_epoch_means(stream, "1 day"), "test")

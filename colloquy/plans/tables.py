"""The driver's tables seen as the inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.functions.numbers import whole_part


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training steps: a run per user, an epoch per five days, a batch loss
    per value. Training losses of error events are NaN; perplexities of large
    losses are infinite, as an overflow leaves them."""
    valid = F.col("event_id") % 5 == 0
    loss = F.col("value") / 100
    broken = (F.col("event_type") == "error") & ~valid
    return (table(spark, sf_dir, "events")
            .select(F.col("user_id").alias("run_id"),
                    whole_part(F.datediff(F.col("ts").cast("date"),
                                          F.lit("2024-01-01").cast("date")), 5)
                    .cast("int").alias("epoch"),
                    F.when(valid, "valid").otherwise("train").alias("split"),
                    (F.col("event_id") % 4).cast("int").alias("rank"),
                    F.col("event_id").alias("step"),
                    F.col("ts").cast("timestamp").alias("ts"),
                    F.when(broken, F.lit(float("nan"))).otherwise(loss).alias("loss"),
                    (F.pmod(F.col("event_id"), F.lit(100)) / 100).alias("acc"),
                    F.when(broken, F.lit(float("nan")))
                    .when(loss >= 4, F.lit(float("inf")))
                    .otherwise(F.exp(loss)).alias("ppl")))


def logit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as next-token scores: four positions per sequence, 64 rows
    per batch, the label as target."""
    return table(spark, sf_dir, "embeddings").select(
        whole_part(F.col("vec_id"), 4).alias("seq_id"),
        F.pmod("vec_id", F.lit(4)).cast("int").alias("pos"),
        whole_part(F.col("vec_id"), 64).alias("batch"),
        F.col("label").alias("target"),
        F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))

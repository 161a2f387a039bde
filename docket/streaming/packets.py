"""Streaming: records that arrive in a folder go through the same plan, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.packets import extract_isolated
from ..sources.sinks import write_dead
from ..sources.records import RECORD


def record_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of arriving files with the file and block they stand in (_file, _block)."""
    rows = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return rows.where("case_id is not null").select("case_id", "scale", "pages", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def last_of_each(batch: DataFrame) -> DataFrame:
    """Of a batch's records with one case_id the last, as the batch reader has it: by file name, block and place."""
    at = F.struct("_file", "_block", F.monotonically_increasing_id().alias("n"))
    return batch.withColumn("at", at).groupBy("case_id").agg(F.max_by(F.struct("scale", "pages"), "at").alias("r")).select("case_id", "r.scale", "r.pages")


def extract_stream(records: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Fields of each micro-batch as Parquet under out, a folder a batch, so that a batch run twice is written once.

    Windows within a packet are not over time, so they run inside foreachBatch, where
    a packet is whole.  Packets that a step fails on go to <out>-dead/batch=<number>, with the reason.
    """

    def write(batch: DataFrame, number: int) -> None:
        fields, dead = extract_isolated(last_of_each(batch) if "_file" in batch.columns else batch)
        fields.drop("visible_text").write.mode("overwrite").parquet(f"{out}/batch={number}")
        write_dead(dead, f"{out.rstrip('/')}-dead/batch={number}")

    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

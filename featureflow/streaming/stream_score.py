"""Request scoring as a Structured Streaming job (M8).

The reference serves requests over HTTP; the Spark form reads request
records from a directory stream, applies exactly the batch scoring
projection (``score_requests``; stateless, so no watermark or state store)
and appends results to a parquet sink with a checkpoint, which makes the
sink exactly-once across restarts and executor loss.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from featureflow.operators.serving import ServingModel, score_requests
from featureflow.schema import REQUEST


def start_stream_scoring(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str,
                         model: ServingModel, available_now: bool = True,
                         processing_time: str | None = None,
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(REQUEST).option("mode", "PERMISSIVE")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    scored = score_requests(reader.json(input_dir), model)
    writer = (scored.writeStream.format("parquet").option("path", output_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=processing_time or "10 seconds")
    return writer.start()

"""The request-at-a-time endpoint re-aimed as a stream of questions against a
static KB. Each micro-batch goes through ``answer_batch`` (H9) in ``foreachBatch``;
output is written per batch id (overwrite), so a retried batch is idempotent, and
the stream's progress lives in a checkpoint under the session's shared
``spark.checkpoint.dir``. No state spans batches, so no watermark is needed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir


def run_answer_stream(spark: SparkSession, stream: DataFrame, to_questions, answer_fn, out_dir: str | None = None,
                      available_now: bool = True) -> str:
    """Start the stream, process what is available, stop; return the output folder.

    ``stream``: a streaming DataFrame; ``to_questions(batch_df) -> (question_id,
    question)``; ``answer_fn(questions_df) -> (responses_df, rejected_df)``.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = out_dir or f"{base}/answer-stream-{uuid.uuid4().hex[:12]}"

    def handle(batch: DataFrame, batch_id: int) -> None:
        qs = to_questions(batch)
        responses, rejected = answer_fn(qs)
        responses.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{run}/responses/batch_id={batch_id}")
        rejected.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{run}/rejected/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{run}/_checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    q = writer.start()
    q.awaitTermination()
    return run

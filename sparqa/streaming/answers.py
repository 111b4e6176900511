"""I2 ``stream_answers``: questions arriving as files are answered batch by
batch against the static corpora (a stream-static plan inside
``foreachBatch``) and appended to a parquet sink keyed by the batch id, so a
replayed batch overwrites its own output only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, QAConfig
from ..operators.answering import answer_questions
from ..session import scratch

QUESTION_SCHEMA = "query_id long, question string"


def start_answer_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, main,
                        uploaded=None, generated=None, cfg: QAConfig = DEFAULT, use_uploaded: bool = False,
                        available_now: bool = True, fmt: str = "parquet"):
    """Start I2; answers land in ``out_dir/batch_id=<n>``."""
    questions = spark.readStream.schema(QUESTION_SCHEMA).format(fmt).load(in_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        gen = generated
        if isinstance(generated, DataFrame):
            gen = generated.join(batch.select("query_id"), "query_id", "left_semi")
        # the batch's intermediate tables go when its answers are written
        with scratch(batch.sparkSession):
            ans = answer_questions(batch, main, uploaded, gen, cfg, use_uploaded)
            ans.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
                .parquet(f"{out_dir}/batch_id={batch_id}")

    w = questions.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()

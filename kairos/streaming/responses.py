"""Incremental scoring of response files (S8 + A10 as a stream).

Each micro-batch of new response files is parsed and scored against the
static goal tables (stream-static joins, no streaming state). Its per-response
counts replace the Parquet partition of its epoch, so a batch that is retried
writes the same rows once. Reports (E7) are plain batch aggregations over that
table. The caller names the checkpoint folder, which must stay the same from
start to start and be shared by the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos import schemas
from kairos.functions.dates import date_text
from kairos.operators import ranking
from kairos.plans.datasets import Labels
from kairos.plans.evaluation import goal_tables, scopes_of_kinds


def score_stream(spark: SparkSession, responses_dir: str, labels: Labels, out_dir: str,
                 checkpoint: str, trigger_once: bool = True):
    """Start the stream; returns the StreamingQuery."""
    stream = spark.readStream.schema(schemas.RESPONSES).json(responses_dir)
    goals = goal_tables(labels)
    ex = labels.examples.select("example_id", date_text(F.col("cutoff")).alias("cutoff"))

    def batch(df: DataFrame, epoch: int):
        rid = F.concat_ws("|", "model", "data_variant", "ablation", "example_id")
        parsed = ranking.parse_responses(df.withColumn("rid", rid)).join(ex, "example_id")
        scored = ranking.score(parsed, scopes_of_kinds(), goals).select(
            "model", "data_variant", "ablation", "goal_name", "example_id", "cutoff",
            "tp", "fp", "fn", "rank", "counted", "n_bullets")
        scored.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from kairos.plans.datasets import Labels
from kairos.streaming.responses import score_stream


def test_stream_scores_new_files(spark):
    d = tempfile.mkdtemp(prefix="kairos-stream-")
    inbox, out = os.path.join(d, "in"), os.path.join(d, "out")
    ex = spark.createDataFrame([("e1", 0, dt.date(2000, 1, 1), "c1")], "example_id string, k int, cutoff date, customerID string")
    good = spark.createDataFrame([("e1", "AA")], "example_id string, ISIN string")
    prof = spark.createDataFrame([(0, dt.date(2000, 1, 1), "AA"), (0, dt.date(2000, 1, 1), "BB")],
                                 "k int, cutoff date, ISIN string")
    labels = Labels(ex, good, good, prof)
    spark.createDataFrame([("m", "fin", "none", "e1", "<think></think>x\n- AA\n- CC", 10)],
                          "model string, data_variant string, ablation string, example_id string, response string, n_tokens int"
                          ).write.json(inbox)
    def run():
        score_stream(spark, inbox, labels, out, checkpoint=os.path.join(d, "checkpoint")).awaitTermination(120)
        return sorted((r.goal_name, r.example_id, r.ablation, r.tp, r.fp, r.rank) for r in spark.read.parquet(out).collect())
    kinds = ["completion", "futurePurchases", "profitableAssets"]
    once = [(k, "e1", "none", 1, 1, 0) for k in kinds]
    assert run() == once
    assert run() == once  # a restart finds its checkpoint and adds nothing
    spark.createDataFrame([("m", "fin", "Background", "e1", "<think></think>x\n- CC", 10)],
                          "model string, data_variant string, ablation string, example_id string, response string, n_tokens int"
                          ).write.mode("append").json(inbox)
    assert run() == sorted(once + [(k, "e1", "Background", 0, 1, -1) for k in kinds])

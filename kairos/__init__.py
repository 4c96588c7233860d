"""kairos — point-in-time recommendation datasets and their evaluation on Spark.

Every operator takes and returns DataFrames and is built from Catalyst
expressions; see README.md for the operator map.
"""

from kairos.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

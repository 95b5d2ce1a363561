"""labelflow: Spark-native analytics for partially labelled, aligned sequence collections.

Every public function takes and returns Spark DataFrames (or Columns) and builds a lazy
logical plan; nothing is collected to the driver except bounded model parameters.
"""

from labelflow.session import get_spark, checkpoint_dir  # noqa: F401

"""ledgerlake: financial analytics for many entities at once, on Spark.

Every public operator takes DataFrames and returns a lazy DataFrame; no
operator loops over entities on the driver.
"""

from ledgerlake.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

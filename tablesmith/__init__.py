"""tablesmith: Spark-native data preparation and profiling.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark's
own column functions, so Catalyst plans it and nothing passes through the
driver except small statistics (means, quantiles, bounds).
"""

from .session import get_spark, ensure_checkpoint_dir, materialize  # noqa: F401

__version__ = "0.1.0"

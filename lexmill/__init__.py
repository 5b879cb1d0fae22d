"""lexmill: text classification on tables and streams, written as Spark jobs.

Every public function takes and returns DataFrames (or Columns); nothing builds
a session at import time.
"""

import sys

from pyspark import cloudpickle

from lexmill.config import ScoringJob, TrainingConfig

# Functions of this package travel to Python workers by value, so a cluster
# needs no copy of the package on its nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ScoringJob", "TrainingConfig"]
__version__ = "0.1.0"

"""Spark-native corpus preparation, retrieval and log analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel with the job: executors then need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-native engine that turns document collections into training data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

#: Functions of this package travel to executors by value, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

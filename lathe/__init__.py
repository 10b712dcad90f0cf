"""Lathe: JSON query expressions, list and stream operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Molecule screening and training-data preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value with their task, so
# executors need no copy of this package on their Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

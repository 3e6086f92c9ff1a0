"""Spark-first engine for ranking, slicing and summarising a corpus of source files."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

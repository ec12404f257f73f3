"""Operators of a training-data pipeline, with their queries. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

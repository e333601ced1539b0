"""Fund-flow analytics on Spark DataFrames: transfer graphs, laundering patterns, scores, alerts."""

import sys

from pyspark import cloudpickle

# Tasks receive the package's functions by value, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

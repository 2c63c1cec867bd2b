"""Corpus preparation and bulk retrieval on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The helpers that run in Arrow batches travel with the plan, so the executors
# need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

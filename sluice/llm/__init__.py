"""Operators for preparing training text: deduplication, filtering, tokenisation and sharding on Spark."""

import sys

from pyspark import cloudpickle

# task functions travel with the task, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

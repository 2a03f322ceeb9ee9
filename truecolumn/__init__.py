"""Lossless ingest of delimited text, and account balances, on Spark."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their code, so the
# executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

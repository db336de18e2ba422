"""Batch and streaming recommendation analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

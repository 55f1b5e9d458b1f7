"""Operators of a training-data pipeline over tables of documents."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

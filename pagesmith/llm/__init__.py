"""Operators for training-data pipelines; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# functions of these modules ship with the job, so workers need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

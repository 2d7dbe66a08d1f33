"""Hybrid document retrieval expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a session which did not ship
# the package (no --py-files, no shared installation) can run them all the same.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

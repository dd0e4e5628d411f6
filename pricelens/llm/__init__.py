"""Operators of a training-data pipeline: extraction, filtering, scanning,
deduplication, mixing, packing and sharding of large text tables.  Nothing
else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so these need
# not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for preparing large text corpora; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

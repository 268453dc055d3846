"""Inkloom: a PySpark-native engine for stylometric corpus analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Folioscope: author-page analytics over captured web pages, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions shipped to executors travel by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

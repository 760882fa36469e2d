"""Representation and benchmark-score analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to tasks carry their code, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

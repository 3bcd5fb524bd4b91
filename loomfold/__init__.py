"""loomfold: text-corpus analytics expressed as PySpark DataFrame, SQL and Structured Streaming plans."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions for Python workers travel by value, so executors need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

"""Hybrid document retrieval and corpus processing on PySpark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to executors by value, so that a cluster needs
# no installation of it and a driver may import it from any folder.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
